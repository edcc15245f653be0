"""Many files with bad lines: each fault is told, each good row is kept."""

import pytest

from fareloom.sources.deliveries import CORRUPT, bad_lines, changes, delivered, faults, manifest

SCHEMA = "month string, route string, pax long"
HEADER = "month,route,pax"


@pytest.fixture
def folder(tmp_path):
    files = {
        "a/2024-01.csv": f"# provenance: official\n{HEADER}\n2024-01,DEL-BOM,300\n2024-01,DEL-BLR,none\n\n2024-01,BOM-DEL\n2024-01,\"BLR-DEL\",7\n",
        "a/2024-02.csv": f"{HEADER.upper()}\r\n2024-02,DEL-BOM,0\r\n2024-02,DEL-BLR,5,extra\r\n2024-02,BOM-DEL,\r\n",
        "b/2024-03.csv": f"{HEADER}\n2024-03,DEL-BOM,9\n2024-03,DEL-BOM,9\n2024-03,DEL-BLR,4\n",
        "b/empty.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    return tmp_path


def short(rows):
    return sorted(((r.file or "").rsplit("/", 1)[-1], *r[1:]) for r in rows)


def test_lines_that_do_not_fit_are_kept_whole(spark, folder):
    rows = delivered(spark, str(folder), SCHEMA, HEADER)
    assert short(bad_lines(rows).collect()) == [("2024-01.csv", "2024-01,BOM-DEL"), ("2024-01.csv", "2024-01,DEL-BLR,none"), ("2024-02.csv", "2024-02,DEL-BLR,5,extra")]
    good = rows.where(f"{CORRUPT} is null").select("month", "route", "pax").collect()
    assert sorted(map(tuple, good), key=repr) == sorted([("2024-01", "DEL-BOM", 300), ("2024-01", "BLR-DEL", 7), ("2024-02", "DEL-BOM", 0), ("2024-02", "BOM-DEL", None), ("2024-03", "DEL-BOM", 9), ("2024-03", "DEL-BOM", 9), ("2024-03", "DEL-BLR", 4)], key=repr)
    assert rows.where(f"{CORRUPT} is not null").selectExpr("count(month) + count(route) + count(pax)").first()[0] == 0


def test_every_fault_is_told(spark, folder):
    rows = delivered(spark, str(folder), SCHEMA, HEADER)
    expected = spark.createDataFrame([(m, r) for m in ("2024-01", "2024-03", "2024-04") for r in ("DEL-BOM", "DEL-BLR")], "month string, route string")
    pinned = spark.createDataFrame([("2024-01", "DEL-BOM", 300), ("2024-01", "BLR-DEL", 8), ("2024-05", "DEL-BOM", 1)], SCHEMA)
    found = faults(rows, "month", "route", "pax", expected, pinned).collect()
    assert sorted((r.problem, (r.file or "").rsplit("/", 1)[-1], r.what) for r in found) == [
        ("bad line", "2024-01.csv", "2024-01,BOM-DEL"),
        ("bad line", "2024-01.csv", "2024-01,DEL-BLR,none"),
        ("bad line", "2024-02.csv", "2024-02,DEL-BLR,5,extra"),
        ("missing", "", "2024-01 DEL-BLR"),
        ("missing", "", "2024-04 DEL-BLR"),
        ("missing", "", "2024-04 DEL-BOM"),
        ("no volume", "2024-02.csv", "2024-02 BOM-DEL"),
        ("no volume", "2024-02.csv", "2024-02 DEL-BOM"),
        ("pinned", "", "2024-05 DEL-BOM: nothing for 1"),
        ("pinned", "2024-01.csv", "2024-01 BLR-DEL: 7 for 8"),
        ("repeated", "2024-03.csv", "2024-03 DEL-BOM"),
    ]
    clean = delivered(spark, str(folder / "a" / "2024-01.csv"), SCHEMA, HEADER).where("pax > 0")
    assert faults(clean, "month", "route", "pax", expected.where("month = '2024-01' and route = 'DEL-BOM'")).collect() == []


def test_manifest_tells_changed_files(spark, folder):
    old = manifest(delivered(spark, str(folder), SCHEMA, HEADER)).toPandas()
    counts = {r.file.rsplit("/", 1)[-1]: (r.n_lines, r.n_rows, r.n_bad) for r in old.itertuples()}
    assert counts == {"2024-01.csv": (4, 2, 2), "2024-02.csv": (3, 2, 1), "2024-03.csv": (3, 3, 0)}  # no lines, no row
    (folder / "a/2024-01.csv").write_text("2024-01,BLR-DEL,7\n2024-01,DEL-BOM,301\n")
    (folder / "a/2024-02.csv").unlink()
    (folder / "b/2024-03.csv").write_text("2024-03,DEL-BLR,4\n2024-03,DEL-BOM,9\n2024-03,DEL-BOM,9\n")  # other order, no header
    (folder / "b/2024-04.csv").write_text("2024-04,DEL-BLR,4\n")
    new = manifest(delivered(spark, str(folder), SCHEMA, HEADER))
    found = changes(new, spark.createDataFrame(old, new.schema)).collect()
    assert short(found) == [("2024-01.csv", "changed"), ("2024-02.csv", "removed"), ("2024-04.csv", "added")]
    assert changes(new, new.alias("again")).collect() == []
