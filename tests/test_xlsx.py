"""Workbooks written by hand read back as the table that was written."""

import random
import zipfile
from xml.sax.saxutils import escape

from fareloom.sources.parsers import TRAFFIC, aligned
from fareloom.sources.xlsx import read_xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def letters(place):
    out = ""
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(path, sheets, shared=()):
    """``sheets``: name to rows of cells; a cell is null, a number, ("s", place in shared), ("i", text) or ("b", flag)."""
    with zipfile.ZipFile(path, "w") as book:
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {LINKS}>" + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{t}</si>" for t in shared) + "</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, cells in enumerate(rows, 1):
                body += f'<row r="{r}">'
                for c, cell in enumerate(cells, 1):
                    at = f'r="{letters(c)}{r}"'
                    if isinstance(cell, tuple):
                        kind, value = cell
                        body += {"s": f'<c {at} t="s"><v>{value}</v></c>', "i": f'<c {at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>', "b": f'<c {at} t="b"><v>{value}</v></c>'}[kind]
                    elif cell is not None:
                        body += f"<c {at}><f>1+1</f><v>{cell}</v></c>"
                body += "</row>"
            book.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def test_shared_inline_and_sparse_cells(spark, tmp_path):
    shared = ["<t>Month</t>", "<t>Route</t>", "<r><t>DEL</t></r><r><t>-BOM &amp; more</t></r><rPh sb=\"0\" eb=\"1\"><t>hint</t></rPh>"]
    rows = [[], [None, ("s", 0), ("i", " route "), ("i", "Pax"), ("i", "pax")], [None, ("i", "2024-01"), ("s", 2), 300, 9], [], [None, None, ("i", "DEL-BLR"), None, None, ("i", "no name")], [None, ("i", ""), None, ("b", 1)]]
    workbook(tmp_path / "a.xlsx", {"Flows": rows, "Empty": [], "Other": [[("i", "pax")], [7.5]]}, shared)
    (tmp_path / "notes.txt").write_text("no workbook")
    found = read_xlsx(spark, str(tmp_path), ["month", "Route", "pax", "absent"]).orderBy("sheet", "row").collect()
    assert [tuple(r)[1:] for r in found] == [("Flows", 3, "2024-01", "DEL-BOM & more", "300", None), ("Flows", 5, None, "DEL-BLR", None, None), ("Flows", 6, None, None, "true", None), ("Other", 2, None, None, "7.5", None)]
    assert read_xlsx(spark, str(tmp_path), ["pax"], sheet="Other").count() == 1


def test_many_files_equal_the_table(spark, tmp_path):
    rng, expected = random.Random(2), []
    for month in ("2024-01", "2024-02", "2024-03"):
        rows = [(month, f"R{k}", rng.choice([None, k * 10])) for k in range(200)]
        expected += [(*r[:2], None if r[2] is None else str(r[2])) for r in rows]
        (tmp_path / month).mkdir()
        filler = [None] * 28  # columns beyond Z
        head = [("i", "Period"), *filler, ("i", "Corridor"), ("i", "Passengers")]
        workbook(tmp_path / month / "flows.xlsx", {"x": [head, *([("i", m), *filler, ("i", r), p] for m, r, p in rows)]})
    raw = read_xlsx(spark, str(tmp_path), ["period", "corridor", "passengers"])
    found = aligned(raw, TRAFFIC).select("year_month", "route_code", "pax_volume").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
