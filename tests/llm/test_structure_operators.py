"""Whitening, conversation repair and license scan against brute force and on awkward rows."""

import hashlib
import itertools
import re
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareloom.llm import conversations, license_scan, queries as Q, whitening
from fareloom.llm.conversations import damaged, repair, reports
from fareloom.llm.license_rules import KINDS, Rule, rules
from fareloom.llm.whitening import whiten

SPACE = " \t\n\x0b\x0c\r"


def plain_whitening(rows, scale=256, components=4):
    """Usable rows, their x, and mean, sums, eigenvalues and eigenvectors over the distinct x."""
    kept = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, tuple(x + [0] * (dims - len(x)))) for i, x in kept]
    fit = sorted({x for _, x in kept})
    sums = [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([s / len(fit) for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return kept, len(fit), sums, values[::-1], vectors[:, ::-1][:, :components]


def check_whitened(found, rows, components=4, scale=256):
    kept, n, sums, values, vectors = plain_whitening(rows, scale, components)
    count = min(components, len(sums))
    assert len(found) == len(kept) * count
    want = sorted((i if i is not None else -1, *x) for i, x in kept for _ in range(count))
    assert sorted(i if i is not None else -1 for i, *_ in want) == sorted(-1 if r["vec_id"] is None else r["vec_id"] for r in found)
    by_id = {i: x for i, x in kept}
    for k in range(count):
        part = [r for r in found if r["component"] == k + 1]
        x = np.array([by_id[r["vec_id"]] for r in part], float)
        plain = (x - np.array([s / n for s in sums])) @ vectors[:, k] / np.sqrt(values[k])
        got = np.array([r["whitened"] for r in part])
        assert min(np.abs(got - plain).max(), np.abs(got + plain).max()) < 1e-8 * max(1, np.abs(plain).max())
        for r in part:
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(by_id[r["vec_id"]], sums, strict=True))
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


VECTORS = "vec_id long, embedding array<double>"


def test_whitening_of_the_table(spark, tables):
    found = Q.op11_embedding_whitening(spark, tables).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    check_whitened(found, rows)


def test_whitening_leaves_out_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.standard_normal(6)]) for k in range(60)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (104, rows[0][1]), (104, rows[0][1]), (105, [0.5, -0.5]), (106, []), (None, rows[1][1])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("clash")).withColumn("component_2", F.lit(1))
    found = whiten(df)
    assert found.columns == ["vec_id", "embedding", "n", "component_2", "component", "_n", "deviation", "whitened", "explained", "identity_error"]
    check_whitened(found.drop("n").withColumnRenamed("_n", "n").collect(), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])], [(1, [float("nan")])]])
def test_whitening_without_vectors_gives_no_rows(spark, rows):
    assert whiten(spark.createDataFrame(rows, VECTORS)).collect() == []


def test_whitening_of_few_and_flat_vectors(spark):
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None)] * 4
    line = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(5)], VECTORS)).collect()
    by = {(r["vec_id"], r["component"]): r for r in line}
    assert abs(abs(by[4, 1]["whitened"]) - 2 / np.sqrt(2)) < 1e-12 and by[0, 1]["explained"] == pytest.approx(1)
    assert all(by[k, c]["whitened"] is None and by[k, c]["explained"] == 0 for k in range(5) for c in (2, 3))


def test_whitening_is_exact_beyond_longs(spark):
    rows = [(k, [float(2.0**40 * ((k * k) % 7) + k), float(k)]) for k in range(9)] + [(50, [1e300, 0.0])]
    found = {r["vec_id"]: r for r in whiten(spark.createDataFrame(rows, VECTORS), components=1).collect()}
    top = 2**63 - 1
    x = {k: (top if k == 50 else int(np.floor(256 * v[0])), int(256 * v[1])) for k, v in rows}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    for k, v in x.items():
        exact = sum((10 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert found[k]["deviation"] == (Decimal(exact) if exact < 10**38 else None)


@pytest.mark.parametrize(("noise", "narrow"), [(0.05, True), (1.0, False)])
def test_the_range_finder_stops_early_only_where_the_spectrum_falls(spark, noise, narrow):
    rng = np.random.default_rng(5)
    data = np.floor(256 * (rng.standard_normal((300, 3)) @ rng.standard_normal((3, 30)) + noise * rng.standard_normal((300, 30)))).astype(int)
    fit = spark.createDataFrame([(row.tolist(),) for row in data], "x array<long>").repartition(5)
    mean = data.mean(axis=0)
    values, vectors, trace, width = whitening.principal_components(fit, 30, 300, mean, 3)
    c = data - mean
    plain, axes = np.linalg.eigh(c.T @ c / 300)
    assert (width < 30) == narrow
    assert values == pytest.approx(plain[::-1][:3], rel=1e-12) and trace == pytest.approx(plain.sum(), rel=1e-12)
    assert np.abs(np.abs(np.sum(vectors * axes[:, ::-1][:, :3], axis=0)) - 1).max() < 1e-12


def test_more_dimensions_than_allowed_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 20)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, rng.standard_normal(30).tolist()) for k in range(100)], VECTORS)
    with pytest.raises(ValueError, match="dimensions"):
        whiten(df)


def test_whitening_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 512)
    monkeypatch.setattr(whitening, "SLOTS", 2)
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(20).tolist()) for k in range(200)]
    check_whitened(whiten(spark.createDataFrame(rows, VECTORS).repartition(7)).collect(), rows)


TURNS = "conv_id long, turn long, role string, text string"
OK_END = re.compile(r"(su|ua|au)")


def plain_faults(rows):
    """Rows in order with their fault."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for t, r, x in rows:
        last = x.strip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else ""
        seen.add((r, x))
        out.append((t, r, x, fault))
    return out


def plain_repair(rows):
    """The cheapest edits among all, tried one by one: (cost, audit, repaired lines)."""
    rows = plain_faults(rows)
    best = None

    def walk(i, initials, cost, audit, lines, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not re.fullmatch("(s?(ua)*u?)", initials):
            return
        if inserted < 3:
            for role in ("user", "assistant"):
                walk(i, initials + role[0], cost + 3, audit + "I", [*lines, f"{role}:"], inserted + 1)
        if i < len(rows):
            _, role, text, fault = rows[i]
            walk(i + 1, initials, cost + 4, audit + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                walk(i + 1, initials + (role[:1] or "?"), cost + more, audit + "K", [*lines, f"{role}:{text}"], 0)
                for new in ("user", "assistant"):
                    walk(i + 1, initials + new[0], cost + more + 3, audit + "R", [*lines, f"{new}:{text}"], 0)

    walk(0, "", 0, "", [], 0)
    return best


def plain_report(rows):
    ordered = plain_faults(rows)
    turns = sorted({t for t, *_ in ordered if t is not None})
    faults = [f for *_, f in ordered]
    initials = [r[:1] for _, r, _, _ in ordered]
    cost, audit, lines = plain_repair(rows)
    return {
        "gaps": turns[-1] - turns[0] + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def check_reports(found, rows, ids=()):
    groups = {i: [] for i in ids}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(tuple(row))
    got = {r["conv_id"]: r.asDict() for r in found}
    assert got.keys() == groups.keys() and len(found) == len(groups)
    for conv, own in groups.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == plain_report(own), own


@pytest.mark.parametrize(("block", "fan_in", "batch"), [(128, 32, 16384), (2, 2, 5), (4, 3, 1)])
def test_repairs_against_all_edits(spark, monkeypatch, block, fan_in, batch):
    for name, value in (("BLOCK_ROWS", block), ("FAN_IN", fan_in), ("BATCH_ROWS", batch)):
        monkeypatch.setattr(conversations, name, value)
    rng = np.random.default_rng(block)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "u"], ["a.", "b!", "c", " ", "", None, "d? \n", "e.\x85", "f "]
    rows = []
    for conv in range(120):
        for k in range(int(rng.integers(1, 7))):
            role = roles[rng.choice(7, p=[0.15, 0.35, 0.35, 0.05, 0.03, 0.03, 0.04])]
            rows.append((conv, None if rng.random() < 0.1 else int(rng.integers(0, 9)), role, texts[rng.choice(9, p=[0.3, 0.2, 0.2, 0.05, 0.05, 0.04, 0.1, 0.03, 0.03])]))
    rows += [(None, 1, "user", "null id."), (None, None, "user", "null id."), (500, 3, "user", "same."), (500, 3, "user", "same."), (500, 3, "user", "same.")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("place", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(3)
    ids = spark.createDataFrame([(900,), (901,), (500,)], "conv_id long")
    check_reports(reports(repair(turns, ids)).collect(), rows, [900, 901])


def test_a_long_conversation_is_split_and_right(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 16)
    monkeypatch.setattr(conversations, "FAN_IN", 4)
    rng = np.random.default_rng(11)
    rows = [(7, k, ["user", "assistant", "system"][rng.choice(3, p=[0.5, 0.45, 0.05])], f"t {k % 150}{'.' if rng.random() < 0.9 else ''}") for k in range(400)]
    got = reports(repair(spark.createDataFrame(rows, TURNS))).collect()
    # the plain least cost by a table over rows and states, as trying all edits is out of reach
    ordered, reach = plain_faults([r[1:] for r in rows]), {"": (0, "")}
    step = lambda s, c: {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[s].get(c)

    def inserts(reach):
        for _ in range(2):
            for state, (cost, audit) in list(reach.items()):
                for c in "ua":
                    if (new := step(state, c)) is not None:
                        reach[new] = min(reach.get(new, (cost + 3, audit + "I")), (cost + 3, audit + "I"))
        return reach

    for _, role, _, fault in ordered:
        after = {}
        for state, (cost, audit) in inserts(dict(reach)).items():
            options = [(state, cost + 4, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = cost + 3 * (fault == "truncated")
                options += [(step(state, role[0]), more, audit + "K"), *((step(state, c), more + 3, audit + "R") for c in "ua")]
            for new, c, a in options:
                if new is not None:
                    after[new] = min(after.get(new, (c, a)), (c, a))
        reach = after
    reach = inserts(reach)
    assert (got[0]["cost"], got[0]["audit"]) == min(reach.get(s, (10**9, "")) for s in ("", "a"))


def test_repaired_rows_are_whole_conversations(spark, tables):
    turns = spark.read.parquet(f"{tables}/conversations.parquet")
    rows = repair(damaged(turns), turns).collect()
    spoken, closed = {}, {}
    for r in rows:
        if r["place"] is None:
            closed[r["conv_id"]] = r
        else:
            assert r["conv_id"] not in closed and r["place"] == len(spoken.setdefault(r["conv_id"], []))
            spoken[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    found = {r["conv_id"]: r for r in Q.op12_conversation_repair(spark, tables).collect()}
    assert closed.keys() == found.keys() == {r["conv_id"] for r in turns.select("conv_id").distinct().collect()}
    for conv, r in found.items():
        lines = spoken.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)) and r["audit"] == closed[conv]["audit"]
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_damage_and_repair_of_the_table(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            after += [row] * (2 if kind == 3 else 1)
    check_reports(Q.op12_conversation_repair(spark, tables).collect(), after, {r[0] for r in rows})


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert reports(repair(empty)).collect() == [] and damaged(empty).collect() == []
    nulls = damaged(spark.createDataFrame([(None, None, None, None)], TURNS)).collect()
    assert [tuple(r) for r in nulls] in ([], [(None, None, " ", " ")], [(None, None, " ", "")], [(None, None, " ", " ")] * 2, [(None, None, "user", " ")])
    found = reports(repair(empty, spark.createDataFrame([(1,), (None,)], "conv_id long"))).collect()
    assert {tuple(r) for r in found} == {(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (1, None)}


def plain_scan(text, found):
    """n_words, n_base, first, last, base labels, labels, score and detections, rule by rule over a list of words."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    free, detections = list(words), []
    for rule in found:
        body = " " + " ".join(free) + " "
        for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", body):
            start, n = body[: m.start()].count(" ") - 1, len(m[0].split(" "))
            free[start : start + n] = ["\x02"] * n
            detections.append((start, n, rule.label, rule.kind))
    base, own = {label for _, label in places}, {d[2] for d in detections}
    score = max((KINDS[d[3]] for d in detections), default=0.3 if places else 0.0)
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score, sorted(detections)


TEXTS = [
    None, "", "   ", "no hit", "CC BY cc-by;CC  BY 4.0!", "The GNU General Public License, version 3. All Rights Reserved. all rights reserved",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Released under the MIT License. MIT license again; mit-licence.", "SPDX-License-Identifier: GPL-2.0-or-later", "see https://www.gnu.org/licenses/ and CC-BY-SA 4.0",
    "licensed under a new bsd license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')",
    "K cc by x lİcense général public license copyright 2020", "general public license general public license", "gplv3 gpl v3 gnu gpl 3.0 or later; lgpl 2.1", "unlicense\tcopyleft public\ndomain",
    "neither the name of the Foo nor the names of its contributors may be used to endorse or promote products derived from this software",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted",
]


def scanned(rows):
    return [(*(r[c] for c in license_scan.RESULTS[:7]), [tuple(d) for d in r["detections"]]) for r in rows]


def test_license_scan_against_plain_search(spark):
    rng = np.random.default_rng(4)
    parts = [p for t in TEXTS if t for p in t.split()]
    mixed = [" ".join(rng.choice(parts, size=rng.integers(1, 120))) for _ in range(150)]
    texts = [*TEXTS, *mixed, TEXTS[7], " ".join(TEXTS[5:12]) * 30]
    df = spark.createDataFrame([(k if k % 50 else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    found = license_scan.scan(df)
    assert found.columns == ["doc_id", "text", "labels", "n_words", "n_base", "first_word", "last_word", "base_labels", "_labels", "score", "detections"]
    got = sorted(scanned(found.drop("labels").withColumnRenamed("_labels", "labels").collect()), key=str)
    ordered = rules()
    assert got == sorted((plain_scan(t, ordered) for t in texts), key=str)


def test_license_scan_of_the_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ordered = rules()
    found = Q.op13_license_scan(spark, tables).collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r)[1:] == plain_scan(texts[r["doc_id"]], ordered)[:-1]


def test_better_rules_suppress_what_they_hold(spark):
    found = [Rule("text", "wide", "a b c d", ("a",)), Rule("name", "inner", "b c", ("b",)), Rule("name", "across", "d e", ("e",)), Rule("mention", "free", "e", ("e",))]
    df = spark.createDataFrame([(1, "a b c d e. b c! a b"), (2, "x d e")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(d) for d in r["detections"]] for r in license_scan.scan(df, found=found).collect()}
    assert got == {1: [(0, 4, "wide", "text"), (4, 1, "free", "mention"), (5, 2, "inner", "name")], 2: [(1, 2, "across", "name")]}
    assert {r["labels"] for r in license_scan.scan(df, found=[]).collect()} == {""}


def test_rules_are_gated_by_words_of_every_match():
    ordered = rules()
    assert len(ordered) > 250 and [r.kind for r in ordered] == sorted((r.kind for r in ordered), key=list(KINDS).index)
    probe = [plain_scan(t, ordered)[-1] for t in TEXTS]
    assert sum(map(len, probe)) >= 20
    for text in TEXTS:
        body = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())) + " "
        for r in ordered:
            if re.search(f"(?<= )(?:{r.pattern})(?= )", body):
                assert set(r.keywords) <= set(body.split()), (r, text)


def test_license_scan_runs_no_python_and_no_shuffle(spark, tables):
    plan = Q.op13_license_scan(spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_license_scan_of_very_long_and_empty_tables(spark):
    long = "the mit license and cc by " * 40_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = license_scan.scan(df).collect()[0]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (240_000, 40_000, 4, 239_998, "cc-by,mit") and len(r["detections"]) == 40_000
    assert license_scan.scan(df.limit(0)).collect() == []
