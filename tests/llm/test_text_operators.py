"""Text operators against brute force, on whole small tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fareloom.llm import minhash, queries as Q, substring_dedup
from fareloom.llm.minhash import Settings, keep_one, near_duplicates
from fareloom.llm.packing import pack, window_cuts
from fareloom.llm.quality_rules import judge, keep_good
from fareloom.llm.substring_dedup import remove_repeats
from fareloom.llm.token_counts import count_tokens
from fareloom.llm.token_files import read_token_files, write_token_files
from fareloom.llm.tokenizing import PieceCache, drops_white_space, encode_texts, load_tokenizer
from fareloom.llm.textwords import as_text, split_words, window_hashes, word_hashes

SPACE = " \t\n\x0b\x0c\r"
#: A null, an empty text, only white space, one word, odd white space and characters, ties and repeats.
ODD = [None, "", " \n\t ", "word", "a\x0bb\x0cc d", "  lead and trail  ", "İx Σς é́ <|endoftext|>, don't'S", "日本語　text x", "x\x00y z", "same text here", "same text here"]


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def odd_docs(spark, extra=()):
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate([*ODD, *extra])]
    rows += [(None, "no id here at all", "en", "s", 17), (3, "word again", "en", "s", 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("refs", F.lit(1)).withColumn("n_words", F.lit("clash"))


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def test_words_and_windows_match_a_regular_expression():
    texts = as_text(pa.array(ODD, pa.string()))
    batch = split_words(texts)
    got = [[batch.words[int(c)].as_py() for c in batch.codes[a:b]] for a, b in zip(batch.offsets, batch.offsets[1:])]
    assert got == [words(t) for t in ODD]
    for width in (1, 2, 3, 50):
        many = as_text(pa.array([" ".join(random.Random(k).choices("abc", k=k % 70)) for k in range(150)]))
        split = split_words(many)
        hashes, bounds = window_hashes(word_hashes(split), split.offsets, width)
        plain = [tuple(w[k : k + width]) for w in map(words, many.to_pylist()) for k in range(len(w) - width + 1)]
        assert len(plain) == len(hashes) == bounds[-1]
        assert len(set(zip(plain, hashes.tolist(), strict=True))) == len(set(plain)) == len(set(hashes.tolist()))


# -- token counts, files and packing ---------------------------------------------------------------


def test_ids_equal_the_library():
    path = Q.vocabulary("word_bpe_49k.json")
    rng = random.Random(3)
    noise = ["".join(rng.choices("aA'sé́İς.,!?|<>\n\t   𝒜1二", k=40)) for _ in range(300)]
    texts = ["" if t is None else t for t in ODD] + noise
    ids, bounds, _ = encode_texts(as_text(pa.array(texts)), path, 2)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*load_tokenizer(path).encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_ids_of_letters_and_signs_before_punctuation():
    path = Q.vocabulary("word_bpe_49k.json")
    firsts = [*map(chr, range(0xC0, 0x100)), "a", "Z"]  # with the signs of multiplication and division
    texts = ["3\u00d7(4+5)", "6\u00f7(2)"] + [f"x {c}{p}(y {c}{p} 3{c}{p}z" for c in firsts for p in '.,!?;:*$%&#"()']
    ids, bounds, _ = encode_texts(as_text(pa.array(texts)), path, 2)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*load_tokenizer(path).encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_ids_of_random_texts_of_all_scripts():
    path = Q.vocabulary("word_bpe_49k.json")
    rng = random.Random(31)
    scripts = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x590), (0x590, 0x700), (0x900, 0xE80), (0x1E00, 0x2070), (0x2070, 0x2300), (0x3000, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F600, 0x1F640)]
    texts = []
    for _ in range(20_000):
        ranges = rng.choices(scripts, k=2)
        texts.append("".join(rng.choice("aA .,!?;:*$%&#\"()\u00d7\u00f7 \n") if rng.random() < 0.5 else chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(30))))
    ids, bounds, _ = encode_texts(as_text(pa.array(texts)), path, 2)
    for t, e, a, b in zip(texts, load_tokenizer(path).encode_batch(texts, add_special_tokens=False), bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*e.ids, 2], repr(t)


def test_ids_by_a_tokenizer_of_another_kind():
    path = Q.vocabulary("byte_bpe_50k.json")
    assert not drops_white_space(path) and drops_white_space(Q.vocabulary("word_bpe_49k.json"))
    texts = ["One  Two.\n Three!", "", " x", "3\u00d7(4)"]
    ids, bounds, ends = encode_texts(as_text(pa.array(texts)), path, 7)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == [*load_tokenizer(path).encode(t, add_special_tokens=False).ids, 7]
    assert load_tokenizer(path).decode(ids[: ends[0]].tolist()) == "One  Two."


def test_cache_is_bounded_by_characters():
    cache = PieceCache(lambda pieces: [p.encode() for p in pieces], limit=1000, characters=5000)
    for k in range(200):
        given = [f"{k}-{j}" * 10 for j in range(20)] + ["long" * 200]
        assert cache.look_up(given) == [g.encode() for g in given]
        assert sum(map(len, [*cache.young, *cache.old])) < 3 * 5000 and not any(len(p) > 256 for p in cache.young)


def test_token_counts(spark, tables):
    path = Q.vocabulary("byte_bpe_50k.json")
    rng = random.Random(4)
    noise = ["".join(rng.choices("aB'sé́.,!?|<>\n\t    \x1c\x85𝒜1二", k=40)) for _ in range(200)]
    rows = odd_docs(spark, noise)
    expected = Counter((r.doc_id, len((r.text or "").encode()), n, n > 5) for r in rows.collect() for n in [len(load_tokenizer(path).encode(r.text or "", add_special_tokens=False).ids)])
    assert Counter(map(tuple, count_tokens(rows, path, 5).collect())) == expected
    docs = {r.doc_id: r.text for r in documents(spark, tables).collect()}
    for r in Q.op10_token_counts(spark, tables).collect():
        assert r.n_tokens == len(load_tokenizer(path).encode(docs[r.doc_id], add_special_tokens=False).ids)
    assert count_tokens(empty_docs(spark), path).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    path, directory = Q.vocabulary("word_bpe_49k.json"), str(tmp_path / "tokens")
    rows = odd_docs(spark, ["one two three " * 900, "tail"])
    files = write_token_files(rows, path, directory, 2, sequence=64)
    got = sorted(read_token_files(files, directory).collect(), key=lambda r: r.start)
    expected, at = [], 0
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*load_tokenizer(path).encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert list(map(tuple, got)) == expected
    for f in files.collect():
        with pa.memory_map(f"{f.path}.arrow") as source:
            table = pa.ipc.open_file(source)
            batches = [table.get_batch(k) for k in range(table.num_record_batches)]
            assert table.schema.field("ids").type.list_size == 64
            assert sum(sum(map(sum, b.column(1).to_pylist())) for b in batches) == f.n_tokens
    assert write_token_files(empty_docs(spark), path, str(tmp_path / "none"), 2).count() == 0


def check_packed(rows, pieces, path, end_id, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    assert sum(p.length for p in pieces) == sum(len(load_tokenizer(path).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
    for doc_id, text in rows:
        ids = np.array([*load_tokenizer(path).encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        mine = sorted((p for p in by_doc[doc_id, len(ids)]), key=lambda p: p.start)
        seen = {(p.start, p.length, p.ids_crc32) for p in mine}
        at = 0
        while at < len(ids):
            at = next(s + n for s, n, crc in seen if s == at and zlib.crc32(ids[s : s + n].tobytes()) == crc)
    return by_sequence


def test_packing(spark, tables):
    path = Q.vocabulary("word_bpe_49k.json")
    rows = [(r.doc_id, r.text) for r in documents(spark, tables).collect()]
    sequences = check_packed(rows, Q.op4_packing(spark, tables).collect(), path, 1, 2048)
    sizes = [sum(p.length for p in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding < 0.02 * sum(sizes)
    odd = odd_docs(spark, ["many words and no stop " * 300])
    check_packed([(r.doc_id, r.text) for r in odd.collect()], pack(odd, path, 1, 128).collect(), path, 1, 128)
    assert pack(empty_docs(spark), path, 1).count() == 0


def test_window_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        positions = np.array(sorted({0, *rng.sample(range(1, 60), 12), 60}))
        while max(np.diff(positions)) > 16:
            positions = np.union1d(positions, [rng.randrange(60)])
        costs = np.array([rng.choice([0, 3, 9]) for _ in positions])
        best = {0: 0}
        for j in range(1, len(positions)):
            best[j] = min(best[i] + 16 - (positions[j] - positions[i]) + costs[j] for i in range(j) if positions[j] - positions[i] <= 16)
        cuts = window_cuts(positions, costs, 16).tolist()
        charge = dict(zip(positions.tolist(), costs.tolist(), strict=True))
        assert sum(16 - (b - a) + charge[b] for a, b in zip(cuts, cuts[1:])) == best[len(positions) - 1]


# -- near duplicates --------------------------------------------------------------------------------


def brute_components(rows, width, percent=80):
    sets, parent = {}, {}
    for k, (doc_id, text) in enumerate(rows):
        w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent.setdefault(doc_id, doc_id)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:k]):
            if a is not None and b is not None and sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= percent * len(sets[k] | sets[j]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return Counter((doc_id, len(sets[k]), None if doc_id is None else root(doc_id), doc_id is None or root(doc_id) == doc_id) for k, (doc_id, _) in enumerate(rows))


def copies(seed):
    """A chain of near copies, star-shaped groups on both sides of the threshold, and exact copies."""
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randrange(30, 120))]
        current = base
        for _ in range(12):
            source = current if rng.random() < 0.4 else base
            current = [w if rng.random() > rng.choice([0.0, 0.02, 0.06, 0.12]) else str(rng.randrange(30)) for w in source]
            out.append(" ".join(current))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("batch_rows", [1, 3, 10_000])
def test_bucket_links_by_batches(spark, batch_rows):
    """Links, members of crowded buckets and edges, whatever batches a partition comes in."""
    rng = random.Random(batch_rows)
    rows = sorted((key, node) for key in range(30) for node in rng.sample(range(100), rng.choice((1, 1, 2, 2, 3, 4, 9))))
    given = spark.createDataFrame(rows, "key long, node long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        found = minhash._bucket_links(given, len(rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    buckets = defaultdict(list)
    for key, node in rows:
        buckets[key].append(node)
    edges = defaultdict(set)
    for r in found:
        if r.kind == minhash._EDGE:
            edges[r.key].add(r.a)
    links = {(r.key, r.a, r.b) for r in found if r.kind == minhash._LINK}
    crowd = Counter((r.key, r.a) for r in found if r.kind == minhash._CROWD)
    assert set(crowd.values()) == {1}
    for key, nodes in buckets.items():
        joined = {min(nodes)}  # by links, and by the least members of the parts of a bucket over partitions
        for _ in nodes:
            joined |= {b for k, a, b in links if k == key and a in joined} | (edges[key] if edges[key] & joined else set())
        assert joined == set(nodes)
        if len(nodes) >= 3:
            assert {n for k, n in crowd if k == key} == set(nodes)


def test_rows_that_share_an_id_are_one_document(spark):
    t, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "tuv")
    rows = [(1, t), (5, t), (5, u), (7, u), (7, v), (9, v), (9, v), (9, None), (None, t), (11, "x y z"), (11, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone_id", F.lit("clash")).withColumn("rows", F.lit(2))
    got = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, None if d is None else 11 if d == 11 else 1) for d, _ in rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, t), (None, t), (11, "x y z")])


@pytest.mark.parametrize("width, seed", [(2, 1), (5, 2)])
def test_near_duplicates(spark, width, seed):
    rows = odd_docs(spark, copies(seed))
    expected = brute_components([(r.doc_id, r.text) for r in rows.collect()], width)
    assert Counter(map(tuple, near_duplicates(rows, Settings(words=width)).collect())) == expected


def test_pairs_at_the_threshold(spark):
    """Pairs of similarity 80/100 are linked, pairs of 79/101 are not."""
    rows, expected = [], {}
    for k in range(400):
        common, own = (80, 10) if k % 2 else (79, 11)
        shared = [f"s{k}_{j}" for j in range(common)]
        for side in (0, 1):
            rows.append((2 * k + side, " ".join(shared + [f"o{k}_{side}_{j}" for j in range(own)])))
            expected[2 * k + side] = 2 * k if k % 2 else 2 * k + side
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Settings(words=1))
    assert {r.doc_id: r.component_id for r in got.collect()} == expected


def test_near_duplicates_of_the_table(spark, tables):
    rows = [(r.doc_id, r.text) for r in documents(spark, tables).collect()]
    assert Counter(map(tuple, Q.op1_minhash_dedup(spark, tables).collect())) == brute_components(rows, 2)
    assert near_duplicates(empty_docs(spark)).count() == 0 and keep_one(empty_docs(spark)).count() == 0


# -- substrings -------------------------------------------------------------------------------------


def brute_repeats(rows, width):
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for k in range(len(w) - width + 1):
            if doc_id is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = Counter()
    for doc_id, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - width + 1):
            if doc_id is not None and first[tuple(w[k : k + width])] < doc_id:
                gone.update(range(k, k + width))
        out[doc_id, None if text is None else " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)] += 1
    return out


@pytest.mark.parametrize("width", [1, 2, 7, 50])
def test_remove_repeats(spark, width):
    rng = random.Random(width)
    shared = [" ".join(rng.choices("abcdefg", k=60)) for _ in range(3)]
    extra = [" ".join([*rng.choices("hijklm", k=rng.randrange(40)), rng.choice(shared), *rng.choices("nop", k=rng.randrange(20)), rng.choice(shared)]) for _ in range(25)] + ["und " * 200] * 2
    rows = odd_docs(spark, extra)
    kept, (n_words, n_removed) = remove_repeats(rows, width, collapse=True)
    got = Counter((r.doc_id, r.text, r[n_words], r[n_removed]) for r in kept.collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in rows.collect()], width)
    assert kept.columns[: len(rows.columns)] == rows.columns


def test_substring_dedup_of_the_table(spark, tables):
    rows = [(r.doc_id, r.text) for r in documents(spark, tables).collect()]
    expected = Counter((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, g in brute_repeats(rows, 50).elements())
    assert Counter(map(tuple, Q.op7_substring_dedup(spark, tables).collect())) == expected
    assert remove_repeats(empty_docs(spark))[0].count() == 0


# -- quality ----------------------------------------------------------------------------------------


def brute_statistics(text):
    w = words(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(covered)


def test_quality_statistics_and_verdicts(spark, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = odd_docs(spark, ["a b c a b c a b", "x x x x x", "l one\nl one\n \n \nl one", "tail a b c " * 40])
    judged, _ = judge(rows, labels)
    for docs, result in ((rows, judged), (documents(spark, tables), Q.op8_quality_rules(spark, tables))):
        expected = Counter()
        for r in docs.collect():
            s = brute_statistics(r.text)
            expected[(r.doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
        got = result.collect()
        assert Counter(tuple(r)[:7] for r in got) == expected
        assert not any(r.kept and r.base_failed for r in got)
    assert judge(empty_docs(spark), labels)[0].count() == 0


def test_learned_rules_separate_held_out_labels(spark):
    tables = "/root/testdata/sf0.1"
    docs, labels = documents(spark, tables), spark.read.parquet(f"{tables}/labels.parquet")
    some = labels.where(F.xxhash64("doc_id") % 2 == 0)
    judged, rules = judge(docs, some)
    assert rules.rules
    rest = judged.join(labels.where(F.xxhash64("doc_id") % 2 != 0), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in rest}
    assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) <= 0.1 * counts[0, False]


def test_no_labels_keep_what_the_base_rule_keeps(spark):
    rows, labels = odd_docs(spark, ["w%d " % 1 + " ".join(f"w{k}" for k in range(80))]), spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = judge(rows, labels)
    assert not rules.rules and all(r.kept != r.base_failed for r in judged.collect())
    assert keep_good(rows, labels).columns == rows.columns and keep_good(rows, labels).count() == 1


# -- very long texts --------------------------------------------------------------------------------


def test_a_very_long_text_and_its_copy(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, "short text of six words here"), (3, long + " end")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    kept, (n_words, n_removed) = remove_repeats(docs)
    assert {r.doc_id: (r[n_words], r[n_removed]) for r in kept.collect()} == {1: (120_000, 0), 2: (6, 0), 3: (120_001, 120_000)}
    judged, _ = judge(docs, labels)
    assert {r.doc_id: r.n_words for r in judged.collect()} == {1: 120_000, 2: 6, 3: 120_001}
    path = Q.vocabulary("word_bpe_49k.json")
    pieces = pack(docs, path, 1).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r.n == r["all"] for r in pieces) and len(pieces) == 3
    counts = {r.doc_id: r for r in count_tokens(docs, Q.vocabulary("byte_bpe_50k.json")).collect()}
    assert counts[1].n_bytes == len(long) and counts[1].over_limit and not counts[2].over_limit


@pytest.mark.parametrize("width", [1, 7, 50])
def test_remove_repeats_with_a_distributed_sketch(spark, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MOST_CELLS", 0)
    monkeypatch.setattr(substring_dedup, "CHUNK", 4)
    rng = random.Random(width)
    shared = [" ".join(rng.choices("abcdefg", k=60)) for _ in range(3)]
    extra = [" ".join([*rng.choices("hijklm", k=rng.randrange(40)), rng.choice(shared), *rng.choices("nop", k=rng.randrange(20)), rng.choice(shared)]) for _ in range(25)] + ["und " * 200] * 2
    rows = odd_docs(spark, extra)
    rows = rows.union(rows.where("doc_id % 5 = 3"))  # rows with equal ids and texts
    kept, (n_words, n_removed) = remove_repeats(rows, width, collapse=True)
    got = Counter((r.doc_id, r.text, r[n_words], r[n_removed]) for r in kept.collect())
    assert got == brute_repeats([(r.doc_id, r.text) for r in rows.collect()], width)
    assert remove_repeats(empty_docs(spark))[0].count() == 0
