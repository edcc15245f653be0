"""Operators on pages and benchmarks, and the pipeline."""

import hashlib
import html as html_lib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from fareloom.llm import decontamination, html_extract, language_id, queries as Q
from fareloom.llm.decontamination import contaminated_pairs, drop_contaminated, greedy_tiles
from fareloom.llm.html_blocks import page_blocks
from fareloom.llm.html_extract import extract, repeated_tokens, suffix_ranks
from fareloom.llm.language_id import identify
from fareloom.llm.textwords import as_text
from fareloom.llm.warc import read_archives, read_records, write_archives

PAGES = "page_id long, url string, html string"


def pages(spark, tables):
    return spark.read.parquet(f"{tables}/pages.parquet")


def odd_pages(spark, extra=()):
    rows = [(1, "http://a.b/c", None), (2, None, ""), (3, "not a url", "plain < text & more"), (None, "http://a.b/", "<p>x"), (3, "http://a.b/2", "<p>x"), (4, "http://a.b/3", "<div>" * 3000 + "deep"), *extra]
    return spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1))


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 80)
    for depth in (1, 2, 3, 5, 8):
        order, rank = suffix_ranks(tokens, depth)
        key = [tuple(tokens[k : k + depth]) for k in range(80)]
        assert [key[k] for k in order] == sorted(key)
        assert len(set(zip(key, rank.tolist(), strict=True))) == len(set(key)) == len(set(rank.tolist()))


def test_repeated_tokens_against_counting():
    rng = np.random.default_rng(2)
    tokens, page = rng.integers(0, 4, 300), np.sort(rng.integers(0, 12, 300))
    for depth, needed in ((2, 3), (3, 2), (4, 3)):
        runs = {}
        for k in range(300 - depth + 1):
            if page[k] == page[k + depth - 1]:
                runs.setdefault(tuple(tokens[k : k + depth]), set()).add(page[k])
        expected = np.zeros(300, bool)
        for k in range(300 - depth + 1):
            if page[k] == page[k + depth - 1] and len(runs[tuple(tokens[k : k + depth])]) >= needed:
                expected[k : k + depth] = True
        assert (repeated_tokens(tokens, page, page, np.full(300, needed), depth) == expected).all()


def test_blocks_leave_out_what_is_not_text():
    page = """<html lang="de"><head><title>t</title></head><body><header>top</header><nav><ul><li>menu</ul></nav><div class="cookie-notice">we use</div>
    <main><h1>Head&auml;r</h1><p>One <b>two</b> &amp;
    three<br>four<p>five<div id="comments"><p>nice!</div><form>mail</form><aside>side</aside><script>if (a < b) "</p>"</script></main><footer>foot</footer>"""
    blocks, language = page_blocks(page)
    assert [t for t, _ in blocks] == ["Headär", "One two & three four", "five"] and language == "de"
    assert page_blocks("<p>one <script>x</script>two<style>y</style></p>three <script>z")[0] == [("one two", 0), ("three", 0)]
    assert page_blocks("<nav>unclosed <article>text</article>")[0] == [("text", 1)]


def test_text_outside_articles_stays_and_dropped_articles_go():
    texts = lambda html: [t for t, _ in page_blocks(html)[0]]
    post = "<div class='post-content'><p>the post itself, a long text</p></div>"
    assert texts(post + "<section class='related'><article>teaser</article></section>") == ["the post itself, a long text"]
    assert texts(post + "<div id='comments'><article class='comment-body'>nice</article></div>") == ["the post itself, a long text"]
    assert texts(post + "<div><article class='comment'>nice</article><article id='user-comment-2'>so</article></div>") == ["the post itself, a long text"]
    assert texts(post + "<footer><article>teaser</article></footer><nav><main>menu</main></nav><div role='search'><main>x</main></div>") == ["the post itself, a long text"]
    assert page_blocks(post + "<article>teaser</article>")[0] == [("the post itself, a long text", 0), ("teaser", 0)]
    assert page_blocks("<p>lead</p><article>the article itself</article><p>end</p>")[0] == [("lead", 0), ("the article itself", 1), ("end", 0)]
    assert texts("<main class='has-sidebar'><article class='post tag-cookie'>text</article></main>") == ["text"]
    assert texts("<form><main>whole page</main></form>") == ["whole page"]
    assert texts("<head><title>t</title><nav>menu<article>one</article><nav>x</nav>") == ["one"]
    assert texts("<head><body><main>text</main></body></head>") == ["text"]


def test_class_names_count_by_their_nouns():
    texts = lambda html: [t for t, _ in page_blocks(html)[0]]
    for name in ("layout has-sidebar", "skip-intro", "promo-free", "no-comments", "loading", "header-image-caption", "navy"):
        assert texts(f"<div class='{name}'>text</div>") == ["text"], name
    for name in ("ad", "ad-slot", "top ad_300x250", "comment-body", "related-posts", "siteFooter", "main-nav", "cookie-notice", "sponsored-content", "search-form"):
        assert texts(f"<div class='{name}'>text</div><p>rest") == ["rest"], name
    assert texts("<article><h1 class='entry-header'>title</h1><div class='entry-header'>by</div><p>text</article>") == ["title", "by", "text"]
    assert texts("<h1 class='page-header'>title</h1><div class='page-header'>top</div>text <span class='ad'>buy</span> more") == ["title", "text", "more"]


def test_names_of_layout_do_not_swallow_the_text():
    texts = lambda html: [t for t, _ in page_blocks(html)[0]]
    long, other = (" ".join(f"{w}{k}" for k in range(80)) for w in "wv")
    wraps = ["<div class='sidebar-right'><article>{}</article></div>", "<div id='page' class='layout sidebar-left'><main>{}</main></div>", "<div id='search-content'><article>{}</article></div>", "<div class='story-promo'><article>{}</article></div>"]
    wraps += ["<div class='story-promo'><p>{}</p></div>", "<section class='article-notice'><p>{}</p></section>", "<article class='post share'>{}</article>", "<div class='sidebar-left'><div class='sidebar-right'><p>{}</p></div></div>", "<div class='modal'><div class='header'>{}</div></div>"]
    for wrap in wraps:
        assert texts(f"<h1>Title</h1>{wrap.format(long)}") == ["Title", long], wrap
        assert texts(f"{wrap.format(long)}<div id='comments'><p>{other} {other}</p></div>") == [long], wrap
        assert texts(wrap.format(f"<p>{long}</p><div class='ad'>buy</div><div class='sidebar'>other stories of today</div>")) == [long], wrap
        # the other way round: the same names on something small, or beside the article, mark it
        assert texts(f"<div class='text'><p>{long}</p></div>{wrap.format('twenty')}") == [long], wrap
        assert texts(f"<article>{long}</article>{wrap.format(other).replace('article>', 'div>').replace('main>', 'div>').replace('<article', '<div')}") == [long], wrap
    assert texts(f"<main><p>{long}</p></main><div class='comments'><p>{other} {other}</p></div>") == [long]
    assert texts(f"<div class='ad'>{long}</div><p>some text here") == ["some text here"]


def test_comments_by_role_and_type():
    texts = lambda html: [t for t, _ in page_blocks(html)[0]]
    for mark in ("class='reply'", "class='discussion'", "id='replies'", "role='comment'", "itemprop='comment'", "itemscope itemtype='https://schema.org/Comment'", "class='reader-responses'"):
        assert texts(f"<article><p>the text itself</p><div {mark}><p>well said</p></div></article>") == ["the text itself"], mark
    assert texts("<article><p class='reply-free'>the text</p><p itemtype='https://schema.org/CreativeWork'>itself</p></article>") == ["the text", "itself"]


def test_end_tags_that_are_left_out():
    texts = lambda html: [t for t, _ in page_blocks(html)[0]]
    assert texts("<p class='ad'>buy<p>one<p class='ad'><b>buy<div>two</div>") == ["one", "two"]
    assert texts("<p class='ad'>buy<article><p>text</article>") == ["text"]
    assert texts("<ul><li class='ad'>buy<li>one<ul><li class='ad'>x</ul>two<li class='ad'>y<p>z<li>three</ul>four") == ["one", "two", "three", "four"]
    assert texts("<dl><dt class='ad'>buy<dd>one<dd class='ad'>x</dl>two") == ["one", "two"]
    assert texts("<table><tr class='ad'><td>buy<td>x<tr><td class='ad'>y<td>one<th>two</table>three") == ["one", "two", "three"]
    assert texts("<div class='ad'><p>buy<p>more</div><p>one<svg/>two") == ["one", "two"]


def test_deep_pages_with_stray_tags_are_quick():
    started = time.monotonic()
    assert page_blocks("<div>" * 30_000 + "<li>x</b>" * 30_000)[0] == [("x", 0)] * 30_000
    assert time.monotonic() - started < 10


def test_menus_without_marks_and_pages_that_would_be_empty():
    texts = lambda html: [t for t, _ in page_blocks(html)[0]]
    links = "".join(f"<li><a href='/{k}'>entry {k}</a>" for k in range(4))
    assert texts(f"<ul>{links}</ul><p>a <a>link</a> in a text</p><p><a>one link</a></p>") == ["a link in a text", "one link"]
    assert texts(f"<article><p>text of some length, more than the links in it, by far</p><ul>{links}</ul></article>")[1:] == [f"entry {k}" for k in range(4)]
    long = " ".join(f"w{k}" for k in range(80))
    assert texts(f"<div class='page-banner'><p>{long}</p></div>") == [long]
    assert texts("<div class='ad'>buy</div>") == [] and texts(f"<div class='ad'>{long}</div><p>text") == ["text"]


def test_repeated_lines_of_articles_stay(spark):
    """Lines that several articles of a host have in common are text of each."""
    line = "the and attion to the other line of eight words"
    rows = [(k, f"http://h.example/{k}", f"<nav>menu</nav><article><h1>t{k}</h1><p>{line}</p><p>own {k}</p><p>{line}</p></article>") for k in range(8)]
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, PAGES)).collect()} == {k: f"t{k} {line} own {k} {line}" for k in range(8)}


def test_extraction_of_the_table(spark, tables):
    got = {r.page_id: r for r in Q.op5_html_extraction(spark, tables).collect()}
    for p in pages(spark, tables).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        expected = " ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (expected, len(expected), p.url)


def test_marked_text_stays_apart():
    page = "<head><title>t</title></head><nav>menu <a>x</a></nav><p>one</p><footer>end<script>s</script></footer><div class='ad'>buy</div><aside><article>teaser</article></aside><p>two"
    assert page_blocks(page, marked=True)[0] == [("menu x", 2), ("one", 0), ("end", 2), ("buy", 2), ("teaser", 2), ("two", 0)]
    assert page_blocks(page)[0] == [("one", 0), ("two", 0)]


def test_what_other_pages_mark_goes_without_marks(spark, monkeypatch):
    """A footer that most pages mark is found where it isn't marked; text in front of it stays, however often it stands there."""
    foot = "all rights reserved by the owners of this fine site"
    marked = [(k, f"http://h.example/{k}", f"<p>text {k} of page {k} the end</p><footer>{foot}</footer>") for k in range(8)]
    plain = [(k, f"http://h.example/{k}", f"<p>text {k} of page {k} the end</p><p>{foot}</p>") for k in range(8, 10)]
    other = [(10, "http://i.example/", f"<p>{foot}</p>")]
    expected = {k: f"text {k} of page {k} the end" for k in range(10)} | {10: foot}
    table = spark.createDataFrame(marked + plain + other, PAGES)
    assert {r.page_id: r.text for r in extract(table).collect()} == expected
    for name, value in (("GROUP_BYTES", 300), ("PART_PAGES", 3)):
        monkeypatch.setattr(html_extract, name, value)
    assert {r.page_id: r.text for r in extract(table).collect()} == expected


def test_boilerplate_of_a_host_goes_and_unique_runs_stay(spark):
    rng = random.Random(3)
    share = "read more about our partners and their many great offers"
    plain = [(k, "http://h.example/%d" % k, f"<p>{' '.join(str(rng.random()) for _ in range(15))}</p><div>{share}</div>") for k in range(10, 20)]
    inside = [(k, "http://i.example/%d" % k, f"<article><p>{' '.join(str(rng.random()) for _ in range(60))}</p><p>{share}</p></article>") for k in range(20, 30)]
    twice = " ".join(str(rng.random()) for _ in range(80))
    mirrored = [(k, "http://m.example/%d" % k, f"<article><p>{twice}</p></article>") for k in range(30, 40)]
    rows = odd_pages(spark, plain + inside + mirrored)
    got = Counter()
    for r in extract(rows).collect():
        got[r.page_id, r.text] += 1
        if r.page_id and 10 <= r.page_id < 30:
            assert (share in r.text) == (r.page_id >= 20) and len(r.text.split()) >= 15
        if r.page_id and r.page_id >= 30:
            assert r.text == twice
    assert got[1, ""] == got[2, ""] == 1 and got[3, "plain < text & more"] == 1 and got[None, "x"] == 1 and got[3, "x"] == 1 and got[4, "deep"] == 1
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_boilerplate_counts_over_all_pages_of_a_large_host(spark, monkeypatch):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    some = [words(30) for _ in range(6)]
    rows = []
    for host, n, length in (("few.example", 3, 400), ("long.example", 20, 500), ("skew.example", 40, 60), ("small.example", 5, 20)):
        for k in range(n):
            length_here = 4000 if (host, k) == ("skew.example", 0) else length
            used = [t for j, t in enumerate(some) if (k + j) % (j + 1) == 0]
            rows.append((len(rows), f"http://{host}/{k}", f"<p>{words(length_here)}</p>" + "".join(f"<div>{t} {words(9)}</div>" for t in used)))

    def brute_force(of_host, depth=8):
        tokens = {r[0]: re.sub("<[^>]*>", " ", r[2]).split() for r in of_host}
        runs = {}
        for p, t in tokens.items():
            for k in range(len(t) - depth + 1):
                runs.setdefault(tuple(t[k : k + depth]), set()).add(p)
        needed = max(3, -(-len(tokens) // 5))
        out = {}
        for p, t in tokens.items():
            gone = {k + j for k in range(len(t) - depth + 1) if len(runs[tuple(t[k : k + depth])]) >= needed for j in range(depth)}
            out[p] = " ".join(w for k, w in enumerate(t) if k not in gone)
        return out

    expected = {}
    for host in {r[1].split("/")[2] for r in rows}:
        expected |= brute_force([r for r in rows if r[1].split("/")[2] == host])
    table = spark.createDataFrame(rows, PAGES)
    monkeypatch.setattr(html_extract, "GROUP_BYTES", 2000)
    for name, value in (("PART_BYTES", 1500), ("PART_PAGES", 4)):
        monkeypatch.setattr(html_extract, name, value, raising=False)
        assert {r.page_id: r.text for r in extract(table).collect()} == expected


def test_pages_with_one_payload_are_archived_by_several_tasks(spark, tmp_path):
    hot = "<p>" + "the same page of a soft error " * 60
    rows = spark.createDataFrame([(k, f"u{k}", hot if k % 2 else f"{hot} {k} {'x' * 900}") for k in range(2000)], PAGES).repartition(8)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        parts = [r.n_records for r in write_archives(rows, str(tmp_path / "w")).collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(parts) >= 2000 and max(parts) < 800


def test_archives_round_trip(spark, tables, tmp_path):
    big = "<p>" + "long payload é " * 100
    rows = odd_pages(spark, [(7, "u7", big), (8, "u8\r\nX: y", big), (9, "u9", big), (None, "n", big), (10, "a", "short"), (11, "b", "short")])
    archives = write_archives(rows, str(tmp_path / "w"))
    got = read_archives(archives, str(tmp_path / "w")).collect()
    expected = Counter()
    for r in rows.collect():
        payload = (r.html or "").encode()
        of = 9 if r.html == big and r.page_id in (7, 8) else None
        expected[r.page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if of else "response", of, None if of else payload] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == expected
    for a in archives.collect():  # every record is a frame of its own behind the dictionary
        data = open(a.path, "rb").read()
        size = int.from_bytes(data[4:8], "little")
        reader, rest, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), data[8 + size :], 0
        while rest:
            frame = reader.decompressobj()
            assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = frame.unused_data, n + 1
        assert n == a.n_records
        with open(a.path, "rb") as f:
            assert sum(1 for _ in read_records(f)) == n
    assert write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "e")).count() == 0
    table = {r.page_id: r for r in Q.op6_warc(spark, tables).collect()}
    assert all(table[p.page_id].payload_digest == hashlib.sha1(p.html.encode()).hexdigest() for p in pages(spark, tables).collect())


# -- contamination ----------------------------------------------------------------------------------


def plain_tiles(pattern, text, least):
    """The longest unmarked match again and again, by trying every pair of places."""
    used, taken, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(pattern)):
            for j in range(len(text)):
                n = 0
                while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and i + n not in used and j + n not in taken:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sum(t[2] for t in tiles)
        used.update(range(i, i + n)), taken.update(range(j, j + n)), tiles.append((i, j, n))


def test_tiles_cover_what_plain_search_covers():
    rng = random.Random(5)
    for n in range(200):
        letters = 2 + n % 5
        pattern = [1 + rng.randrange(letters) for _ in range(rng.randrange(2, 30))]
        parts = [pattern[a : a + rng.randrange(2, 12)] for a in rng.choices(range(len(pattern)), k=3)]
        text = [x for p in parts for x in [rng.randrange(letters + 1), *p]]  # 0 matches nothing
        tiles = greedy_tiles(pattern, text, 3)
        for i, j, n in tiles:
            assert pattern[i : i + n] == text[j : j + n] and n >= 3
        assert len({k for i, _, n in tiles for k in range(i, i + n)}) == sum(n for _, _, n in tiles)
        assert sum(t[2] for t in tiles) == plain_tiles(pattern, text, 3)


def test_tiling_of_repetitive_and_long_texts_is_quick():
    began = time.time()
    assert greedy_tiles([1] * 400, [1] * 1600, 4) == [(0, 0, 400)]
    assert time.time() - began < 1
    rng = random.Random(6)
    pattern = [rng.choice((1, 2)) for _ in range(300)]
    text = [rng.choice((1, 2)) for _ in range(60_000)]
    assert sum(t[2] for t in greedy_tiles(pattern, text, 4)) > 250
    assert greedy_tiles([1] * 100, [1] * 200_000, 4)[0] == (0, 0, 100)
    assert time.time() - began < 30


def test_contamination(spark, tables, monkeypatch):
    docs, items = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    passages = {r.item_id: r.text for r in items.collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, p in passages.items() if p in t}
    found = {(r.doc_id, r.item_id) for r in Q.op2_decontamination(spark, tables).collect()}
    assert verbatim and found == verbatim
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi"
    w = item.split()
    rows = [(1, "x " + " ".join(w[8:]) + " y z " + " ".join(w[:8])), (2, " ".join(w[::-1])), (3, None), (4, ""), (None, item.upper() + "!"), (1, "clean"), (5, " ".join(w[:4]))]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, "a b"), (11, None)], "item_id long, text string")
    expected = [(None, 9, 16, 16, 1, 16), (1, 9, 16, 16, 2, 8)]
    assert sorted(map(tuple, contaminated_pairs(small, bench).collect()), key=repr) == sorted(expected, key=repr)
    kept = Counter(map(tuple, drop_contaminated(small, bench).collect()))
    assert kept == Counter(rows) - Counter([rows[0], rows[4]])
    assert contaminated_pairs(small.limit(0), bench).count() == 0 and drop_contaminated(small, bench.limit(0)).count() == len(rows)
    bench = spark.createDataFrame([(9, item), (10, "a b"), (11, None), (None, item), (9, item), (12, ""), (13, "x " * 50), (14, " ".join(w[:9]))], "item_id long, text string")
    many = spark.createDataFrame([*rows, rows[0], (1, "x " * 40 + "y"), (None, None)], "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("_gone_id", F.lit(1))
    both = []
    for bound in (decontamination.MOST_BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontamination, "MOST_BROADCAST_BYTES", bound)
        kept = drop_contaminated(many, bench)
        assert kept.columns == many.columns
        assert contaminated_pairs(small.limit(0), bench).count() == 0 and drop_contaminated(small, bench.limit(0)).count() == len(rows)
        both.append((Counter(map(tuple, contaminated_pairs(many, bench).collect())), Counter(map(tuple, kept.collect()))))
    assert both[0] == both[1] and both[0][0][1, 9, 16, 16, 2, 8] == 4 and both[0][0][None, None, 16, 16, 1, 16] == 1
    on_table = Counter(map(tuple, contaminated_pairs(docs, items).collect()))  # by the join
    assert on_table == Counter(tuple(r)[:6] for r in Q.op2_decontamination(spark, tables).collect()) and {(r[0], r[1]) for r in on_table} == verbatim


def test_pairs_against_plain_tiling(spark):
    """Reordered, cut and mixed passages: every pair's coverage by plain greedy tiling."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    opening = rng.choices(vocabulary, k=6)
    items = [[*opening, *rng.choices(vocabulary, k=rng.randrange(3, 30))] for _ in range(12)]
    texts = []
    for _ in range(60):
        out = rng.choices(vocabulary, k=rng.randrange(20))
        for _ in range(rng.randrange(4)):
            item = rng.choice(items)
            a = rng.randrange(len(item))
            out += item[a : a + rng.randrange(2, 25)] + rng.choices(vocabulary, k=rng.randrange(4))
        texts.append(out)
    code = {w: k + 1 for k, w in enumerate(vocabulary)}
    expected = {}
    for d, t in enumerate(texts):
        for k, i in enumerate(items):
            covered = plain_tiles([code[x] for x in i], [code[x] for x in t], 4)
            if covered >= 0.5 * len(i) and covered:
                expected[d, k] = covered
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    assert expected and {(r.doc_id, r.item_id): r.covered_tokens for r in contaminated_pairs(docs, bench).collect()} == expected


# -- language ---------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark, tables):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 100")
    as_pages = rest.selectExpr("doc_id AS page_id", "concat('http://', source, '.example.com/', doc_id) AS url", "concat('<p>', replace(replace(text, '&', ' '), '<', ' ')) AS html", "lang AS truth")
    got = identify(as_pages, train).join(as_pages.select("page_id", "truth"), "page_id")
    right = got.where("lang = truth").count() / got.count()
    assert right > 0.97
    assert all(r.lang == r.url.split("/")[3] for r in Q.op3_language_id(spark, tables).collect())


def test_language_falls_back_on_the_other_evidence(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    train = spark.createDataFrame([(" ".join(word("abcde") for _ in range(60)), "aa") for _ in range(30)] + [(" ".join(word("vwxyz") for _ in range(60)), "zz") for _ in range(30)], "text string, lang string")
    known = [(k, f"http://site.z/{k}", f"<html lang='zz-Q'><p>{' '.join(word('vwxyz') for _ in range(40))}") for k in range(100, 120)]
    known += [(k, f"http://site.a/{k}", f"<html lang='aa'><p>{' '.join(word('abcde') for _ in range(40))}") for k in range(120, 140)]
    rows = odd_pages(spark, [*known, (50, "http://site.z/n", ""), (51, "http://site.a/n", None)])
    got = identify(rows, train).collect()
    assert len(got) == rows.count()
    by = {r.page_id: r.lang for r in got}
    assert by[50] == "zz" and by[51] == "aa" and by[100] == "zz" and by[130] == "aa"
    assert all(r.lang is None for r in identify(rows, train.limit(0)).collect())
    assert identify(rows.limit(0), train).count() == 0


def test_posterior_against_plain_counting(spark):
    """The whole rule by dictionaries, from the scores of the texts on."""
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    text = lambda k, n: " ".join("".join(rng.choices(alphabets[k], k=4)) for _ in range(n))
    labelled = [(text(k, 20), k) for k in alphabets for _ in range(15)] * 3
    hosts = ["a.x", "b.x", "w.a.x", "v.a.x", "c.y", "d.y", ""]
    rows = []
    for k in range(90):
        lang, host = rng.choice(list(alphabets)), rng.choice(hosts)
        mark = rng.choice([f" lang='{lang}'", " lang='aa-US'", ""])
        rows.append((k, f"http://{host}/{k}" if host else None, f"<html{mark}><p>{text(lang, rng.choice((0, 1, 2)))}"))
    train = spark.createDataFrame(labelled, "text string, lang string")
    languages, logs = language_id.fit_text_model(train)
    got = {r.page_id: r for r in identify(spark.createDataFrame(rows, PAGES), train).collect()}
    votes, scores = {}, {}
    for k, _, html in rows:
        body = re.sub("<[^>]*>", "", html)
        buckets, _ = language_id._trigrams(as_text(pa.array([body])))
        total = sum(logs.astype(np.float32)[:, b].astype(float) for b in buckets) if len(buckets) else np.zeros(3)
        scores[k] = np.round(total * min(1, language_id.FULL_TRIGRAMS / max(1, len(buckets))), 6)
        votes[k] = languages[int(np.argmax(scores[k]))]
    keys = {}
    for k, url, html in rows:
        host = (url or "").split("/")[2] if url else ""
        parts = host.split(".")
        keys[k] = {"host": host, "domain": ".".join(parts[-2:]), "suffix": parts[-1], "markup": (re.findall("lang='(..)", html) or [""])[0]}
    for k, _, _ in rows:
        prior = np.array([(sum(v == lang for v in votes.values()) + 4 / 3) / (len(rows) + 4) for lang in languages])
        for level in ("suffix", "domain", "host"):
            n = np.array([sum(votes[j] == lang and keys[j][level] == keys[k][level] for j in votes if j != k) for lang in languages])
            prior = (n + 4 * prior) / (n.sum() + 4)
        total = scores[k] + np.log(prior)
        for level in ("markup", "suffix"):
            n_keys = len({keys[j][level] for j in votes})
            n = np.array([sum(votes[j] == lang and keys[j][level] == keys[k][level] for j in votes) for lang in languages])
            total = total + np.log((n + 12 / n_keys) / (np.array([sum(v == lang for v in votes.values()) for lang in languages]) + 12))
        posterior = np.exp(total - total.max())
        assert got[k].text_lang == votes[k] and got[k].lang == languages[int(np.argmax(total))]
        assert abs(got[k].confidence - posterior.max() / posterior.sum()) < 2e-4


def test_every_language_is_fitted_and_copies_count_once(spark):
    rng = random.Random(7)
    names = [f"l{k:03d}" for k in range(70)]
    rows = [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=80)), k) for k in names for _ in range(3)]
    languages, logs = language_id.fit_text_model(spark.createDataFrame(rows + [rows[0]] * 500, "text string, lang string"))
    _, plain = language_id.fit_text_model(spark.createDataFrame(rows, "text string, lang string"))
    assert languages == names and np.allclose(logs, plain)


# -- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tables):
    from tests.llm.test_text_operators import brute_components, brute_repeats

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_dedup", "substring_dedup", "decontaminate", "packing"]
    good = stage["quality"](spark, docs, tables)
    judged = {r.doc_id for r in Q.op8_quality_rules(spark, tables).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == judged and good.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in good.collect()]
    one = stage["near_dedup"](spark, good, tables)
    assert {r.doc_id for r in one.collect()} == {d for d, _, _, kept in brute_components(rows, 5) if kept}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    cut = {r.doc_id: r for r in stage["substring_dedup"](spark, one, tables).collect()}
    texts = dict(rows)
    for doc_id, text, n_words, n_removed in brute_repeats(rows, 50):
        if n_removed < n_words:
            assert cut[doc_id].text == (text if n_removed else texts[doc_id]) and cut[doc_id].n_chars == len(cut[doc_id].text)
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0 and {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(cut)


def test_pipeline_stages_on_odd_rows(spark, tables, monkeypatch, tmp_path):
    """Nulls, repeated rows and ids, clashing columns, a very long text and empty tables, stage by stage."""
    from tests.llm.test_text_operators import odd_docs

    rng = random.Random(12)
    good = [" ".join(rng.choices([f"w{k}" for k in range(3000)], k=120)) for _ in range(3)]
    long = " ".join(f"v{rng.randrange(30_000)}" for _ in range(60_000))
    docs = odd_docs(spark, [*good, good[0], good[1] + " tail", long, long])
    docs = docs.union(docs.where("doc_id = 12"))
    for name in ("_judged", "gone_id", "digest", "rows", "tag", "component"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        kept[name] = Counter((r.doc_id, r.text) for r in out.collect())
    all_rows = Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(not rows - all_rows for name, rows in kept.items() if name != "substring_dedup")
    assert {d for d, _ in kept["quality"]} == {11, 12, 13, 14, 15, 16, 17}
    assert sorted(d for d, _ in kept["near_dedup"].elements() if (d or 0) > 10) == [11, 12, 13, 16]  # the repeated row once
    texts = {d: t for d, t in kept["substring_dedup"] if (d or 0) > 10}
    assert texts[15] == "tail" and 17 not in texts and 14 not in texts and len(texts[16].split()) == 60_000
    assert kept["decontaminate"] == all_rows
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == {d for d, _ in all_rows}


def test_very_long_pages(spark, tmp_path):
    rng = random.Random(13)
    body = " ".join(f"w{rng.randrange(40_000)}" for _ in range(150_000))
    rows = [(1, "http://h.example/1", f"<nav>menu</nav><article><p>{body}</p></article>"), (2, "http://h.example/2", "<p>short"), (3, "http://h.example/3", f"<article><p>{body}</p></article>")]
    given = spark.createDataFrame(rows, PAGES)
    assert {r.page_id: r.text for r in extract(given).collect()} == {1: body, 2: "short", 3: body}
    train = spark.createDataFrame([(body[:5000], "ww"), ("zażółć gęślą jaźń " * 20, "pl")], "text string, lang string")
    assert {r.page_id: r.lang for r in identify(given, train).collect()}[1] == "ww"
    archives = write_archives(given, str(tmp_path / "w"))
    assert {r.page_id: bytes(r.payload).decode() for r in read_archives(archives, str(tmp_path / "w")).collect()} == {k: h for k, _, h in rows}
    bench = spark.createDataFrame([(5, " ".join(body.split()[1000:1200]))], "item_id long, text string")
    assert [tuple(r)[:4] for r in contaminated_pairs(spark.createDataFrame([(1, body), (2, "short")], "doc_id long, text string"), bench).collect()] == [(1, 5, 200, 200)]


def test_archives_and_token_files_are_read_back_in_parallel(spark, tmp_path):
    from fareloom.llm.token_files import read_token_files, write_token_files

    rows = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "repeat(concat('text ', id, ' '), 50) AS html").repartition(6)
    archives = write_archives(rows, str(tmp_path / "w"))
    read = read_archives(archives, str(tmp_path / "w"))
    assert archives.count() >= 4 and read.select(F.spark_partition_id()).distinct().count() > 1
    path = Q.vocabulary("word_bpe_49k.json")
    files = write_token_files(rows.selectExpr("page_id AS doc_id", "html AS text"), path, str(tmp_path / "t"), 2)
    tokens = read_token_files(files, str(tmp_path / "t"))
    assert files.count() >= 4 and tokens.select(F.spark_partition_id()).distinct().count() > 1 and tokens.count() == 400
