"""Main text of pages: blocks of the page, less what a suffix array of their host shows to be boilerplate.

The blocks of a host's pages are joined to one token stream. A suffix array of that stream, sorted to the
depth that counts as long, puts equal token runs side by side; a run of ``least_tokens`` tokens or more that
stands on enough distinct pages is repeated: every token that such runs cover goes and the unique runs stay. What
stands inside article and main elements is the text itself: it is in the stream, so that repeats of it elsewhere
are found, but nothing of it goes. What the markup says to be a menu, footer, advert and the like goes in any case;
it is in the stream as well, so that the same text is found on pages whose markup doesn't say so.

Hosts are bundled into groups of about ``GROUP_BYTES``; a larger host is dealt out over several groups by
page, so no group grows with the largest host. Its repeated runs are still those of the whole host: a run on
enough pages of the host is on at least the same share of the pages of some group. The runs that are so in any
group are marked in a bitmap of the host, every group counts its pages of the marked runs, and Spark adds these
up. A full bitmap marks too much, never too little, so the sums are exact.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.html_blocks import CONTENT, MARKED, page_blocks
from fareloom.llm.storage import materialize
from fareloom.llm.textwords import WordBatch, as_text, mix, split_words, window_hashes, word_hashes

GROUP_BYTES = 1 << 20
#: Part of a large host: so many pages on average, unless these are over so many bytes. Many pages leave few
#: runs to count over all parts; what is removed doesn't depend on either.
PART_PAGES, PART_BYTES = 20, 8 << 20
#: Bits of a large host's bitmap.
BITMAP_BITS = 1 << 20
#: Large hosts that may be broadcast (a few dozen bytes each); more are joined by a shuffle.
MOST_BROADCAST_HOSTS = 100_000


def suffix_ranks(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``tokens`` sorted by the first ``depth`` tokens, and the rank of each suffix.

    Prefix doubling; suffixes that agree to that depth share a rank.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order, size = np.argsort(rank, kind="stable"), 1
    while size < depth:
        step = min(size, depth - size)
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size += step
    return order, rank


def page_runs(tokens: np.ndarray, page: np.ndarray, section: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``depth`` tokens inside one section: their places by run, the run of each place, and each run's number of pages."""
    n = len(tokens)
    inside = np.zeros(n, bool)  # runs that don't cross into the next section
    if n >= depth:
        inside[: n - depth + 1] = section[: n - depth + 1] == section[depth - 1 :]
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank = suffix_ranks(tokens, depth)
    order = order[inside[order]]
    group, of = rank[order], page[order]
    by = np.lexsort((of, group))
    group, of, order = group[by], of[by], order[by]
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_page = new_group | np.concatenate([[True], of[1:] != of[:-1]])
    index = np.cumsum(new_group) - 1
    return order, index, np.bincount(index, weights=new_page).astype(np.int64)


def covered_tokens(n: int, starts: np.ndarray, depth: int) -> np.ndarray:
    """True for those of ``n`` tokens that a run of ``depth`` tokens from one of ``starts`` on covers."""
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + depth, -1)
    return np.cumsum(covered[:n]) > 0


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, section: np.ndarray, pages_needed: np.ndarray, depth: int) -> np.ndarray:
    """True for tokens that a run of ``depth`` tokens covers which stands on enough distinct pages.

    ``page``, ``section``: the page and the section of a page of each token; ``pages_needed``: for each token's
    page, how many pages are enough.
    """
    order, index, pages = page_runs(tokens, page, section, depth)
    return covered_tokens(len(tokens), order[pages[index] >= pages_needed[order]], depth)


def pages_needed(of_pages: np.ndarray, least_pages: int, page_share: float) -> np.ndarray:
    """How many pages of a host with ``of_pages`` pages are enough."""
    return np.maximum(least_pages, np.ceil(page_share * of_pages).astype(np.int64))


@dataclass
class Group:
    """Pages of a group as one token stream.

    ``names``, ``hosts``: distinct hosts and the host of each page; ``of_pages``: pages of the page's host in
    all groups, 0 where they are all in this one; ``flat``: page, text and zone of each block; ``words``: by
    block; ``page``, ``section``, ``tokens``: page, section and code of each token, codes different for
    different hosts. A section is a stretch of a page that the markup leaves out as a whole or not at all.
    """

    names: list[str]
    hosts: np.ndarray
    of_pages: np.ndarray
    flat: list[tuple[int, str, int]]
    words: WordBatch
    page: np.ndarray
    section: np.ndarray
    tokens: np.ndarray

    def keys(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of ``depth`` tokens inside a page, and for each place of the stream the 64-bit key of the run there, the same in every group."""
        offsets = np.searchsorted(self.section, np.arange(self.section.max(initial=-1) + 2))
        hashes, bounds = window_hashes(word_hashes(self.words), offsets, depth)
        starts = np.repeat(offsets[:-1] - bounds[:-1], np.diff(bounds)) + np.arange(len(hashes))
        salts = np.array([xxhash.xxh3_64_intdigest(n) for n in self.names], np.uint64)
        keys = np.zeros(len(self.tokens), np.uint64)
        keys[starts] = mix(hashes ^ salts[self.hosts[self.page[starts]]])
        return starts, keys.view(np.int64)


def read_group(table: pa.Table) -> Group:
    encoded = table["host"].combine_chunks().dictionary_encode()
    hosts = encoded.indices.to_numpy().astype(np.int64)
    flat = [(p, text, zone) for p, (texts, zones) in enumerate(zip(table["texts"].to_pylist(), table["zones"].to_pylist(), strict=True)) for text, zone in zip(texts, zones, strict=True)]
    words = split_words(as_text(pa.array([text for _, text, _ in flat], pa.large_string())))
    page_of, marked = np.array([p for p, _, _ in flat], np.int64), np.array([zone == MARKED for _, _, zone in flat], bool)
    sections = np.cumsum((np.diff(page_of, prepend=-1) != 0) | (np.diff(marked, prepend=False) != 0)) - 1 if len(flat) else page_of
    page, section = np.repeat(page_of, np.diff(words.offsets)), np.repeat(sections, np.diff(words.offsets))
    tokens = words.codes.astype(np.int64) * (int(hosts.max(initial=0)) + 1) + hosts[page]  # only pages of one host can agree
    return Group(encoded.dictionary.to_pylist(), hosts, table["of_pages"].to_numpy(), flat, words, page, section, tokens)


def part_runs(group: Group, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs in a part of a large host: key, a page that has it, number of the part's pages that have it."""
    order, index, pages = page_runs(group.tokens, group.page, group.section, depth)
    first = order[np.flatnonzero(np.diff(index, prepend=-1))]
    return group.keys(depth)[1][first], group.page[first], pages


def marked_bits(group: Group, depth: int, least_pages: int, page_share: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Bits (host, slot of 64, bits) of the runs that are on enough of the part's pages to be on enough of the host's."""
    keys, page, pages = part_runs(group, depth)
    of_pages, here = group.of_pages[page], np.bincount(group.hosts)[group.hosts[page]]
    keys, host = (x[pages * of_pages >= pages_needed(of_pages, least_pages, page_share) * here] for x in (keys, group.hosts[page]))
    cell = keys & (BITMAP_BITS - 1)
    slot, index = np.unique(host * (BITMAP_BITS >> 6) + (cell >> 6), return_inverse=True)
    bits = np.zeros(len(slot), np.uint64)
    np.bitwise_or.at(bits, index, np.uint64(1) << (cell & 63).astype(np.uint64))
    return [group.names[k] for k in slot // (BITMAP_BITS >> 6)], slot % (BITMAP_BITS >> 6), bits.view(np.int64)


def marked_runs(group: Group, slots: np.ndarray, bits: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``part_runs``, but only those whose bit is set."""
    bitmap = np.zeros(BITMAP_BITS >> 6, np.uint64)
    np.bitwise_or.at(bitmap, slots, bits.view(np.uint64))
    keys, page, pages = part_runs(group, depth)
    cell = keys & (BITMAP_BITS - 1)
    found = (bitmap[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
    return keys[found], page[found], pages[found]


def clean_group(group: Group, repeated: np.ndarray, least_tokens: int, least_pages: int, page_share: float) -> list[str]:
    """The main text of each page of a group; see ``extract``. ``repeated``: keys of the large hosts' repeated runs."""
    out: list[list[str]] = [[] for _ in group.hosts]
    flat, words, page, n = group.flat, group.words, group.page, len(group.tokens)
    sizes = np.diff(words.offsets)
    block = np.repeat(np.arange(len(flat)), sizes)
    zone = np.repeat(np.array([z for _, _, z in flat], np.int64), sizes)
    covered = np.zeros(n, bool)
    if (group.of_pages == 0).any():
        needed = pages_needed(np.bincount(group.hosts)[group.hosts], least_pages, page_share)
        covered |= repeated_tokens(group.tokens, page, group.section, np.where(group.of_pages == 0, needed, n + 1)[page], least_tokens)
    if len(repeated):
        starts, keys = group.keys(least_tokens)
        starts = starts[group.of_pages[page[starts]] > 0]
        covered |= covered_tokens(n, starts[np.isin(keys[starts], repeated)], least_tokens)
    keep = (~covered | (zone == CONTENT)) & (zone != MARKED)
    kept = np.bincount(block, weights=keep, minlength=len(flat)).astype(np.int64)
    for k, (p, text, _) in enumerate(flat):
        if kept[k] == sizes[k] and kept[k]:
            out[p].append(text)
        elif kept[k]:
            a, b = words.offsets[k], words.offsets[k + 1]
            out[p].append(" ".join(words.words.take(pa.array(words.codes[a:b][keep[a:b]])).to_pylist()))
    return [" ".join(parts) for parts in out]


def extract(pages: DataFrame, least_tokens: int = 8, least_pages: int = 3, page_share: float = 0.2) -> DataFrame:
    """page_id, url and text (the main text, empty if there is none) for every row of ``pages``.

    ``least_tokens``: length of a repeated run; it must stand on ``least_pages`` pages and on ``page_share``
    of the host's pages, in parts that the markup leaves out or not. Text inside article and main elements
    stays whole; what the markup leaves out (``page_blocks``) goes.
    Character references are decoded, white space inside a block becomes one space, blocks are joined in
    page order by one space. A null or empty html gives an empty text. Rows with null or repeated ids are
    pages of their own; a url without a host belongs to the host "". Other columns are not read; an empty
    table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    sizes = materialize(given.groupBy("host").agg(F.sum(F.octet_length("html") + 1).alias("size"), F.count("*").alias("pages")), "hosts")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(1, -(-total // GROUP_BYTES))
    parts = F.greatest(F.ceil(F.col("size") / PART_BYTES), F.least(F.ceil(F.col("size") / GROUP_BYTES), F.ceil(F.col("pages") / PART_PAGES)))
    large = sizes.where(F.col("size") > GROUP_BYTES).select("host", parts.alias("parts"), F.when(parts > 1, F.col("pages")).otherwise(0).alias("of_pages"))
    n_large = large.limit(MOST_BROADCAST_HOSTS + 1).count()
    if n_large:
        given = given.join(F.broadcast(large) if n_large <= MOST_BROADCAST_HOSTS else large, "host", "left")
    else:
        given = given.withColumns({"parts": F.lit(None).cast("long"), "of_pages": F.lit(0).cast("long")})
    part_of = lambda k: F.xxhash64("host", k)
    part = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("host"), F.lit(groups))).otherwise(part_of(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("parts"))))
    given = given.select("page_id", "url", "host", "html", part.alias("part"), F.coalesce("of_pages", F.lit(0)).cast("long").alias("of_pages"))

    def parse(batches):
        for batch in batches:
            texts, zones = [], []
            for html in batch.column(3).to_pylist():
                blocks, _ = page_blocks(html, marked=True)
                texts.append([t for t, _ in blocks])
                zones.append([z for _, z in blocks])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), batch.column(5), pa.array(texts, pa.list_(pa.string())), pa.array(zones, pa.list_(pa.int64()))], ["page_id", "url", "host", "part", "of_pages", "texts", "zones"])

    parsed = given.mapInArrow(parse, "page_id long, url string, host string, part long, of_pages long, texts array<string>, zones array<bigint>")
    extracted = "page_id long, url string, text string"

    def clean(table: pa.Table, repeated: pa.Table) -> pa.Table:
        keys = repeated["key"].to_numpy() if repeated.num_rows else np.zeros(0, np.int64)
        text = clean_group(read_group(table), keys, least_tokens, least_pages, page_share)
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(text, pa.string())})

    by_part = parsed.groupBy("part")  # one shuffle, read up to three times
    if not n_large:
        return by_part.applyInArrow(lambda table: clean(table, table.slice(0, 0)), extracted)

    def of_large(table: pa.Table) -> Group:
        return read_group(table.filter(pc.greater(table["of_pages"], 0)))

    def mark(table: pa.Table) -> pa.Table:
        host, slot, bits = marked_bits(of_large(table), least_tokens, least_pages, page_share)
        return pa.table({"host": pa.array(host, pa.string()), "slot": pa.array(slot, pa.int64()), "bits": pa.array(bits, pa.int64())})

    def count(table: pa.Table, marked: pa.Table) -> pa.Table:
        keys, page, pages, group = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        if marked.num_rows and table.num_rows:
            group = of_large(table)
            keys, page, pages = marked_runs(group, marked["slot"].to_numpy(), marked["bits"].to_numpy(), least_tokens)
        needed = pages_needed(group.of_pages[page], least_pages, page_share) if len(keys) else pages
        part = np.full(len(keys), table["part"][0].as_py() if len(keys) else 0, np.int64)
        return pa.table({"key": keys, "part": part, "pages": pages, "needed": needed})

    dealt = large.where("of_pages > 0").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k")).select("host", part_of(F.col("k")).alias("part"))
    bits = by_part.applyInArrow(mark, "host string, slot long, bits long").groupBy("host", "slot").agg(F.bit_or("bits").alias("bits"))
    marked = bits.join(dealt, "host").select("part", "slot", "bits")
    counts = by_part.cogroup(marked.groupBy("part")).applyInArrow(count, "key long, part long, pages long, needed long")
    in_host = counts.withColumn("in_host", F.sum("pages").over(Window.partitionBy("key")))
    repeated = in_host.where("in_host >= needed").select("part", "key")
    return by_part.cogroup(repeated.groupBy("part")).applyInArrow(clean, extracted)
