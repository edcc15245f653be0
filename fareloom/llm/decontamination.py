"""Benchmark passages in documents, found by greedy string tiling.

Seeds of ``least`` tokens that a document shares with a benchmark item select the pairs to look at. For each
pair Karp-Rabin fingerprints find the longest matches of unmarked tokens, which are marked as tiles, longest
first; what a tile leaves of another match goes back into the queue. Tiles don't overlap on either side and may
stand in any order, so a passage whose sentences were moved about is covered as well. A document is contaminated
by an item when its tiles cover a given share of the item's tokens.

A pair over that share has a least number of the item's seeds in common. So only an item's rarest seeds, as
many as leave fewer than that number out, have to be looked up: phrases that open thousands of items select
nothing. A pair that has too few seeds in common is left before it is tiled.

A token is a word in lower case without anything but letters and digits. A benchmark whose arrays fit a checked
bound is broadcast and documents are never shuffled; a larger one meets the documents in a join on seeds. Both
ways look at the same pairs by the same function.
"""

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.storage import fresh, materialize
from fareloom.llm.textwords import as_text, byte_slices, mix, split_words, window_hashes

#: Text of a benchmark that is brought together at most, and the arrays made of it that are broadcast at most.
MOST_TEXT_BYTES, MOST_BROADCAST_BYTES = 32 << 20, 128 << 20
_NOT_TOKEN = re.compile(r"[\W_]+")
_FILTER_BITS = 22
#: Pairs of places that are held at a time.
_PAIRS_AT_A_TIME = 1 << 20
#: Base of the fingerprints (odd, so that it has an inverse modulo 2 ** 64) and that inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _token_hash(word: str) -> int:
    """0 for a word without a letter or digit."""
    token = _NOT_TOKEN.sub("", word.lower())
    return xxhash.xxh3_64_intdigest(token) or 1 if token else 0


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, and the texts' bounds."""
    words = split_words(texts)
    if not len(words.words):
        return np.zeros(0, np.uint64), words.offsets
    distinct = np.fromiter(map(_token_hash, words.words.to_pylist()), np.uint64, len(words.words))
    tokens = distinct[words.codes]
    keep = tokens != 0
    return tokens[keep], np.concatenate([[0], np.cumsum(keep)])[words.offsets]


# -- tiles of one pair ------------------------------------------------------------------------------


class _Fingerprints:
    """Karp-Rabin fingerprints of all runs of tokens, from running sums modulo 2 ** 64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64) for base in (_BASE, _INVERSE))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens) * powers[:-1], dtype=np.uint64)])
        self.inverse = inverse

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[places + length] - self.sums[places]) * self.inverse[places]


def maximal_matches(pattern: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in pattern, start in text and length of the matches of ``least`` tokens or more that can't be made longer.

    A token 0 in ``text`` matches nothing. Places are paired in blocks, so memory doesn't grow with their number.
    """
    none = np.zeros(0, np.int64)
    if min(len(pattern), len(text)) < least:
        return none, none, none
    of_pattern, of_text = _Fingerprints(pattern), _Fingerprints(text)
    spots = np.arange(len(pattern) - least + 1)
    keys = of_pattern.at(spots, least)
    order = np.argsort(keys, kind="stable")
    keys, spots = keys[order], spots[order]
    gaps = np.concatenate([[0], np.cumsum(text == 0)])
    places = np.arange(len(text) - least + 1)
    places = places[gaps[places + least] == gaps[places]]
    wanted = of_text.at(places, least)
    left, right = np.searchsorted(keys, wanted, side="left"), np.searchsorted(keys, wanted, side="right")
    places, left, times = (x[right > left] for x in (places, left, right - left))
    reach, out = np.cumsum(times), []
    at = 0
    while at < len(places):
        end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _PAIRS_AT_A_TIME, side="right")))
        n = times[at:end]
        i = spots[np.repeat(left[at:end] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        j = np.repeat(places[at:end], n)
        starts = (i == 0) | (j == 0) | (pattern[i - 1] != text[j - 1])  # else a longer match begins before it
        i, j = i[starts], j[starts]
        size = np.full(len(i), least)
        step = 1 << max(0, min(len(pattern), len(text)).bit_length() - 1)
        while step:
            room = np.flatnonzero((i + size + step <= len(pattern)) & (j + size + step <= len(text)))
            room = room[gaps[(j + size)[room] + step] == gaps[(j + size)[room]]]
            same = room[of_pattern.at((i + size)[room], step) == of_text.at((j + size)[room], step)]
            size[same] += step
            step //= 2
        out.append((i, j, size))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length): the longest unmarked match again and again; of equally long ones
    the first in the pattern, then in the text. A token 0 in ``text`` matches nothing."""
    pattern, text = np.asarray(pattern, np.uint64), np.asarray(text, np.uint64)
    queue = [(-size, i, j) for i, j, size in zip(*(x.tolist() for x in maximal_matches(pattern, text, least)), strict=True)]
    heapq.heapify(queue)
    used, taken, left = bytearray(len(pattern)), bytearray(len(text)), len(pattern)
    tiles: list[tuple[int, int, int]] = []
    while queue and left >= least:
        size, i, j = heapq.heappop(queue)
        size = -size
        if used.find(1, i, i + size) < 0 and taken.find(1, j, j + size) < 0:
            same = pattern[i : i + size] == text[j : j + size]
            if same.all():
                used[i : i + size] = taken[j : j + size] = b"\1" * size
                tiles.append((i, j, size))
                left -= size
                continue
            free = same  # two fingerprints agree and the tokens don't
        else:
            free = (np.frombuffer(used, np.uint8)[i : i + size] | np.frombuffer(taken, np.uint8)[j : j + size]) == 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(queue, (a - b, i + a, j + a))
    return tiles


def tile_pair(item: np.ndarray, tokens: np.ndarray, starts: np.ndarray, least: int, share: float):
    """(covered tokens, tiles, longest tile) of an item in a text, None where they are less than ``share`` of the item.

    ``starts``: places in ``tokens`` with a seed of the item; only tokens that these cover can be in a tile, so the
    others are left out.
    """
    inside = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + least, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    gap = np.flatnonzero(np.diff(at) > 1) + 1
    tiles = greedy_tiles(item, np.insert(tokens[at], gap, np.uint64(0)), least)
    covered = sum(t[2] for t in tiles)
    if not tiles or covered < share * len(item):
        return None
    return covered, len(tiles), max(t[2] for t in tiles)


# -- seeds ------------------------------------------------------------------------------------------


def seeds_needed(n_tokens, least: int, share: float):
    """Of how many of its seed places an item of ``n_tokens`` tokens must be found for that share of it to be covered."""
    return np.maximum(1, np.ceil(share * np.asarray(n_tokens) / least - 1e-9)).astype(np.int64)


class Benchmark:
    """Items and their seeds, in arrays that tasks search."""

    def __init__(self, item_ids: list, texts: list, least: int, share: float):
        self.least, self.share, self.item_ids = least, share, item_ids
        self.tokens, self.bounds = tokens_of(as_text(pa.array(texts, pa.string())))
        seeds, seed_bounds = window_hashes(self.tokens, self.bounds, least)
        items = np.repeat(np.arange(len(texts)), np.diff(seed_bounds))
        _, code, times = np.unique(seeds, return_inverse=True, return_counts=True)
        order = np.lexsort((seeds, times[code], items))  # of each item the rarest first
        skipped = seeds_needed(np.diff(self.bounds), least, share) - 1
        looked_up = order[np.arange(len(order)) < (seed_bounds[1:] - skipped)[items[order]]] if len(order) else order
        order = looked_up[np.lexsort((items[looked_up], seeds[looked_up]))]
        new = np.ones(len(order), bool)
        new[1:] = (seeds[order][1:] != seeds[order][:-1]) | (items[order][1:] != items[order][:-1])
        order = order[new]
        self.seeds, self.seed_items = seeds[order], items[order].astype(np.int32)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def n_bytes(self) -> int:
        return self.tokens.nbytes + self.bounds.nbytes + self.seeds.nbytes + self.seed_items.nbytes + self.maybe.nbytes

    def item(self, k: int) -> np.ndarray:
        return self.tokens[self.bounds[k] : self.bounds[k + 1]]

    def tile(self, k: int, tokens: np.ndarray, seeds: np.ndarray):
        """See ``tile_pair``; ``seeds`` are those of ``tokens``."""
        item = self.item(k)
        own, _ = window_hashes(item, np.array([0, len(item)]), self.least)
        if np.isin(own, seeds).sum() < seeds_needed(len(item), self.least, self.share):
            return None
        return tile_pair(item, tokens, np.flatnonzero(np.isin(seeds, own)), self.least, self.share)

    def search(self, texts: pa.Array):
        """(row, item position, covered tokens, tiles, longest tile) of every pair over the threshold."""
        for at, end in byte_slices(texts):
            tokens, bounds = tokens_of(texts.slice(at, end - at))
            seeds, seed_bounds = window_hashes(tokens, bounds, self.least)
            spots = np.flatnonzero(self.maybe[seeds >> np.uint64(64 - _FILTER_BITS)])
            left = np.searchsorted(self.seeds, seeds[spots], side="left")
            right = np.searchsorted(self.seeds, seeds[spots], side="right")
            spots, left, times = (x[right > left] for x in (spots, left, right - left))
            if not len(spots):
                continue
            row = np.searchsorted(seed_bounds, spots, side="right") - 1
            edges = np.flatnonzero(np.diff(row, prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(row)), strict=True):
                k = int(row[a])
                found: set[int] = set()
                for first, n in {(int(first), int(n)) for first, n in zip(left[a:b], times[a:b], strict=True)}:
                    found.update(self.seed_items[first : first + n].tolist())
                for item in sorted(found):
                    tiles = self.tile(item, tokens[bounds[k] : bounds[k + 1]], seeds[seed_bounds[k] : seed_bounds[k + 1]])
                    if tiles:
                        yield at + k, item, *tiles


_FOUND = "item_tokens long, covered_tokens long, n_tiles long, longest_tile long"
_PAIRS = f"doc_id long, item_id long, {_FOUND}"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item"))


def _load(benchmark: DataFrame, least: int, share: float):
    """The benchmark for broadcasting, or None where it is over a bound."""
    rows = _items(benchmark)
    if (rows.agg(F.sum(F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0) > MOST_TEXT_BYTES:
        return None
    given = rows.collect()
    known = Benchmark([r.item_id for r in given], [r.item for r in given], least, share)
    return rows.sparkSession.sparkContext.broadcast(known) if known.n_bytes() <= MOST_BROADCAST_BYTES else None


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = 4, share: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and benchmark item whose tiles of ``least`` tokens or more cover at least
    ``share`` of the item: doc_id, item_id, item_tokens, covered_tokens, n_tiles, longest_tile.

    Items of fewer than ``least`` tokens and null or empty texts match nothing. Repeated rows give repeated
    pairs; null ids are kept. Other columns are not read. An empty table on either side gives no pair. The
    result doesn't depend on whether the benchmark is small enough to be broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    loaded = _load(benchmark, least, share)
    if loaded is None:
        doc_rows, item_rows = rows.select("doc_id", _digest("text", "doc_digest")), _items(benchmark).select("item_id", _digest("item", "item_digest"))
        found = _digest_pairs(rows, benchmark, least, share)
        return doc_rows.join(found, "doc_digest").join(item_rows, "item_digest").select(*(f.split()[0] for f in _PAIRS.split(", ")))

    def search(batches):
        for batch in batches:
            ids, known = batch.column(0), loaded.value
            found = [(ids[row].as_py(), known.item_ids[item], len(known.item(item)), *tiles) for row, item, *tiles in known.search(as_text(batch.column(1)))]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _PAIRS.split(", ")])

    return rows.mapInArrow(search, _PAIRS)


# -- a benchmark that is too large to broadcast ------------------------------------------------------


def _digest(text: str, name: str):
    """Stands for a text in joins: rows with null or repeated ids need no key of their own."""
    return F.md5(F.col(text).cast("binary")).alias(name)


def _distinct_texts(rows: DataFrame, text: str, digest: str) -> DataFrame:
    return rows.where(F.col(text).isNotNull()).groupBy(_digest(text, digest)).agg(F.first(text).alias(text))


def _seed_rows(texts: DataFrame, digest: str, least: int) -> DataFrame:
    """digest, n_tokens, seed and times (places in the text) for texts; rows: digest, text."""

    def run(batches):
        for batch in batches:
            column = as_text(batch.column(1))
            for at, end in byte_slices(column):
                tokens, bounds = tokens_of(column.slice(at, end - at))
                seeds, seed_bounds = window_hashes(tokens, bounds, least)
                row = np.repeat(np.arange(end - at), np.diff(seed_bounds))
                order = np.lexsort((seeds, row))
                row, seeds = row[order], seeds[order]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (seeds[1:] != seeds[:-1])]))
                times = np.diff(np.append(first, len(row)))
                row = row[first]
                taken = batch.column(0).slice(at, end - at).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken, pa.array(np.diff(bounds)[row]), pa.array(seeds[first].view(np.int64)), pa.array(times)], [digest, "n_tokens", "seed", "times"])

    return texts.mapInArrow(run, f"{digest} string, n_tokens long, seed long, times long")


def _digest_pairs(rows: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """doc_digest, item_digest and what was found, for each pair of different texts over the threshold.

    Seeds of distinct texts are joined, each item with its rarest ones first; a seed of very many documents is
    one that Spark may split. Only pairs with enough seeds in common are joined with their texts.
    """
    doc_texts = _distinct_texts(rows, "text", "doc_digest")
    item_texts = materialize(_distinct_texts(_items(benchmark), "item", "item_digest"), "items")
    of_items = materialize(_seed_rows(item_texts, "item_digest", least), "item-seeds")
    needed = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n_tokens") / least - 1e-9))
    often = of_items.groupBy("seed").agg(F.sum("times").alias("often"))
    ordered = F.array_sort(F.collect_list(F.struct("often", "seed", "times")))  # an item is one benchmark text
    ranked = of_items.join(often, "seed").groupBy("item_digest", "n_tokens").agg(ordered.alias("ordered"), F.sum("times").alias("places"))
    each = ranked.select("item_digest", "n_tokens", "places", F.posexplode("ordered").alias("at", "s"), F.col("ordered").alias("o"))
    before = F.aggregate(F.slice("o", 1, F.col("at")), F.lit(0).cast("long"), lambda total, x: total + x["times"])
    looked_up = materialize(each.where(before < F.col("places") - (needed - 1)).select("item_digest", F.col("s.seed").alias("seed")), "looked-up-seeds")
    of_docs = materialize(_seed_rows(doc_texts, "doc_digest", least).select("doc_digest", "seed").join(of_items.select("seed").distinct(), "seed", "left_semi"), "document-seeds")
    candidates = of_docs.join(looked_up, "seed").select("doc_digest", "item_digest").distinct()
    common = candidates.join(of_items, "item_digest").join(of_docs, ["doc_digest", "seed"]).groupBy("doc_digest", "item_digest", "n_tokens").agg(F.sum("times").alias("common"))
    pairs = materialize(common.where(F.col("common") >= needed).select("doc_digest", "item_digest"), "tiling-pairs")
    full = pairs.join(doc_texts, "doc_digest").join(item_texts, "item_digest").select("doc_digest", "item_digest", "text", "item")

    def search(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                known = Benchmark([None], [batch.column(3)[k].as_py()], least, share)
                tokens, bounds = tokens_of(as_text(batch.column(2).slice(k, 1)))
                tiles = known.tile(0, tokens, window_hashes(tokens, bounds, least)[0])
                if tiles:
                    out.append((k, len(known.item(0)), *tiles))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            taken = [batch.column(c).take(pa.array(columns[0], pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_digest", "item_digest", *(f.split()[0] for f in _FOUND.split(", "))])

    return full.mapInArrow(search, f"doc_digest string, item_digest string, {_FOUND}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 4, share: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their own columns; see ``contaminated_pairs``.

    Each row is judged by its own text, whatever its id; a null text is clean.
    """
    loaded = _load(benchmark, least, share)
    if loaded is None:
        key = fresh("digest", docs)
        gone = _digest_pairs(docs.select(F.col(text).cast("string").alias("text")), benchmark, least, share).select(F.col("doc_digest").alias(key)).distinct()
        return docs.join(gone, F.md5(F.col(text).cast("string").cast("binary")) == F.col(key), "left_anti")
    at = docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            dirty = pa.array(sorted({row for row, *_ in loaded.value.search(as_text(batch.column(at)))}), pa.int64())
            yield batch.filter(pc.invert(pc.is_in(pa.array(np.arange(batch.num_rows)), value_set=dirty)))

    return docs.mapInArrow(keep, docs.schema)
