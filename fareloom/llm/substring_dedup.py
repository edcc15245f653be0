"""Removal of word windows that a document with a smaller id already holds.

Counting every window of the corpus exactly would shuffle a row a word. A count-min sketch goes first:

1. Each partition counts, for each of its documents, the anchors of the windows in a sketch of its own.
   The anchor of a window is the least hash among the shorter word runs inside it (winnowing), so equal
   windows have equal anchors, neighbouring windows mostly share one, and the count of an anchor is never
   below the number of documents with a window that it stands for.
2. The partition sketches are merged: a cell that reaches two stays set. An anchor whose cells are all set is
   estimated repeated. Estimates err upwards only, so no repeated window is lost.
3. A second pass emits only windows whose anchor is estimated repeated and groups them by two independent
   hashes of their words, of 64 and 32 bits (among the 2e13 windows of 100 TB less than 0.01 pairs are expected to
   agree in both by chance): partial aggregation finds the least document of a window before
   any shuffle, and the windows of other documents are found by a join that Spark may split where a key is hot.

The sketch grows with the corpus, so that about one anchor in twenty passes it by chance at any size. Up to
``MOST_CELLS`` a row its merged bits are broadcast. A larger one stays where Spark merged it: the set cells are
a table, the runs of windows with one anchor are joined to it by their cell, and the second pass reads which
runs of each document passed. Both ways give the same rows.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.storage import fresh, materialize
from fareloom.llm.textwords import as_text, byte_slices, mix, split_words, window_hashes, word_hashes

WIDTH = 50
#: Sketch rows (hash functions), the cells of a block, and the most cells of a row that is broadcast (32 MB of bits).
DEPTH = 2
BLOCK = 1 << 16
MOST_CELLS = 1 << 28
#: Cells for each expected anchor: in each row of the broadcast sketch, and in the one row of the distributed one.
CELLS, DISTRIBUTED_CELLS = 4, 16
#: Bytes of text that are in work at a time, and rows of windows that a task hands on at a time.
SLICE, WINDOW_ROWS = 1 << 20, 1 << 17
#: Positions of a document that meet in one task while ranges are put together.
CHUNK = 1 << 16

_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SECOND_HASH = np.uint64(0xA0761D6478BD642F)
_ROWS = "doc_id long, tag long"


def _window_anchors(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``width`` words the least hash of the runs of half that many words inside it."""
    run = max(1, width // 2)
    grams, bounds = window_hashes(hashes, offsets, run)
    span = width - run + 1  # runs inside a window
    n = np.maximum(np.diff(bounds) - span + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    least, size = grams, 1
    while size * 2 <= span:
        least = np.minimum(least[: len(least) - size], least[size:]) if len(least) > size else least[:0]
        size *= 2
    if size < span and len(least) > span - size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    at = np.repeat(bounds[:-1] - out_bounds[:-1], n) + np.arange(int(out_bounds[-1]))
    return (least[at] if len(at) else np.zeros(0, np.uint64)), out_bounds


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; rows follow one another."""
    return [(mix(anchors * seed) & np.uint64(cells - 1)) + np.uint64(k * cells) for k, seed in enumerate(_SEEDS[:DEPTH])]


def _anchor_batches(texts: pa.Array, width: int):
    for at, end in byte_slices(texts, SLICE):
        words = split_words(texts.slice(at, end - at))
        hashes = word_hashes(words)
        yield at, end, words, hashes, *_window_anchors(hashes, words.offsets, width)


def _anchor_runs(anchors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each run of windows of one text with one anchor, and the run's text."""
    first = np.ones(len(anchors), bool)
    first[1:] = anchors[1:] != anchors[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(first)
    return at, np.searchsorted(bounds, at, side="right") - 1


def _anchors_once_a_text(anchors: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each text's distinct anchors: a text counts once, however often it repeats itself."""
    at, row = _anchor_runs(anchors, bounds)
    anchors = anchors[at]
    order = np.lexsort((anchors, row))
    row, anchors = row[order], anchors[order]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    return anchors[new]


def _partition_sketch(batches, width: int, cells_of) -> tuple[np.ndarray, np.ndarray]:
    """Cells that a partition's texts reach and how often; column 0 of the batches is the text."""
    found = []
    for batch in batches:
        for _, _, _, _, anchors, bounds in _anchor_batches(as_text(batch.column(0)), width):
            if len(anchors):
                found.append(cells_of(_anchors_once_a_text(anchors, bounds)))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def repeated_cells(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """The merged sketch as bits: one for each cell that two documents at least have reached."""

    def sketch(batches):
        hit, times = _partition_sketch(batches, width, lambda anchors: np.concatenate(_cells(anchors, cells)))
        if not len(hit):
            return
        block, low = (hit // BLOCK).astype(np.int64), (hit % BLOCK).astype("<u2")
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(edges[1:], len(block))
        once = [low[a:b].tobytes() for a, b in zip(edges, ends, strict=True)]
        twice = [low[a:b][times[a:b] > 1].tobytes() for a, b in zip(edges, ends, strict=True)]
        yield pa.RecordBatch.from_pydict({"block": pa.array(block[edges]), "once": pa.array(once, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        reached, again = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
        for once, twice in zip(frame["once"], frame["twice"], strict=True):
            cells = np.frombuffer(once, "<u2")
            again[cells] |= reached[cells]
            reached[cells] = True
            again[np.frombuffer(twice, "<u2")] = True
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "bits": [np.packbits(again).tobytes()]})

    parts = docs.select("text").mapInArrow(sketch, "block long, once binary, twice binary")
    merged = parts.groupBy("block").applyInPandas(merge, "block long, bits binary")
    bits = np.zeros(max(DEPTH * cells, BLOCK) // 8, np.uint8)
    for row in merged.collect():  # at most DEPTH * MOST_CELLS bits
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _window_rows(spots: np.ndarray, words, hashes: np.ndarray, bounds: np.ndarray, width: int, columns: list[pa.Array]):
    """Batches of the windows at ``spots`` with two hashes, the columns of their rows, and their first word."""
    one, _ = window_hashes(hashes, words.offsets, width)
    two = (window_hashes(mix(hashes ^ _SECOND_HASH), words.offsets, width)[0] >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(spots), WINDOW_ROWS):
        some = spots[at : at + WINDOW_ROWS]
        row = np.searchsorted(bounds, some, side="right") - 1
        taken = [c.take(pa.array(row)) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(one[some].view(np.int64)), pa.array(two[some].view(np.int32)), *taken, pa.array(some - bounds[row])], ["window", "check", "doc_id", "tag", "first"])


_WINDOWS = f"window long, check int, {_ROWS}, first long"


def _windows_by_broadcast(docs: DataFrame, width: int, cells: int) -> DataFrame:
    bits = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, width, cells))

    def emit(batches):
        for batch in batches:
            texts = as_text(batch.column(2))
            for at, end, words, hashes, anchors, bounds in _anchor_batches(texts, width):
                if not len(anchors):
                    continue
                hit = np.ones(len(anchors), bool)
                for cell in _cells(anchors, cells):
                    hit &= _is_set(bits.value, cell)
                if hit.any():
                    yield from _window_rows(np.flatnonzero(hit), words, hashes, bounds, width, [batch.column(k).slice(at, end - at) for k in (0, 1)])

    return docs.mapInArrow(emit, _WINDOWS)


def _windows_by_join(docs: DataFrame, width: int, cells: int) -> DataFrame:
    """The same with a sketch of one row that is never in one place; set cells and runs meet in a join."""
    mask, seed = np.uint64(cells - 1), _SEEDS[0]

    def sketch(batches):
        hit, times = _partition_sketch(batches, width, lambda anchors: mix(anchors * seed) & mask)
        for at in range(0, len(hit), 1 << 16):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(hit[at : at + (1 << 16)].view(np.int64)), "times": pa.array(times[at : at + (1 << 16)])})

    def runs(batches):
        for batch in batches:
            for at, end, _, _, anchors, bounds in _anchor_batches(as_text(batch.column(2)), width):
                if len(anchors):
                    spots, row = _anchor_runs(anchors, bounds)
                    length = np.diff(np.append(spots, len(anchors)))
                    taken = [batch.column(k).slice(at, end - at).take(pa.array(row)) for k in (0, 1)]
                    cell = (mix(anchors[spots] * seed) & mask).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *taken, pa.array(spots - bounds[row]), pa.array(length)], ["cell", "doc_id", "tag", "first", "n"])

    def emit(batches):
        for batch in batches:
            texts = as_text(batch.column(2))
            for at, end in byte_slices(texts, SLICE):
                words = split_words(texts.slice(at, end - at))
                hashes = word_hashes(words)
                bounds = np.concatenate([[0], np.cumsum(np.maximum(np.diff(words.offsets) - width + 1, 0))])
                lists = batch.column(3).slice(at, end - at)
                inside = lists.flatten()
                first, n = (np.asarray(inside.field(k)) for k in (0, 1))
                first = first + np.repeat(bounds[:-1], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                spots = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                if len(spots):
                    yield from _window_rows(spots, words, hashes, bounds, width, [batch.column(k).slice(at, end - at) for k in (0, 1)])

    reached = docs.select("text").mapInArrow(sketch, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times"))
    again = materialize(reached.where("times > 1").select("cell"), "repeated-cells")
    passed = docs.mapInArrow(runs, f"cell long, {_ROWS}, first long, n long").join(again, "cell", "left_semi")
    # repeated rows with equal ids list a run once for each of them
    passed = passed.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    found = docs.join(passed, ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs")
    return found.mapInArrow(emit, _WINDOWS)


def repeated_ranges(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, tag and ranges (first word, words behind the last one) to remove, for rows that have some.

    ``docs`` has doc_id, tag (a hash of the text, which tells rows with equal ids apart) and text.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    anchors = size / 5 * 2 / (width - max(1, width // 2) + 2) + 1
    given = docs.where(F.col("doc_id").isNotNull())
    cells = max(BLOCK, 1 << math.ceil(math.log2(CELLS * anchors)))
    if cells <= MOST_CELLS:
        windows = _windows_by_broadcast(given, width, cells)
    else:
        windows = _windows_by_join(given, width, 1 << math.ceil(math.log2(DISTRIBUTED_CELLS * anchors)))
    # emitted twice rather than stored: the windows are the largest intermediate result by far
    least = windows.groupBy("window", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window", "check", "least")
    least = materialize(least, "repeated-windows")
    later = windows.join(least, ["window", "check"]).where("doc_id > least").select("doc_id", "tag", "first")

    def ranges(batches):
        """Neighbouring windows as one range; a range that ends with a batch simply goes on in the next one."""
        for batch in batches:
            doc, tag, first = (np.asarray(c) for c in batch.columns)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (first[1:] > first[:-1] + width)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), pa.array(first[at]), pa.array(first[last] + width)], ["doc_id", "tag", "start", "stop"])

    # by pieces of a document, so that a very long text is not one task's
    ordered = later.repartition("doc_id", "tag", F.floor(F.col("first") / CHUNK)).sortWithinPartitions("doc_id", "tag", "first")
    merged = ordered.mapInArrow(ranges, f"{_ROWS}, start long, stop long")
    return merged.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text: str = "text", collapse: bool = False) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with the words removed that a window of ``width`` words covers whose word sequence also
    starts in a document with a smaller id; and the names of two added columns, words and removed words.

    Windows are judged on the input. Where words were removed the text is the other words joined by one
    space; with ``collapse`` that form is given to every text. A null text counts as none: it stays null
    and has 0 words. Texts of fewer than ``width`` words lose nothing. Rows that share an id are judged
    each on its own, and none of them against another; rows with a null id lose nothing and make no other
    row lose anything. Every row is returned, with all its columns; an empty table gives an empty result.
    """
    body = F.col(text).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"))
    # few rows, from files: the windows that were shuffled for them are gone before the texts are
    positions = materialize(repeated_ranges(narrow, width), "repeated-ranges")
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("tag"), body.alias("text"), rest.alias("rest"))
    # never broadcast: lists of ranges are small in files and far larger in memory, and grow with the documents
    joined = rows.join(positions.hint("merge"), ["doc_id", "tag"], "left").select("rest", "text", "ranges")

    def cut(batches):
        for batch in batches:
            texts, spots = batch.column(1), batch.column(2)
            n_words, n_removed, kept = [], [], []
            for value, ranges in zip(texts, spots, strict=True):
                if not value.is_valid:
                    n_words.append(0), n_removed.append(0), kept.append(None)
                    continue
                raw = value.as_buffer().to_pybytes()
                words = raw.split()  # bytes split at the six ASCII white-space characters
                removed = 0
                if ranges.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, np.asarray(ranges.values.field(0)), 1)
                    np.add.at(edges, np.asarray(ranges.values.field(1)), -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    removed = int(len(words) - keep.sum())
                    raw = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
                if collapse and not removed:
                    raw = b" ".join(words)
                n_words.append(len(words)), n_removed.append(removed), kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["rest", "text", "n_words", "n_removed"]
            )

    kind = joined.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(cut, f"rest {kind}, text string, n_words long, n_removed long")
    names = (fresh("n_words", docs), fresh("n_removed", docs))
    columns = [F.col("text").alias(c) if c == text else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns]
    return out.select(*columns, F.col("n_words").alias(names[0]), F.col("n_removed").alias(names[1])), names
