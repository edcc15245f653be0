"""Token counts by a two-tier look-up on the map side.

First tier: a compact table (a sorted run of strings and one length each, in Arrow buffers) of the
pre-tokens that are frequent in the whole corpus, broadcast to the executors. Second tier: a bounded
cache in each Python worker, which encodes what the table lacks. No pre-token is shuffled; only one
bounded summary for each partition moves while the table is built.

A pre-token here is the text between two places where the byte-level pattern must cut: in front of
every single space that a non-space follows. Pieces are encoded by the tokenizers library itself,
so the counts are the library's own; texts with a special string are encoded whole.
"""

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.textwords import as_text, byte_slices
from fareloom.llm.tokenizing import PieceCache, load_tokenizer

#: Entries of the broadcast table, and bytes of the longest pre-token that may enter it: with both,
#: the table is at most 16,384 * (48 + 8 + 4) bytes, under 1 MB, at any corpus size.
TABLE_ENTRIES = 16_384
TABLE_PIECE_BYTES = 48
#: Summaries that meet in one task of the first merge.
FAN_IN = 64

_MARK = "\x00"
#: A space and a character that no definition of white space includes.
_CUT = " ([^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}])"


def _summary(counts: dict[str, int]) -> pd.DataFrame:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]
    table = pa.table({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pd.DataFrame({"summary": [sink.getvalue().to_pybytes()]})


def _merged(blobs) -> dict[str, int]:
    counts: dict[str, int] = {}
    for k, blob in enumerate(blobs):
        table = pa.ipc.open_stream(blob).read_all()
        for piece, n in zip(table["piece"].to_pylist(), table["n"].to_pylist(), strict=True):
            counts[piece] = counts.get(piece, 0) + n
        if k % 16 == 15:
            counts = _prune(counts)
    return counts


def _prune(counts: dict[str, int]) -> dict[str, int]:
    """Memory stays bounded: the rarest pieces of a summary go once it holds four tables' worth."""
    if len(counts) <= 4 * TABLE_ENTRIES:
        return counts
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: 2 * TABLE_ENTRIES])


def frequent_pieces(docs: DataFrame, text: str = "text") -> list[str]:
    """The most frequent pre-tokens of all texts, by summaries that are merged level by level."""

    def summarize(batches):
        from pyspark import TaskContext

        counts: dict[str, int] = {}
        for batch in batches:
            texts = as_text(batch.column(0))
            for at, end in byte_slices(texts):
                found = pc.value_counts(pc.split_pattern(texts.slice(at, end - at), pattern=" ").values)
                short = pc.less(pc.binary_length(found.field(0)), TABLE_PIECE_BYTES)
                found = found.filter(short)
                n = found.field(1)
                top = pc.array_sort_indices(n, order="descending")[: 2 * TABLE_ENTRIES]
                for piece, k in zip(found.field(0).take(top).to_pylist(), n.take(top).to_pylist(), strict=True):
                    counts[piece] = counts.get(piece, 0) + k
                counts = _prune(counts)
        frame = _summary(counts).assign(part=TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    summaries = docs.select(text).mapInArrow(summarize, "summary binary, part long")
    merge = lambda frame: _summary(_merged(frame["summary"])).assign(part=frame["part"].iloc[0] // FAN_IN)
    partitions = docs.rdd.getNumPartitions()
    while partitions > FAN_IN:
        summaries = summaries.groupBy((F.col("part") / FAN_IN).cast("long").alias("group")).applyInPandas(merge, "summary binary, part long")
        partitions = -(-partitions // FAN_IN)
    counts = _merged(row.summary for row in summaries.select("summary").collect())
    return sorted(sorted((p for p in counts if p), key=lambda p: (-counts[p], p))[:TABLE_ENTRIES])


@functools.lru_cache(maxsize=4)
def _length_cache(path: str) -> PieceCache:
    tokenizer = load_tokenizer(path)
    return PieceCache(lambda pieces: [len(e.ids) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])


def _lengths(texts: pa.Array, path: str, specials: list[str], keys: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each text of a slice."""
    whole = pc.match_substring(texts, pattern=_MARK)
    for special in specials:
        whole = pc.or_(whole, pc.match_substring(texts, pattern=special))
    marked = pc.replace_substring_regex(pc.if_else(whole, "", texts), pattern=_CUT, replacement=_MARK + " \\1")
    lists = pc.split_pattern(marked, pattern=_MARK)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.dictionary_encode()
    pieces, codes = encoded.dictionary, encoded.indices.to_numpy()
    at = pc.index_in(pieces, value_set=keys)
    size = np.zeros(len(pieces), np.int64)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    size[known] = lengths[pc.drop_null(at).to_numpy()]
    missing = np.flatnonzero(~known)
    if len(missing):
        size[missing] = _length_cache(path).look_up(pieces.take(pa.array(missing)).to_pylist())
    totals = np.concatenate([[0], np.cumsum(size[codes])])[bounds - bounds[0]]
    counts = np.diff(totals)
    rows = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    if len(rows):
        tokenizer = load_tokenizer(path)
        found = tokenizer.encode_batch_fast(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)
        counts[rows] = [len(e.ids) for e in found]
    return counts


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) for every row.

    ``tokenizer``: the path, the same on all executors, of a byte-level tokenizers file. Counts are
    without begin, end or added special tokens; special strings inside a text count as the library's
    default has them. Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are
    returned as they came; other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    library = load_tokenizer(tokenizer)
    keys = [" " + p for p in frequent_pieces(narrow) if not p[0].isspace()]
    lengths = [len(e.ids) for e in library.encode_batch_fast(keys, add_special_tokens=False)]
    table = spark.sparkContext.broadcast((keys, lengths))
    specials = sorted(t.content for t in library.get_added_tokens_decoder().values())

    def count(batches):
        keys = pa.array(table.value[0], pa.large_string())
        lengths = np.array(table.value[1], np.int64)
        for batch in batches:
            texts = as_text(batch.column(1))
            n = [_lengths(texts.slice(at, end - at), tokenizer, specials, keys, lengths) for at, end in byte_slices(texts)]
            tokens = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
