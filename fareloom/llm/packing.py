"""Packing documents into training sequences by order-preserving dynamic programming.

The tokens of a run of documents form one stream in input order. The stream is cut into windows of at
most ``capacity`` tokens; windows may be cut behind a document, behind a sentence, or, where sentences
are long, at fixed steps inside them. With g(i) the least cost of a stream cut at boundary i plus
position i, the recurrence is

    g(j) = penalty(j) + capacity + min { g(i) : position(j) - capacity <= position(i) < position(j) }

which charges every window its padding and every cut inside a document its penalty. The minimum slides
over the boundaries, so a monotone queue gives it in constant amortised time. A stream is bounded by
``STREAM_BYTES`` of text; its last window, which would be mostly padding, may be split into lengths that
are powers of two, which need none.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.textwords import as_text, byte_slices
from fareloom.llm.tokenizing import encode_texts

CAPACITY = 2048
#: Costs in padding tokens of a cut behind a sentence inside a document, and of one inside a sentence.
SENTENCE_PENALTY, INNER_PENALTY = 4, 16
#: Tokens between the boundaries that are put into a longer sentence.
INNER_STEP = 16
STREAM_BYTES = 8 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def boundaries(bounds: np.ndarray, sentence_ends: np.ndarray, sentence_penalty: int, inner_penalty: int, step: int = INNER_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions at which a window may end, and what a cut there costs."""
    documents = np.unique(bounds)
    sentences = np.setdiff1d(sentence_ends, documents)
    positions = np.concatenate([documents, sentences])
    costs = np.concatenate([np.zeros(len(documents), np.int64), np.full(len(sentences), sentence_penalty)])
    order = np.argsort(positions, kind="stable")
    positions, costs = positions[order], costs[order]
    gaps = np.diff(positions)
    long = np.flatnonzero(gaps > step)
    if len(long):
        extra = (gaps[long] - 1) // step
        inner = np.repeat(positions[long], extra) + step * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        positions, costs = np.concatenate([positions, inner]), np.concatenate([costs, np.full(len(inner), inner_penalty)])
        order = np.argsort(positions, kind="stable")
        positions, costs = positions[order], costs[order]
    return positions, costs


def window_cuts(positions: np.ndarray, costs: np.ndarray, capacity: int) -> np.ndarray:
    """Positions of the cheapest cuts, both ends of the stream included."""
    at, charge = positions.tolist(), costs.tolist()
    n = len(at)
    g, parent = [0] * n, [0] * n
    queue, head = [0], 0
    for j in range(1, n):
        least = at[j] - capacity
        while at[queue[head]] < least:
            head += 1
        i = queue[head]
        parent[j] = i
        value = g[j] = charge[j] + capacity + g[i]
        while len(queue) > head and g[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [at[-1]], n - 1
    while j:
        j = parent[j]
        cuts.append(at[j])
    return np.array(cuts[::-1], np.int64)


def split_tail(cuts: np.ndarray, capacity: int, inner_penalty: int) -> np.ndarray:
    """Splits the last window into powers of two where that costs less than its padding."""
    start, end = int(cuts[-2]), int(cuts[-1])
    length = end - start
    ones = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    if (len(ones) - 1) * inner_penalty >= capacity - length:
        return cuts
    return np.concatenate([cuts[:-1], start + np.cumsum(ones)])


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, sentence_penalty: int = SENTENCE_PENALTY, inner_penalty: int = INNER_PENALTY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens (ids of
    the document with ``end_id``), sequence_id (ascending in input order), offset (of the piece in its
    sequence). Every id is in one piece; pieces of a sequence follow one another from offset 0. A
    sequence never spans two streams of ``STREAM_BYTES`` of text; no row is shuffled. A null or empty text is its
    end id alone. Repeated rows and null ids are packed as they come; other columns are not read.
    An empty table gives no piece.
    """

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = as_text(batch.column(1))
            doc_ids = np.asarray(batch.column(0).fill_null(-1))
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, end in byte_slices(texts, STREAM_BYTES):
                ids, bounds, sentence_ends = encode_texts(texts.slice(at, end - at), tokenizer, end_id)
                cuts = window_cuts(*boundaries(bounds, sentence_ends, sentence_penalty, inner_penalty), capacity)
                cuts = split_tail(cuts, capacity, inner_penalty)
                starts = np.union1d(bounds[:-1], cuts[:-1])
                lengths = np.diff(np.append(starts, bounds[-1]))
                of_doc = np.searchsorted(bounds, starts, side="right") - 1
                of_window = np.searchsorted(cuts, starts, side="right") - 1
                sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array(doc_ids[at:end][of_doc], pa.int64(), mask=~valid[at:end][of_doc]),
                    pa.array(starts - bounds[of_doc]),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                    pa.array(np.diff(bounds)[of_doc]),
                    pa.array(sequence + of_window),
                    pa.array(starts - cuts[of_window]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])
                sequence += len(cuts) - 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)
