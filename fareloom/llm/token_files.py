"""Token ids in Arrow IPC files of equal-length sequences with masks.

Documents are dealt out by ranges of their id. Each range becomes one Arrow file whose record batches
hold two fixed-size lists a row: ``ids`` and ``mask``. The ids of the range's documents follow one
another without gaps; only the last row of a file is filled up, with mask false. Row k of a file is
therefore at a fixed place in the buffers and can be used in place, without decoding, from a memory
map. Beside it a small index file holds each document's first position and length. Ids are stored in
16 bits where the vocabulary allows it.

A task writes under a name of its own attempt and reports it; only reported files count, so a task
that is run twice or lost half-way leaves nothing that a reader would see.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.storage import materialize, task_count
from fareloom.llm.textwords import as_text, byte_slices
from fareloom.llm.tokenizing import encode_texts, load_tokenizer

SEQUENCE = 1024
ROWS_PER_BATCH = 512
#: Text of one file; more, up to the second bound, where the files would be too many.
FILE_BYTES, MOST_FILE_BYTES = 12 << 20, 1 << 30

_FILES = "part int, path string, n_docs long, n_tokens long"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(id_type: pa.DataType, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class _SequenceWriter:
    """Cuts a stream of ids into rows of ``sequence`` ids and writes full record batches."""

    def __init__(self, sink, id_type: pa.DataType, sequence: int):
        self.schema, self.sequence = sequence_schema(id_type, sequence), sequence
        self.dtype = id_type.to_pandas_dtype()
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest = np.zeros(0, self.dtype)

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids.astype(self.dtype)])
        step = self.sequence * ROWS_PER_BATCH
        whole = len(self.rest) // step * step
        for at in range(0, whole, step):
            self._write(self.rest[at : at + step], step)
        self.rest = self.rest[whole:].copy()

    def _write(self, ids: np.ndarray, length: int) -> None:
        filled = np.zeros(length, self.dtype)
        filled[: len(ids)] = ids
        mask = np.arange(length) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (filled, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest, -(-len(self.rest) // self.sequence) * self.sequence)
        self.out.close()


def write_token_files(docs: DataFrame, tokenizer: str, directory: str, end_id: int, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Writes the files below ``directory``, which all executors reach, and returns one row a file.

    Columns: part (files in this order are in ascending order of the id), path, n_docs, n_tokens.
    Every document's ids are followed by ``end_id``; a null or empty text gives that id alone. Rows
    with equal ids stay side by side, ordered by their text; null ids come first. Other columns are
    not read. An empty table gives no file.
    """
    small = load_tokenizer(tokenizer).get_vocab_size() <= 1 << 16

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        filesystem, root = pafs.FileSystem.from_uri(directory)
        filesystem.create_dir(root, recursive=True)
        stem = f"{root}/tokens-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        writer = index = sink = index_sink = None
        n_docs = n_tokens = 0
        for batch in batches:
            texts = as_text(batch.column(1))
            for at, end in byte_slices(texts):
                if writer is None:
                    sink, index_sink = filesystem.open_output_stream(f"{stem}.arrow"), filesystem.open_output_stream(f"{stem}.index.arrow")
                    writer = _SequenceWriter(sink, pa.uint16() if small else pa.uint32(), sequence)
                    index = pa.ipc.new_file(index_sink, _INDEX)
                ids, bounds, _ = encode_texts(texts.slice(at, end - at), tokenizer, end_id)
                writer.add(ids)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(bounds[:-1] + n_tokens), pa.array(np.diff(bounds))], schema=_INDEX))
                n_docs, n_tokens = n_docs + end - at, n_tokens + len(ids)
        if writer is not None:
            for part in (writer, index, sink, index_sink):
                part.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [stem], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = narrow.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0))).first()[0]
    n_files = task_count(docs.sparkSession, size, FILE_BYTES, MOST_FILE_BYTES)
    ordered = narrow.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, _FILES), "token-files")


def read_token_files(files: DataFrame, directory: str) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the number of tokens of each file goes through the driver, two numbers a file.
    """
    spark = files.sparkSession
    before, bases = 0, []
    for row in files.select("part", "n_tokens").orderBy("part").toLocalIterator():
        bases.append((row.part, before))
        before += row.n_tokens
    placed = files.join(spark.createDataFrame(bases, "part int, base long"), "part")

    def read(batches):
        filesystem, _ = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for stem, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(f"{stem}.arrow") as source, filesystem.open_input_file(f"{stem}.index.arrow") as index_source:
                    yield from _digests(pa.ipc.open_file(source), pa.ipc.open_file(index_source), base)

    # a count of its own: without one Spark puts the short list of paths, and with it all files, into one task
    tasks = placed.select("path", "base").repartition(max(1, len(bases)), "path")
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(sequences, index, base: int):
    rows = (np.asarray(sequences.get_batch(k).column(0).flatten()) for k in range(sequences.num_record_batches))
    held, first = np.zeros(0, np.uint32), 0  # the ids from position `first` on
    for k in range(index.num_record_batches):
        part = index.get_batch(k)
        starts, lengths = np.asarray(part.column(1)), np.asarray(part.column(2))
        sums = []
        for start, length in zip(starts.tolist(), lengths.tolist(), strict=True):
            crc, at, left = 0, start, length
            while left:
                if at >= first + len(held):
                    first, held = first + len(held), next(rows).astype("<u4")
                    continue
                piece = held[at - first : at - first + left]
                crc = zlib.crc32(piece, crc)
                at, left = at + len(piece), left - len(piece)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + base), part.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
