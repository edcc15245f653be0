"""WARC archives whose records are compressed one by one against a dictionary of their own archive.

Every archive (``.warc.zst``) begins with a skippable frame that holds a Zstandard dictionary, built from the
first records of that archive; each record follows as a frame of its own, so a reader may start at any
record once it has the dictionary. Of pages with equal payloads one is archived in full, the others as
revisit records that name it.

A task writes under a name of its own attempt and reports the file when it is closed; only reported files
are read, so repeated or lost tasks leave nothing behind that counts.
"""

import base64
import hashlib
import io
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.storage import materialize

#: Fixed values of the formats: magic number of the dictionary's frame, profile of revisit records.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that a dictionary is built from, its size, and the compressed size at which a new archive starts.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 256 << 20
LEVEL = 3

_MANIFEST = "path string, n_records long, n_bytes long, part long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, refers_url: str, date: str) -> bytes:
    """A response record, or a revisit record where ``refers_to`` is given. ``digest``: hex SHA-1."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {_record_id(refers_to, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {refers_url}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; from too few or too small records, the records themselves."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class _Archive:
    """One open archive: the first records wait until the dictionary can be built from them."""

    def __init__(self, filesystem, path: str):
        self.filesystem, self.path = filesystem, path
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.n_records = self.n_bytes = 0
        self.sink = self.compressor = None

    def add(self, record: bytes) -> None:
        self.n_records += 1
        if self.compressor:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = build_dictionary(self.waiting)
        self.sink = self.filesystem.open_output_stream(self.path, compression=None)  # the records are compressed already
        self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for record in self.waiting:
            self._put(self.compressor.compress(record))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.sink.close()


def write_archives(pages: DataFrame, directory: str, least_payload: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives ``pages`` (page_id, url, html) below ``directory``, which all executors reach.

    The payload is the html in UTF-8; null is an empty one. Of equal payloads of at least ``least_payload``
    bytes the page with the largest id is archived in full and the others revisit it (rows that share that
    id are all archived in full). A null id is archived in full too; a null url is empty. Returns one row an
    archive: path, n_records, n_bytes, part. Other columns are not read; an empty table gives no archive.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    given = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    copies = given.where((F.col("size") >= least_payload) & F.col("page_id").isNotNull()).groupBy("digest", "size")
    first = copies.agg(F.max("page_id").alias("of"), F.max_by("url", "page_id").alias("of_url"), F.min("page_id").alias("least")).where("least < of").drop("least")
    # from files rather than from the same shuffle: the join can then split the pages of one payload
    placed = given.join(materialize(first, "first-pages"), ["digest", "size"], "left")
    revisit = F.col("of").isNotNull() & (F.col("page_id") < F.col("of"))
    rows = placed.select("page_id", "url", "html", "digest", F.when(revisit, F.col("of")).alias("of"), F.when(revisit, F.col("of_url")).alias("of_url"))

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        filesystem, root = pafs.FileSystem.from_uri(directory)
        filesystem.create_dir(root, recursive=True)
        archive, done = None, []

        def report():
            archive.close()
            done.append((archive.path, archive.n_records, archive.n_bytes))

        for batch in batches:
            for values in zip(*(batch.column(k) for k in range(6)), strict=True):
                page_id, url, payload, digest, of, of_url = (values[k].as_buffer().to_pybytes() if k == 2 else values[k].as_py() for k in range(6))
                if archive is None:
                    archive = _Archive(filesystem, f"{root}/pages-{part:06d}-{len(done):04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst")
                archive.add(_record(page_id, url, payload, digest, of, of_url, date))
                if archive.n_bytes >= ARCHIVE_BYTES:
                    report()
                    archive = None
        if archive is not None:
            report()
        if done:
            path, n_records, n_bytes = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"path": list(path), "n_records": pa.array(n_records, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "part": pa.array([part] * len(done), pa.int64())})

    return materialize(rows.mapInArrow(write, _MANIFEST), "archives")


def read_records(source) -> "Iterator[tuple[dict, bytes]]":  # noqa: F821
    """Headers and block of every record of an open archive, one at a time."""
    head = source.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(source.read(int.from_bytes(head[4:], "little")))
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not the begin of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(headers["content-length"]))
        stream.read(4)
        yield headers, block


def read_archives(archives: DataFrame, directory: str) -> DataFrame:
    """A row for each record of the reported ``archives``: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and payload (null for revisits). Payloads are checked against their digest."""

    def read(batches):
        filesystem, _ = pafs.FileSystem.from_uri(directory)
        names = [f.split()[0] for f in _READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with filesystem.open_input_stream(path, compression=None) as source:
                    for headers, block in read_records(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = headers["warc-type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload of {headers['warc-target-uri']} doesn't match its digest")
                        page, of = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((page and int(page), headers["warc-target-uri"], int(fields[b"Content-Length"]), digest, kind, of and int(of), payload if kind == "response" else None))
                        held += len(block)
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    # a count of its own: without one Spark puts the short list of paths, and with it all archives, into one task
    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(read, _READ)
