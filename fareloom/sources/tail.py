"""A table's new rows by id as a stream: the last id read is the offset, so that a restart goes on behind it.

Register once a session: ``spark.dataSource.register(TailById)``; then ``spark.readStream.format("tail_by_id").schema(...)
.option("path", folder).option("id", column).load()``. The folder holds Parquet files; rows that appear with an id greater than all before are
new. Rows that are added later under an older id are not seen, as by any reader that asks for ids beyond the last.
"""

from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

#: Row groups that one task reads.
GROUPS_A_TASK = 8


@dataclass
class Span(InputPartition):
    """Row groups of one file, and the ids that are wanted from them: beyond ``after`` up to ``upto``."""

    path: str
    groups: tuple[int, ...]
    after: int
    upto: int


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class TailReader(DataSourceStreamReader):
    """Plans on the driver from the files' footers, which are read once a file; rows are read by the tasks."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.column = schema, options["path"], options.get("id", "id")
        self.first = int(options.get("after", 0))
        self._footers: dict[tuple, list[tuple[int, int, int]]] = {}

    def _files(self) -> dict[str, list[tuple[int, int, int]]]:
        """Of each file the row groups with their least and greatest id."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, root = _open(self.path)
        found = {}
        for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            hidden = any(part.startswith(("_", ".")) for part in info.path[len(root) :].split("/"))
            if info.type != fs.FileType.File or hidden or not info.path.endswith(".parquet"):
                continue
            key = (info.path, info.size, info.mtime_ns)
            if key not in self._footers:
                with files.open_input_file(info.path) as source:
                    meta = pq.ParquetFile(source).metadata
                    at = meta.schema.names.index(self.column)
                    stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                    if any(s is None or not (s.has_min_max or s.null_count) for s in stats):
                        raise ValueError(f"{info.path} has no statistics of {self.column}")
                    self._footers[key] = [(g, s.min, s.max) for g, s in enumerate(stats) if s.has_min_max]
            found[info.path] = self._footers[key]
        return found

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def latestOffset(self) -> dict:
        return {"id": max([self.first, *(most for groups in self._files().values() for _, _, most in groups)])}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        after, upto = start["id"], end["id"]
        spans = []
        for path, groups in sorted(self._files().items()):
            wanted = [g for g, least, most in groups if most > after and least <= upto]
            spans += [Span(path, tuple(wanted[k : k + GROUPS_A_TASK]), after, upto) for k in range(0, len(wanted), GROUPS_A_TASK)]
        return spans

    def read(self, partition: Span):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        files, _ = _open(self.path)
        schema = to_arrow_schema(self.schema)
        with files.open_input_file(partition.path) as source:
            file = pq.ParquetFile(source)
            columns = list(dict.fromkeys([*self.schema.names, self.column]))
            for batch in file.iter_batches(row_groups=list(partition.groups), columns=[c for c in columns if c in file.schema_arrow.names]):
                ids = batch.column(self.column)
                kept = batch.filter(pc.and_(pc.greater(ids, partition.after), pc.less_equal(ids, partition.upto)))
                if len(kept):
                    arrays = [kept.column(f.name).cast(f.type) if f.name in kept.schema.names else pa.nulls(len(kept), f.type) for f in schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def commit(self, end: dict) -> None:
        pass


class TailById(DataSource):
    """The stream source ``tail_by_id``: options path, id (column, default id) and after (ids up to which nothing is read)."""

    @classmethod
    def name(cls) -> str:
        return "tail_by_id"

    def schema(self) -> str:
        raise ValueError("give the table's schema to the reader")

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(schema, dict(self.options))


class Heartbeat(StreamingQueryListener):
    """Calls ``send`` with what happened: new rows of a micro-batch, or that there were none since the last one.

    Spark reports idle queries as often as ``spark.sql.streaming.noDataProgressEventInterval`` says.
    """

    def __init__(self, send):
        self.send = send

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        kind = "update" if progress.numInputRows else "no_update"
        self.send({"type": kind, "rows": progress.numInputRows, "at": progress.timestamp})

    def onQueryIdle(self, event) -> None:
        self.send({"type": "no_update", "rows": 0, "at": event.timestamp})

    def onQueryTerminated(self, event) -> None:
        pass
