"""A message log in a shared folder as a Spark data source, batch and stream.

``spark.dataSource.register(MessageLog)``, then ``format("message_log")`` with
the option ``path``. Messages are text in ``value``; reading adds their
``offset``, 0, 1, 2, ... in the order of commits, tasks and rows.

Every task writes one segment; the commit gives its messages their offsets with
one small file whose name holds the first offset and the number of messages, so
the end of the log is known from names. What is not committed is not in the log.
A streaming batch that is repeated after a failure finds its commit and adds
nothing. One query writes to a log at a time; ``writer`` names it (a streaming
writer keeps its name over restarts, and no other uses it).

``per_trigger`` bounds the messages of a micro-batch; the option ``reader`` then
names the query, whose position is kept beside the log, because a restarted
source is not told it. With ``availableNow`` one trigger is all there is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType


@dataclass
class Segment(InputPartition, WriterCommitMessage):
    """Messages ``lo`` to ``hi`` (exclusive) of one file whose first has the
    offset ``base``."""

    file: str
    base: int
    lo: int
    hi: int


@dataclass
class Commit:
    first: int
    rows: int
    writer: str
    batch: int
    name: str


class Folder:
    """Files of one log."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("a message log needs the option path")
        self.path = options["path"].rstrip("/")

    def _at(self, *names: str):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.path)
        return fs, "/".join([root, *names])

    def write_json(self, value, *names: str) -> None:
        """Appears whole or not at all."""
        fs, target = self._at(*names)
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        _, draft = self._at(f".{uuid.uuid4().hex}")
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(value).encode())
        fs.move(draft, target)

    def read_json(self, *names: str):
        fs, target = self._at(*names)
        with fs.open_input_stream(target) as src:
            return json.loads(src.read())

    def has(self, *names: str) -> bool:
        from pyarrow.fs import FileType

        fs, target = self._at(*names)
        return fs.get_file_info(target).type == FileType.File

    def commits(self) -> list[Commit]:
        """In order, from the names alone."""
        from pyarrow.fs import FileSelector

        fs, folder = self._at("commits")
        names = sorted(f.base_name for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".json"))
        parts = [(n, n.removesuffix(".json").split("-")) for n in names]
        return sorted((Commit(int(p[0]), int(p[1]), p[2], int(p[3]), n) for n, p in parts), key=lambda c: (c.first, c.first + c.rows))

    def end(self) -> int:
        return max((c.first + c.rows for c in self.commits()), default=0)

    def segments(self, start: int, end: int) -> list[Segment]:
        """What holds the messages from ``start`` to ``end``; only commits that
        do are opened."""
        out = []
        for c in self.commits():
            if c.first < end and c.first + c.rows > start:
                base = c.first
                for file, rows in self.read_json("commits", c.name):
                    lo, hi = max(start - base, 0), min(end - base, rows)
                    if lo < hi:
                        out.append(Segment(file, base, lo, hi))
                    base += rows
        return out

    def append(self, batches: Iterator, column: int) -> Segment:
        """One task's messages as one segment."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, folder = self._at("segments")
        fs.create_dir(folder, recursive=True)
        file, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for b in batches:
            if b.num_rows:
                t = pa.table({"value": b.column(column).cast(pa.string())})
                out = out or pq.ParquetWriter(f"{folder}/{file}", t.schema, filesystem=fs)
                out.write_table(t)
                rows += b.num_rows
        if out:
            out.close()
        return Segment(file, 0, 0, rows)

    def drop(self, written: list[Segment | None]) -> None:
        for s in written:
            if s is not None and s.hi:
                fs, file = self._at("segments", s.file)
                fs.delete_file(file)

    def commit(self, written: list[Segment | None], writer: str, batch: int) -> None:
        """Gives the messages their offsets; a batch that has them adds nothing."""
        before = self.commits()
        if any(c.writer == writer and c.batch >= batch for c in before):
            return self.drop(written)
        new = [(s.file, s.hi) for s in written if s is not None and s.hi]
        first, rows = max((c.first + c.rows for c in before), default=0), sum(n for _, n in new)
        self.write_json(new, "commits", f"{first:020d}-{rows:020d}-{writer}-{batch}.json")

    def read(self, part: Segment) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, file = self._at("segments", part.file)
        at = 0
        with pq.ParquetFile(fs.open_input_file(file)) as src:
            for b in src.iter_batches(batch_size=8192):
                lo, hi = max(part.lo - at, 0), min(part.hi - at, b.num_rows)
                if lo < hi:
                    offsets = pa.array(range(part.base + at + lo, part.base + at + hi), pa.int64())
                    yield pa.RecordBatch.from_arrays([offsets, b.column(0).slice(lo, hi - lo)], names=["offset", "value"])
                at += b.num_rows


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.log = Folder(options)

    def partitions(self):
        # a log without messages still needs a partition to be read from
        return self.log.segments(0, self.log.end()) or [Segment("", 0, 0, 0)]

    def read(self, partition):
        return self.log.read(partition) if partition.hi else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.log, self.name = Folder(options), options.get("reader")
        self.rate = int(options.get("per_trigger", 0))
        if self.rate and not self.name:
            raise ValueError("per_trigger needs the option reader")
        self.at: int | None = None

    def initialOffset(self):
        self._move(0)
        return {"offset": 0}

    def _move(self, at: int) -> None:
        self.at = at
        if self.rate:
            self.log.write_json(at, "readers", f"{self.name}.json")

    def latestOffset(self):
        end = self.log.end()
        if self.rate:
            if self.at is None:
                self.at = self.log.read_json("readers", f"{self.name}.json") if self.log.has("readers", f"{self.name}.json") else 0
            end = min(end, self.at + self.rate)
        return {"offset": end}

    def partitions(self, start, end):
        self._move(end["offset"])
        return self.log.segments(start["offset"], end["offset"]) or [Segment("", 0, 0, 0)]

    def read(self, partition):
        return self.log.read(partition) if partition.hi else iter(())


class _Append:
    def __init__(self, options, schema: StructType):
        if "value" not in schema.names:
            raise ValueError("messages are written from the column value")
        self.log, self.column = Folder(options), schema.names.index("value")
        self.writer = options.get("writer", "stream")
        if not self.writer.isalnum():
            raise ValueError("a writer's name consists of letters and digits")

    def write(self, iterator):
        return self.log.append(iterator, self.column)


class _Writer(_Append, DataSourceArrowWriter):
    def commit(self, messages):
        self.log.commit(messages, uuid.uuid4().hex, 0)

    def abort(self, messages):
        self.log.drop(messages)


class _StreamWriter(_Append, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId):
        self.log.commit(messages, self.writer, batchId)

    def abort(self, messages, batchId):
        self.log.drop(messages)


class MessageLog(DataSource):
    @classmethod
    def name(cls):
        return "message_log"

    def schema(self):
        return "offset long, value string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a message log is only appended to")
        return _Writer(self.options, schema)

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options, schema)
