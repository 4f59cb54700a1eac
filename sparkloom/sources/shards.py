"""Shards of training rows under a log of commits: a batch and stream source, and a batch and stream sink.

A task writes its rows into Parquet files of its own name, and the driver then adds
one file to the log that names them, so readers see all rows of a write or none.
What failed, repeated or speculative tasks leave is in no log file and is never
read. Every commit carries a name: the query and batch of a stream, the option
``txn`` of a batch write, or else one of its own. A commit whose name the log
already holds adds nothing and deletes its files, so a write that is replayed
leaves each row once.

Reading makes one partition of each shard. The log holds the least and largest
value of whole-number and short string columns of each shard, and shards that a
filter rules out by them are not read; Spark applies the filter to the rest.
A stream's offset is the number of commits it has read, so replaying a batch
gives the same shards.

Defined results: an empty write adds a commit without shards and keeps the schema;
nulls come back as nulls, and a column that is null all through a shard is
ruled out by every comparison; later writes have to have the columns of the
first; names are taken as they are. One writer at a time may commit to a path;
the log on the driver grows with the number of shards, not of rows. Paths are
those that ``pyarrow.fs`` opens, and have to be shared by driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructField, StructType

from sparkloom.session import ship

ROWS = 1_000_000
BYTES = 1 << 27
LONGEST = 64
PUSH = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Shard(InputPartition):
    """A file, its rows, and [least, largest] by column; of a column of nulls alone, an empty list."""

    file: str
    n: int
    limits: dict[str, list]

    def may_hold(self, f: Filter) -> bool:
        """False only where no row can meet the filter."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name not in self.limits or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)):
            return True
        if not self.limits[name]:
            return False
        least, largest = self.limits[name]
        inside = lambda v: v is not None and least <= v <= largest
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            return any(map(inside, f.value))
        if isinstance(f, EqualTo):
            return inside(f.value)
        if f.value is None:
            return False
        return {GreaterThan: largest > f.value, GreaterThanOrEqual: largest >= f.value, LessThan: least < f.value, LessThanOrEqual: least <= f.value}[type(f)]


@dataclass
class Written(WriterCommitMessage):
    shards: list[Shard] = field(default_factory=list)


class Log:
    """The commits of a path: <number>-<name>.json, each put in place by one rename."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def names(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/log", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def read(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.path}/log/{name}") as f:
            return json.loads(f.read())

    def shards(self, names: list[str]) -> list[Shard]:
        return [Shard(**s) for name in names for s in self.read(name)["shards"]]

    def commit(self, txn: str, schema: str, messages: list) -> None:
        names, shards = self.names(), [s for m in messages if m is not None for s in m.shards]
        if any(n.split("-", 1)[1] == f"{txn}.json" for n in names):
            return self.drop(messages)
        if names and self.read(names[0])["schema"] != schema:
            self.drop(messages)
            raise ValueError(f"the columns differ from those of the first write to {self.path}")
        self.fs.create_dir(f"{self.path}/log", recursive=True)
        made = f"{self.path}/log/{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(made) as f:
            f.write(json.dumps({"schema": schema, "shards": [vars(s) for s in shards]}).encode())
        self.fs.move(made, f"{self.path}/log/{len(names):012}-{txn}.json")

    def drop(self, messages: list) -> None:
        for m in messages:
            for s in m.shards if m is not None else ():
                self.fs.delete_file(f"{self.path}/data/{s.file}")


def limits(batch: pa.RecordBatch, so_far: dict[str, list]) -> dict[str, list]:
    """``so_far`` widened by a batch; a column of too long strings goes for good (None)."""
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        if batch.schema.names.count(name) > 1 or so_far.get(name, []) is None or not (text or pa.types.is_integer(column.type)):
            continue
        found = [v for v in pc.min_max(column).as_py().values() if v is not None] + so_far.get(name, [])
        so_far[name] = None if text and any(len(v) > LONGEST for v in found) else [min(found), max(found)] if found else []
    return so_far


class _Writer:
    def __init__(self, options: dict, schema: StructType):
        self.path, self.rows, self.bytes = options["path"], int(options.get("rows", ROWS)), int(options.get("bytes", BYTES))
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in schema]).json()
        self.txn = options.get("txn") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        log, done, out, size = Log(self.path), Written(), None, 0
        log.fs.create_dir(f"{log.path}/data", recursive=True)
        try:
            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                if out is None:
                    done.shards.append(Shard(f"{uuid.uuid4().hex}.parquet", 0, {}))
                    out = pq.ParquetWriter(f"{log.path}/data/{done.shards[-1].file}", batch.schema, filesystem=log.fs)
                    size = 0
                out.write_batch(batch)
                size += batch.nbytes
                last = done.shards[-1]
                last.n, last.limits = last.n + batch.num_rows, limits(batch, last.limits)
                if last.n >= self.rows or size >= self.bytes:
                    out.close()
                    out = None
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            log.drop([done])
            raise
        for s in done.shards:
            s.limits = {k: v for k, v in s.limits.items() if v is not None}
        return done


class BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages) -> None:
        Log(self.path).commit(self.txn, self.schema, messages)

    def abort(self, messages) -> None:
        Log(self.path).drop(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    """Give a stream's ``txn`` yourself: the same for each start of one query, another for each query."""

    def commit(self, messages, batchId: int) -> None:
        Log(self.path).commit(f"{self.txn}-{batchId}", self.schema, messages)

    def abort(self, messages, batchId: int) -> None:
        Log(self.path).drop(messages)


class _Reader:
    def rows(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        log = Log(self.path)
        with log.fs.open_input_file(f"{log.path}/data/{shard.file}") as f:
            yield from pq.ParquetFile(f).iter_batches()


class BatchReader(_Reader, DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.filters = filters
        yield from filters  # Spark applies them to the rows of the shards that are left

    def partitions(self) -> list[Shard]:
        log = Log(self.path)
        return [s for s in log.shards(log.names()) if all(map(s.may_hold, self.filters))]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition is not None else iter(())


class StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(Log(self.path).names())}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        log = Log(self.path)
        return log.shards(log.names()[start["commits"] : end["commits"]])

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition is not None else iter(())


class Shards(DataSource):
    """``spark.read.format("shards").load(path)``; options ``txn``, and ``rows`` or ``bytes`` after which a shard ends, for writing."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType:
        log = Log(self.options["path"])
        if not (names := log.names()):
            raise ValueError(f"nothing is committed to {self.options['path']}")
        return StructType.fromJson(json.loads(log.read(names[0])["schema"]))

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["path"])

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("shards are only added: use the mode append")
        return BatchWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        if "txn" not in self.options:
            raise ValueError("a stream needs the option txn, the same at each start")
        return StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format "shards" known, and let filters reach it."""
    ship(spark)
    spark.dataSource.register(Shards)
    spark.conf.set(PUSH, "true")


def write_shards(df: DataFrame, path: str, txn: str | None = None, rows: int = ROWS) -> DataFrame:
    """Add ``df`` to the shards of ``path`` as one commit; the table of all commits, as a DataFrame."""
    spark = df.sparkSession
    register(spark)
    options = {"rows": str(rows)} | ({"txn": txn} if txn else {})
    df.write.format("shards").options(**options).mode("append").save(path)
    return spark.read.format("shards").load(path)
