"""A store of numbered samples: a Python data source that finds an id by an index of ranges.

    spark.dataSource.register(SampleStore)
    samples.write.format("vellum_samples").mode("append").save("/store")        # (sample_id, content, label)
    spark.read.format("vellum_samples").load("/store").where("sample_id = 7")    # opens the file that holds 7

Every task writes one Parquet file of its samples and tells its range of ids; the driver keeps the ranges, a row for each file. Filters
on sample_id choose files before anything is read. An id whose content is damaged gives the next sample that isn't.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from vellumgrid.sources.images import NotAnImage, decoded

STORED = pa.schema([("sample_id", pa.int64()), ("content", pa.binary()), ("label", pa.string())])
FOUND = pa.schema([("sample_id", pa.int64()), ("found_id", pa.int64()), ("content", pa.binary()), ("label", pa.string())])
ROWS = 1024
LEAST, MOST = -(1 << 62), 1 << 62


def whole(content: bytes | None) -> bool:
    """A sample whose image can be decoded."""
    try:
        return content is not None and decoded(content).size > 0
    except NotAnImage:
        return False


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Ids wanted from one file of the index."""

    place: int
    low: int
    high: int
    ids: frozenset[int] | None


@dataclass
class Stored(WriterCommitMessage):
    name: str
    low: int
    high: int
    n: int


class SampleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.low, self.high = LEAST, MOST
        self.ids: frozenset[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds and lists of sample_id are wholly done here; the rest is Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("sample_id",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                ids = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def index(self) -> list[tuple[int, int, str]]:
        """(first id, last id, file) by first id; the commits of all writers together."""
        store, base = opened(self.path)
        found = []
        for info in store.get_file_info(arrow_fs.FileSelector(base)):
            if info.base_name.startswith("index-"):
                with store.open_input_file(info.path) as f:
                    found += [(x["low"], x["high"], x["name"]) for x in json.loads(f.read())]
        return sorted(found)

    def partitions(self) -> list[Range]:
        wanted = sorted(self.ids) if self.ids is not None else None
        out = []
        for k, (low, high, _) in enumerate(self.index()):
            low, high = max(low, self.low), min(high, self.high)
            if low > high:
                continue
            own = None
            if wanted is not None:
                own = frozenset(wanted[bisect_left(wanted, low) : bisect_left(wanted, high + 1)])
                if not own:
                    continue
            out.append(Range(k, low, high, own))
        return out

    def _rows(self, name: str, low: int, high: int) -> Iterator[tuple[int, bytes | None, str | None]]:
        store, base = opened(self.path)
        with store.open_input_file(posixpath.join(base, name)) as f:
            file = pq.ParquetFile(f)
            for batch in file.iter_batches(ROWS):
                ids = batch.column("sample_id")
                part = batch.filter(pc.and_(pc.greater_equal(ids, low), pc.less_equal(ids, high)))
                yield from zip(*(part.column(c).to_pylist() for c in STORED.names))

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        """Samples of one file by id; ids in a damaged run at its end go on to the next files, which are read as far as that takes."""
        if partition is None:  # nothing is wanted
            return
        index = self.index()
        waiting: list[int] = []
        ready: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*ready)) or [[]] * len(FOUND)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, FOUND)], schema=FOUND)

        for k in range(partition.place, len(index)):
            own = k == partition.place
            for number, content, label in self._rows(index[k][2], partition.low, MOST):
                asked = own and number <= partition.high and (partition.ids is None or number in partition.ids)
                if asked:
                    waiting.append(number)
                if waiting and whole(content):
                    ready += [(x, number, content, label) for x in waiting]
                    waiting = []
                    if len(ready) >= ROWS:
                        yield sent()
                        ready = []
                if not waiting and (not own or number >= partition.high):
                    break
            if not waiting:
                break
        ready += [(x, None, None, None) for x in waiting]
        yield sent()


class SampleWriter(DataSourceWriter):
    """A task's samples, sorted by id as they come, go to a Parquet file with a name of its own; commit lists only files of tasks that ended
    well, so files of lost attempts are never read."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> Stored:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        name, low, high, n = f"part-{uuid.uuid4().hex}.parquet", MOST, LEAST, 0
        sink, writer, held = None, None, []

        def put() -> None:
            nonlocal sink, writer, held
            if held:
                if writer is None:
                    sink = store.open_output_stream(posixpath.join(base, name))
                    writer = pq.ParquetWriter(sink, STORED)
                writer.write_batch(pa.RecordBatch.from_pylist(held, schema=STORED))
                held = []

        for row in iterator:
            number = row["sample_id"]
            if n and number < high:
                raise ValueError("samples of a task must be in the order of sample_id")
            low, high, n = min(low, number), number, n + 1
            held.append({"sample_id": number, "content": bytes(row["content"]) if row["content"] is not None else None, "label": row["label"]})
            if len(held) == ROWS:
                put()
        put()
        if writer:
            writer.close()
            sink.close()
        return Stored(name, low, high, n)

    def commit(self, messages: list[Stored | None]) -> None:
        store, base = opened(self.path)
        kept = [{"low": m.low, "high": m.high, "name": m.name} for m in messages if m and m.n]
        own = posixpath.join(base, f"_{uuid.uuid4().hex}")
        with store.open_output_stream(own) as f:
            f.write(json.dumps(kept).encode())
        store.move(own, posixpath.join(base, f"index-{uuid.uuid4().hex}.json"))


class SampleStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_samples"

    def schema(self) -> str:
        return "sample_id long, found_id long, content binary, label string"

    def reader(self, schema) -> SampleReader:
        return SampleReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> SampleWriter:
        return SampleWriter({k.lower(): v for k, v in self.options.items()})


def write_store(samples: DataFrame, path: str) -> None:
    """Write (sample_id, content, label) by ranges of ids. Ids are unique."""
    samples.sparkSession.dataSource.register(SampleStore)
    own = samples.select(F.col("sample_id").cast("long"), F.col("content").cast("binary"), F.col("label").cast("string"), F.lit(None).cast("long").alias("found_id"))
    own.repartitionByRange("sample_id").sortWithinPartitions("sample_id").select("sample_id", "found_id", "content", "label").write.format("vellum_samples").mode("append").save(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, found_id, content, label): of each id the first whole sample from it on; nulls where none follows."""
    spark.dataSource.register(SampleStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("vellum_samples").load(path)
