"""Tables, shared folders and Arrow helpers that the operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on one machine alone (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symdex-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Whether Spark deletes the shuffle files of a job's execution as it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Intermediate tables, written as Parquet in the shared folder so that a lost executor loses nothing.

    With `release`, the shuffle files that a table was made from are deleted when it is written.
    """

    def __init__(self, spark: SparkSession, label: str, release: bool = False):
        self.spark, self.root, self.n, self.release = spark, f"{shared_dir(spark)}/symdex/{label}-{uuid.uuid4().hex}", 0, release

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        if self.release:
            self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.release:
                self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._symdex_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table written here that nothing lazy reads any more."""
        path = getattr(df, "_symdex_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def keyed(df: DataFrame, key: str, rest: str) -> T.StructType:
    """A field `key` of that column's type, whatever it is, then the fields of a DDL text."""
    return T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string(rest).fields])


def held_out(key, parts: int, part: int):
    """crc32 of the key as text, mod `parts`, is `part`."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most max_rows and about max_bytes of text; a longer single row is a part of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.binary())), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > max_bytes or i - begin >= max_rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType, max_bytes: int = 1 << 21, max_rows: int = 4096) -> DataFrame:
    """mapInArrow in slices of bounded text and rows. `make` runs once per task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in batches:
            each = each or make()
            for part in slices(batch, column, max_bytes, max_rows):
                yield each(part)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts; null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
