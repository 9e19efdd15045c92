"""The folder that driver and executors share, for what an operator stores between its steps, and requests that own what
they store: a request can be cancelled from elsewhere, and takes its folders with it when it ends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark deletes the shuffle files of a job's execution as it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that the request of this thread has stored; none outside of requests, where the caller clears the shared folder.
_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder a session has set itself; on one machine alone one of our own, elsewhere an error."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symdex-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows of df as Parquet in the shared folder, one folder for each value of the columns `by`."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/symdex/{name}-{uuid.uuid4().hex}"
    if (mine := _folders.get()) is not None:
        mine.append(path)  # before it is written, so that what a cancelled write leaves goes too
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._symdex_path = path
    return out


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as each execution ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written_in_parts(spark: SparkSession, make: Callable[[Column, int], DataFrame], by: str, parts: int, name: str) -> DataFrame:
    """The rows of `make` as Parquet in the shared folder, made a part of its input at a time: what is shuffled for a part is deleted before the next.

    `make` gets the condition on the column `by` that rows of a part meet, and the part's number.
    """
    path = f"{ensure_checkpoint_dir(spark)}/symdex/{name}-{uuid.uuid4().hex}"
    if (mine := _folders.get()) is not None:
        mine.append(path)
    with released(spark):
        for i in range(parts):
            df = make(F.lit(True) if parts == 1 else F.pmod(F.xxhash64(by), F.lit(parts)) == i, i)
            df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._symdex_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing lazy reads any more."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._symdex_path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept in the shared folder: plans that go on from here start anew."""
    return written(df, "stored")


@contextmanager
def request(spark: SparkSession, tag: str) -> Iterator[None]:
    """What this thread runs inside is one request: its jobs have a tag, and what it stores is deleted at the end.

    Rows that are to stay are collected or written to a place of the caller's inside of it.
    """
    mine = _folders.set([])
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _folders.get():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        _folders.reset(mine)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs of a request, from any thread; its own thread gets the error of a cancelled job."""
    spark.sparkContext.cancelJobsWithTag(tag)
