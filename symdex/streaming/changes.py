"""Change feeds: version gate, debounce, tombstones, rate limit, and incremental replacement of facts by file.

The batch functions take rows in arrival order (`seq`); the streaming ones run the same rules over micro-batches
with foreachBatch, so that a replayed batch gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

CREATED, CHANGED, DELETED = 1, 2, 3
CHANGE_SCHEMA = "uri string, version bigint, change_type int, text string, ts timestamp, seq bigint"


def accepted(changes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Changes whose version is above all that came before for their uri, and above the stored (uri, version)."""
    before = F.max("version").over(W.partitionBy("uri").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    rows = changes.withColumn("__b", before)
    if stored is not None:
        rows = rows.join(stored.select("uri", F.col("version").alias("__s")), "uri", "left").withColumn("__b", F.greatest("__b", "__s")).drop("__s")
    return rows.where(F.col("__b").isNull() | (F.col("version") > F.col("__b"))).drop("__b")


def live(changes: DataFrame) -> DataFrame:
    """The last accepted state of each uri; those deleted last are tombstones, and absent until created again."""
    last = changes.groupBy("uri").agg(F.max_by(F.struct("version", "change_type", "text", "ts", "seq"), "seq").alias("x")).select("uri", "x.*")
    return last.where(F.col("change_type") != DELETED)


def tombstones(changes: DataFrame) -> DataFrame:
    return changes.groupBy("uri").agg(F.max_by("change_type", "seq").alias("last")).where(F.col("last") == DELETED).select("uri")


def debounced(changes: DataFrame, quiet: str = "150 milliseconds", watermark: str = "1 second") -> DataFrame:
    """The last change of each burst: a burst ends when its uri was quiet. Works on batches and on streams."""
    rows = changes.withWatermark("ts", watermark) if changes.isStreaming else changes
    out = rows.groupBy("uri", F.session_window("ts", quiet)).agg(F.max_by(F.struct("version", "change_type", "text", "seq"), F.struct("ts", "seq")).alias("x"), F.count(F.lit(1)).alias("n"))
    return out.select("uri", F.col("session_window.end").alias("flushed_at"), "n", "x.*")


def new_contents(changes: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """One of the changes that give a uri a content it had already."""
    rows = changes.withColumn("content_hash", F.xxhash64("text"))
    return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["uri", "content_hash"]) if changes.isStreaming else rows.dropDuplicates(["uri", "content_hash"])


def rate_limited(requests: DataFrame, most: int = 100, window_ms: int = 1000) -> DataFrame:
    """(client, ts_ms, seq, allowed): a window begins with the first request after the one before has ended.

    Where windows begin depends on the request before. Requests are dealt by client and sorted, and a task goes through
    them once, holding only the client's window and count; within a window all beyond `most` are refused.
    """
    rows = requests.select("client", "ts_ms", "seq")
    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(batches):
        now, start, n = None, None, 0
        for batch in batches:
            allowed = []
            for client, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if start is None or client != now or ts - start > window_ms:
                    now, start, n = client, ts, 0
                n += 1
                allowed.append(n <= most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], schema.names)

    return rows.repartition("client").sortWithinPartitions("client", "ts_ms", "seq").mapInArrow(run, schema)


#: Batches between two snapshots of the stored versions.
SNAPSHOT_EVERY = 16


def run_gate(changes: DataFrame, state_path: str, checkpoint: str, apply: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Start a stream of changes: each micro-batch is gated by the stored versions, applied, and its versions stored.

    Versions are kept one folder a batch, so a batch that runs twice overwrites its own and no other. Every
    SNAPSHOT_EVERY batches all versions before are put into one snapshot; what is older than the snapshot before goes,
    so a batch reads one snapshot and at most twice as many small folders, however long the stream has run.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n and n % SNAPSHOT_EVERY == 0:
            _snapshot(spark, state_path, n)
        ok = accepted(batch, _stored(spark, state_path, n)).persist()
        try:
            apply(ok, n)
            ok.groupBy("uri").agg(F.max("version").alias("version")).write.mode("overwrite").parquet(f"{state_path}/changes/batch={n}")
        finally:
            ok.unpersist()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, path: str) -> tuple[list[int], Callable[[int], None]]:
    """(numbers of the finished batch folders in a folder, a function that deletes one)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    numbers = sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and done(p))
    return numbers, lambda n: fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"batch={n}"), True)


def _snapshot(spark: SparkSession, state_path: str, n: int) -> None:
    state = _stored(spark, state_path, n)
    if state is not None:
        state.write.mode("overwrite").parquet(f"{state_path}/snapshots/batch={n}")
    snapshots, drop_snapshot = _folders(spark, f"{state_path}/snapshots")
    keep = max([s for s in snapshots if s < n], default=0)  # a batch that is run again may still need it
    changes, drop_changes = _folders(spark, f"{state_path}/changes")
    for s in snapshots:
        if s < keep:
            drop_snapshot(s)
    for c in changes:
        if c < keep:
            drop_changes(c)


def _stored(spark: SparkSession, state_path: str, before: int) -> DataFrame | None:
    """(uri, version) after all batches before one: the last snapshot before it and the changes since."""
    snapshot = max([s for s in _folders(spark, f"{state_path}/snapshots")[0] if s < before], default=None)
    changes = [c for c in _folders(spark, f"{state_path}/changes")[0] if (snapshot or 0) <= c < before]
    paths = [f"{state_path}/snapshots/batch={snapshot}"] * (snapshot is not None) + [f"{state_path}/changes/batch={c}" for c in changes]
    if not paths:
        return None
    return spark.read.schema("uri string, version bigint").parquet(*paths).groupBy("uri").agg(F.max("version").alias("version"))
