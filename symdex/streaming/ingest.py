"""Ingest in bounded pieces: files of a folder as they come, a bounded queue of changed paths, and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from symdex import schema as S
from symdex.facts import Facts
from symdex.functions.workdir import written
from symdex.operators import hierarchy, trigrams
from symdex.operators.type_rounds import retyped, typed
from symdex.operators.writes import file_id, remove_files, replace_files
from symdex.sources import scan
from symdex.sources.extract import parsed

#: Files to a batch, and changed paths beyond which a folder is scanned anew instead (fixed values).
FILES_PER_BATCH, MOST_PENDING = 500, 10_000


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, files_per_batch: int = FILES_PER_BATCH, trigger: dict | None = None) -> StreamingQuery:
    """Store what new files of a folder say, at most `files_per_batch` at once. Each batch has its own folder, so one that runs twice leaves one copy.

    Types that depend on other files are no part of a batch: `ingested` gives them over all batches.
    """
    schema = spark.read.format("binaryFile").load(root).schema
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", scan.NAME_GLOB).option("maxFilesPerTrigger", files_per_batch).load(root)

    def each(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("path", scan._relative(root)).where(scan.wanted("path") & (F.col("length") <= scan.MAX_BYTES))
        rows = rows.select("path", F.unix_millis("modificationTime").alias("mtime_ms"), F.xxhash64("content").alias("content_hash"), F.decode("content", "UTF-8").alias("text"))
        parsed(rows).save(f"{out}/batch={n}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, out: str) -> Facts:
    """The facts of all batches, typed as one; a file that came twice counts as it came last. The caller saves them."""
    tables = {t: spark.read.option("basePath", out).schema(T.StructType([*S.schema(t).fields, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/batch=*/{t}") for t in S.names()}
    last = tables["files"].groupBy("id").agg(F.max("batch").alias("batch"))
    by_file = {t: df.join(last.withColumnRenamed("id", "file_id"), ["file_id", "batch"], "left_semi") for t, df in tables.items() if "file_id" in df.columns}
    symbols = by_file["symbols"].select(F.col("id").alias("symbol_id"), "batch")
    rest = {"files": tables["files"].join(last, ["id", "batch"], "left_semi"), "params": tables["params"].join(symbols, ["symbol_id", "batch"], "left_semi"), "mixins": tables["mixins"].join(symbols.withColumnRenamed("symbol_id", "class_id"), ["class_id", "batch"], "left_semi"), "meta": tables["meta"].dropDuplicates(["key"])}
    return typed(Facts(spark, **by_file, **rest))


def apply_pending(facts: Facts, pending: DataFrame, read: Callable[[DataFrame], DataFrame], rescan: Callable[[], Facts], most: int = MOST_PENDING) -> Facts:
    """The facts after changes of some paths (path), typed as a whole scan would. More than `most` of them mean a new scan of all, which costs less than keeping up.

    `read` gives the scan rows of paths; a path that it has no row of is gone. Only most + 1 paths are counted.
    """
    paths = pending.select("path").distinct()
    if paths.limit(most + 1).count() > most:
        return rescan()
    rows = written(read(paths), "changed")
    changed = paths.select(file_id().alias("file_id"))
    gone = paths.join(rows.select("path"), "path", "left_anti").select(file_id().alias("file_id"))
    after = retyped(facts, replace_files(remove_files(facts, gone), parsed(rows)), changed)
    return trigrams.carried(facts, hierarchy.carried(facts, after), changed)


class Progress(StreamingQueryListener):
    """Calls `tell(query name, files so far)` whenever another `every` rows have been taken in."""

    def __init__(self, tell: Callable[[str, int], None], every: int = 25):
        self.tell, self.every, self.seen = tell, every, {}

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        before = self.seen.get(key, 0)
        self.seen[key] = before + event.progress.numInputRows
        if self.seen[key] // self.every > before // self.every:
            self.tell(event.progress.name or key, self.seen[key])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.seen.pop(str(event.id), None)
