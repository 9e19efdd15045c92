"""Requests that own what they store, and their cancellation."""

import os
import threading
import time

from pyspark.sql import functions as F

from symdex.functions import relational as R
from symdex.functions import workdir


def folders(spark):
    root = workdir.ensure_checkpoint_dir(spark).removeprefix("file:").replace("//", "/") + "/symdex"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_request_takes_its_folders_with_it(spark):
    before = folders(spark)
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")
    with workdir.request(spark, "ask-1"):
        got = {(r["node"], r["depth"]) for r in R.closure(edges, spark.createDataFrame([("a",)], "node string"), 5).collect()}
        assert folders(spark) > before
    assert got == {("a", 0), ("b", 1), ("c", 2)} and folders(spark) == before


def test_a_cancelled_request_stops_and_leaves_nothing(spark):
    before, ended = folders(spark), []

    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    def ask():
        try:
            with workdir.request(spark, "ask-2"):
                workdir.written(spark.range(3), "first")
                edges = spark.range(4).select(F.col("id").cast("string").alias("child"), (F.col("id") + 1).cast("string").alias("parent")).mapInArrow(slow, "child string, parent string")
                R.closure(edges, spark.createDataFrame([("0",)], "node string"), 5).collect()
            ended.append("whole")
        except Exception as e:
            ended.append(type(e).__name__)

    t = threading.Thread(target=ask)
    t.start()
    time.sleep(6)
    assert not ended and folders(spark) > before
    began = time.perf_counter()
    workdir.cancel(spark, "ask-2")
    t.join(25)
    assert ended and ended != ["whole"] and time.perf_counter() - began < 15
    assert folders(spark) == before
