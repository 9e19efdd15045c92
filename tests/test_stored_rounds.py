"""What the rounds of types store is gone when they end, but for the types themselves."""

import os

import duckdb

from symdex.functions import workdir
from symdex.operators import type_rounds
from symdex.plans.store_queries import ORACLE_SQL, QUERIES, order_facts


def test_rounds_leave_their_types_alone(spark):
    root = workdir.ensure_checkpoint_dir(spark).removeprefix("file:") + "/symdex"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    type_rounds.typed(order_facts(spark, "/root/testdata/sf0.001"), ())
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"typed"}


def test_rounds_in_parts_free_their_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(type_rounds, "PART_CALLS", 2000)
    written, parts = type_rounds.written_in_parts, []
    monkeypatch.setattr(type_rounds, "written_in_parts", lambda *a: parts.append(a[3]) or written(*a))
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = [x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x]
        return {x: os.path.getsize(x) for x in files if os.path.exists(x)}

    before = shuffled()
    types = type_rounds.typed_and_kept(order_facts(spark, "/root/testdata/sf0.001"), ()).local_vars
    assert sum(n for x, n in shuffled().items() if x not in before) < 20_000
    assert set(parts) == {4}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")
    with duckdb.connect() as db:
        for t in ("orders", "lineitem"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        want = db.execute(ORACLE_SQL["x6_types_of_calls"]).fetchall()
    got = types.select("file_id", "name", "col", "type_hint", "confidence", "round").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_types_after_changes_leave_little_behind(spark):
    root = workdir.ensure_checkpoint_dir(spark).removeprefix("file:") + "/symdex"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    types = QUERIES["w6_types_after_changes"](spark, "/root/testdata/sf0.001")
    left = [x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before]
    assert "results" not in left and left.count("local_vars") == 2 and left.count("symbols") == 1
    with duckdb.connect() as db:
        for t in ("orders", "lineitem"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        want = db.execute(ORACLE_SQL["w6_types_after_changes"]).fetchall()
    assert sorted(map(str, map(tuple, types.collect()))) == sorted(map(str, want))
