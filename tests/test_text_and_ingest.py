"""Protocol columns and addresses, type names, and ingest in pieces."""

import os
import time

from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import text
from symdex.operators import writes
from symdex.sources import extract, scan
from symdex.streaming import ingest


def test_f18_columns_of_both_encodings(spark):
    lines = ["abc", "é = x", "a😀b", "日本語", ""]
    rows = [(t, n) for t in lines for n in range(len(t.encode()) + 2)]
    df = spark.createDataFrame(rows, "t string, n int").select("t", "n", text.utf16_column("t", "n").alias("u"), text.utf8_column("t", "n").alias("b"))

    def plain(t, n, size, other):
        a = b = 0
        for c in t:
            if a >= n:
                break
            a, b = a + size(c), b + other(c)
        return b

    utf8, utf16 = (lambda c: len(c.encode())), (lambda c: len(c.encode("utf-16-le")) // 2)
    for r in df.collect():
        assert r["u"] == plain(r["t"], r["n"], utf8, utf16) and r["b"] == plain(r["t"], r["n"], utf16, utf8), r


def test_f19_addresses(spark):
    paths = ["/a b/c+d.rb", "/ü/100%.rb", "/x~y_z-1.rb", "/[q]/#.rb"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.to_uri("p").alias("u"), text.from_uri(text.to_uri("p")).alias("back"), text.from_uri("p").alias("same"))
    rows = df.collect()
    assert all(r["back"] == r["same"] == r["p"] for r in rows)
    assert [r["u"] for r in rows][:3] == ["file:///a%20b/c%2Bd.rb", "file:///%C3%BC/100%25.rb", "file:///x~y_z-1.rb"]


def test_f21_place_of_an_offset(spark):
    t = "ab\n\né x\nlast"
    raw = t.encode()
    df = spark.createDataFrame([(t, n) for n in range(len(raw) + 3)], "t string, n int").select("n", text.place_of_offset("t", "n").alias("p"))
    for r in df.collect():
        before = raw[: r["n"]]
        assert tuple(r["p"]) == (before.count(b"\n") + 1, len(before) - before.rfind(b"\n") - 1), r


def test_f15_generic_types(spark):
    df = spark.createDataFrame([("Hash[Symbol, Array[String]]",), ("[Post]",), ("String",), ("Array[A::B]",)], "t string").select(text.generic_type("t").alias("g"))
    assert [(r["g"]["base"], r["g"]["args"]) for r in df.collect()] == [("Hash", ["Symbol", "Array[String]"]), ("Array", ["Post"]), ("String", []), ("Array", ["A::B"])]


def test_w6_t11_ingest_in_batches(spark, tmp_path):
    root, out = tmp_path / "src", str(tmp_path / "out")
    root.mkdir()
    for i in range(7):
        (root / f"m{i}.rb").write_text(f"class M{i}\n  include Track\n  def go(a); end\nend\n")
    told = []
    listener = ingest.Progress(lambda name, n: told.append(n), every=3)
    spark.streams.addListener(listener)
    try:
        ingest.ingest(spark, str(root), out, str(tmp_path / "cp"), files_per_batch=3).awaitTermination()
        assert sorted(x for x in os.listdir(out)) == ["batch=0", "batch=1", "batch=2"]
        facts = ingest.ingested(spark, out)
        assert facts.files.count() == 7 and facts.symbols.where("kind = 'class'").count() == 7 and facts.params.count() == 7 and facts.mixins.count() == 7
        until = time.time() + 20
        while not told and time.time() < until:
            time.sleep(0.2)
        assert told and told == sorted(told)
    finally:
        spark.streams.removeListener(listener)


def test_t4_many_changes_mean_a_new_scan(spark, tmp_path):
    (tmp_path / "a.rb").write_text("class A; end\n")
    (tmp_path / "b.rb").write_text("class B; end\n")
    rows = scan.scan(spark, str(tmp_path))
    facts = extract.extract(rows)
    (tmp_path / "b.rb").write_text("class Bee; end\n")
    pending = spark.createDataFrame([("b.rb",), ("b.rb",)], "path string")
    read = lambda paths: scan.scan(spark, str(tmp_path)).join(paths, "path", "left_semi")
    never = lambda: (_ for _ in ()).throw(AssertionError())
    after = ingest.apply_pending(facts, pending, read, never, most=1)
    assert {r["name"] for r in after.symbols.collect()} == {"A", "Bee"} and after.files.count() == 2
    assert ingest.apply_pending(facts, pending.unionByName(spark.createDataFrame([("a.rb",)], "path string")), read, lambda: "scanned", most=1) == "scanned"


def test_w7_w8_rename_and_json(spark, facts, tmp_path):
    moved = writes.rename_file(facts, "app/user.rb", "app/member.rb")
    assert {r["path"] for r in moved.files.collect()} == {"app/member.rb", "app/order.rb", "gems/base.rb"}
    left = writes.remove_prefix(facts, "gems/")
    assert {r["path"] for r in left.files.collect()} == {"app/user.rb", "app/order.rb"} and left.symbols.where("file_id = 3").count() == 0 and left.mixins.count() == 2
    facts.save(str(tmp_path / "facts"))
    from symdex.operators import health

    health.dump_symbols(Facts.load(spark, str(tmp_path / "facts"))).write.text(str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert back.count() == facts.symbols.where(F.col("file_id") != 3).count() and {"path", "name", "kind", "line", "col"} <= set(back.columns)
