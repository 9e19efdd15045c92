"""The pipeline end to end on a small corpus with odd rows."""

import random

import corpus_pipeline as P
from symdex.llm import language_id


def test_stages_keep_their_promises(spark, odd_docs, no_docs, prose, tmp_path):
    docs = odd_docs.withColumn("lang", odd_docs["lang"])
    rows = [(100 + i, prose(60, 300 + i), "en" if i % 2 else "de", "s", 1, "k", "s", 1) for i in range(20)] + [(200, prose(60, 300) + " token = abcdef0123456789", "en", "s", 1, "k", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.createDataFrame([(1, " ".join(prose(60, 305).split()[:30]))], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in P.STAGES:
        before, df = df, stage(spark, df, str(tmp_path))
        df = df.cache()
        seen.append({r["doc_id"] for r in df.collect()})
        if stage is not P.STAGES[-1][1]:
            assert df.columns == docs.columns and df.schema.names == docs.schema.names
    assert seen[0].isdisjoint({2, 3, 5, 9}) and 1 in seen[0] and None in seen[0]
    assert 7 in seen[0] and 7 not in seen[1] and 100 in seen[1] and 200 not in seen[1]
    assert seen[1] - seen[2] == {105} and seen[2] == seen[3] == seen[4]
    assert P.run(spark, str(tmp_path)).count() == df.count()
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).collect() == []


def test_language_stage_drops_only_texts_without_a_language(spark):
    r = random.Random(6)
    own = {f"x{c}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(12)] for c in "abcdefgh"}
    rows = [(i, " ".join(r.choices(own[k], k=30)), k) for i, k in enumerate(list(own) * 10)]
    rows += [(200, " ".join(w[0] for w in own.values()), None), (201, "12345 !!!", "xa"), (202, None, "xa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {x["doc_id"]: x for x in language_id.predict(docs, language_id.train(docs)).collect()}
    assert found[200]["lang_pred"] != "und" and found[200]["score"] < 0.35
    assert {x["doc_id"] for x in P.identify_language(spark, docs, "").collect()} == set(found) - {201, 202}


def test_rows_that_share_an_id_but_not_the_text(spark, prose):
    a, b, c, d = (prose(60, 400 + i) for i in range(4))
    rows = [(5, a, "s"), (5, b, "s"), (5, b, "r"), (9, b, "s"), (7, a, "s"), (8, c, "s"), (8, d, "s"), (None, d, "s"), (3, c, "s")]
    got = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "").collect()
    assert sorted(map(tuple, got)) == sorted([(5, a, "s"), (5, b, "r"), (3, c, "s"), (8, d, "s")])


def test_columns_with_the_stages_own_names_and_long_texts(spark, prose, tmp_path):
    """Extra columns called as the stages call theirs, repeated ids with other texts, a very long text."""
    names = ["__lang", "__score", "__own", "__hash", "__first", "__last", "__id", "__n", "row", "key", "spans", "items", "digest", "shingles", "component_id"]
    long = "\n".join(prose(15, 9000 + i) for i in range(4000))
    texts = [(1, prose(60, 1)), (1, prose(60, 2)), (2, prose(60, 1)), (3, long), (4, long + " more"), (None, prose(60, 5)), (5, None), (6, "")]
    rows = [(i, t, "en", "s", 1, *["x"] * len(names)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "never said")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.schema.names == docs.schema.names
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in df.select("doc_id", "text").collect()))
    assert got == sorted([(1, texts[0][1]), (1, texts[1][1]), (3, long), (0, texts[5][1])])
