r"""Operator 12: how far the word use of each source of a language is from that of each other source, and which words make it so.

1. One pass over the texts counts terms by (lang, source) and the texts that hold them; a task adds up what it reads
   in a table of a bounded size before anything is shuffled, once, by (lang, term). Counts of a (lang, source, term) are
   summed, then those of a (lang, term), whose list of (source, count) has one entry for each source that uses the term.
2. Terms with the same list are one row with a multiplicity. From these rows each two sources that share a term get
   their joint histogram: distinct (count, count) combinations with the number of terms that have them. Combinations
   in which one count or both are 0 are implied: they follow from each source's own histogram, the joint one and the
   size of the vocabulary, and no row is made for a term that a source doesn't use.
3. The divergence is evaluated once for each combination and multiplied by the number of its terms.

Terms are [^\x00-\x40\x5B-\x60\x7B-\x7F]+ with A-Z in lower case. A null text, lang or source counts as empty. Each row
of the table is a text of its own, also where rows repeat. A group without terms counts 0 for every kept term; a
language without kept terms has the value 0 for each pair of its sources. Ties are ordered by the item's UTF-8 bytes.
An empty table gives no rows. Further columns are not looked at. All arithmetic is on whole numbers, decimal where a
product may not fit 64 bits.

The result has a row for each two sources of a language, so what is made for pairs grows no faster than the result
times the distinct counts of a source, and the list of a term is no longer than the sources of its language.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symdex.llm.shared import Workspace, bytes_of, slices, table

#: Terms that a task holds before it gives them out, and bytes of a text that are split at once.
HELD_TERMS, PIECE = 1 << 19, 1 << 22
#: Bytes of terms as they are, A-Z in lower case, all others as spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SCALE = 1_000_000_000


def pieces(text: bytes, size: int = PIECE):
    """The terms of a text, some bytes of it at a time."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= size else text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _group(docs: DataFrame, lang: str, source: str) -> list[Column]:
    return [F.coalesce(docs[c].cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]


def term_counts(docs: DataFrame, lang: str, source: str, text: str, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): partial counts, several rows a term."""

    def run(batches):
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def given():
            rows = [(*g, t, c, own[t]) for g, (n, own) in seen.items() for t, c in n.items()]
            seen.clear()
            for i in range(0, len(rows), 20_000):
                cut = zip(*rows[i : i + 20_000], strict=True)
                columns = [pa.array(c, kind) for c, kind in zip(cut, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
                columns[2] = columns[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                for g, s, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bytes_of(part, "text"), strict=True):
                    n, own = seen.setdefault((g, s), (Counter(), Counter()))
                    size -= len(n)
                    distinct: set[bytes] = set()
                    for terms in pieces(data):
                        n.update(terms)
                        distinct.update(terms)
                    own.update(distinct)
                    size += len(n)
                    if size >= held:
                        yield from given()
                        size = 0
        yield from given()

    return docs.select(*_group(docs, lang, source), docs[text].alias("text")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _p(count: str, total: str, size: str) -> str:
    """SQL: a term's smoothed share in billionths, from 1 on."""
    return f"1 + ({_SCALE} * (CAST({count} AS DECIMAL(20, 0)) + 1)) DIV nullif({total} + {size}, 0)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV {q}"


def joint_histograms(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): number of terms with each two counts in sources a < b, implied zeros included.

    `lists` is (lang, by_source, m), by_source an array of (source, n) in order; `groups` is (lang, source, n, v) with the
    vocabulary's size v. The combination (0, 0) is always there, with m = 0 if no term has it.
    """
    one = lists.select("lang", "m", "by_source", F.posexplode("by_source").alias("i", "x"))
    two = one.select("lang", "m", "x", F.explode(F.expr("slice(by_source, i + 2, size(by_source))")).alias("y"))
    both = two.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.sum("m").alias("m"))
    own = lists.select("lang", "m", F.explode("by_source").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("c")).agg(F.sum("m").alias("m"))
    pairs = groups.select("lang", F.col("source").alias("a"), "v").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    of_a = pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"])
    of_b = pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"])
    cell = lambda ca, cb, m: f"named_struct('ca', {ca}, 'cb', {cb}, 'm', {m})"
    parts = (
        (both, [cell("ca", "cb", "m"), cell("ca", "0L", "-m"), cell("0L", "cb", "-m"), cell("0L", "0L", "m")]),
        (of_a, [cell("c", "0L", "m"), cell("0L", "0L", "-m")]),
        (of_b, [cell("0L", "c", "m"), cell("0L", "0L", "-m")]),
        (pairs, [cell("0L", "0L", "v")]),
    )
    rows = None
    for df, cells in parts:
        part = df.select("lang", "a", "b", F.expr(f"explode(array({', '.join(cells)}))").alias("x")).select("lang", "a", "b", "x.*")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0 OR ca = 0 AND cb = 0")


def divergence(spark: SparkSession, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the source's `top` most telling terms."""
    work = Workspace(spark, "divergence")
    # moved once, by (lang, term): both sums are made where the rows are then
    counts = term_counts(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by_source")).where(F.col("docs") >= min_docs)
    kept = work.write(kept.drop("docs"), "kept")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    uses = kept.select("lang", "term", "total", F.explode("by_source").alias("x")).select("lang", "term", "total", "x.*")
    sizes = uses.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(*_group(docs, lang, source)).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = work.write(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "n_lang")]), "groups")

    of_group = groups.select("lang", "source", F.col("n").alias("n_group"), "v", "n_lang")
    terms = uses.join(of_group, ["lang", "source"]).selectExpr("lang", "source", "term AS item", f"{_p('n', 'n_group', 'v')} AS p", f"{_p('total', 'n_lang', 'v')} AS q")
    terms = terms.where("p > q").selectExpr("lang", "source", "'term' AS part", "item", f"{_f('p', 'q')} AS value")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    lists = kept.groupBy("lang", "by_source").agg(F.count(F.lit(1)).alias("m"))
    cells = joint_histograms(work.write(lists, "lists"), groups)
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("n").alias(f"n{x}"))
    cells = cells.join(side("a"), ["lang", "a"]).join(side("b").join(groups.select("lang", F.col("source").alias("b"), "v"), ["lang", "b"]), ["lang", "b"])
    cells = cells.selectExpr("lang", "a", "b", "m", f"{_p('ca', 'na', 'v')} AS p", f"{_p('cb', 'nb', 'v')} AS q")
    sums = cells.groupBy("lang", "a", "b").agg(*[F.coalesce(F.sum(F.expr(f"m * ({_f(x, y)})")), F.lit(0)).alias(f"from_{x}") for x, y in (("p", "q"), ("q", "p"))])
    pairs = sums.selectExpr("lang", "explode(array(named_struct('source', a, 'item', b, 'value', from_p), named_struct('source', b, 'item', a, 'value', from_q))) AS x")
    pairs = pairs.selectExpr("lang", "x.source AS source", "'pair' AS part", "x.item AS item", "x.value AS value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t, count(*) AS c FROM occ GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT o.lang, o.source, o.t, count(*) AS c FROM occ o JOIN kept k ON o.lang = k.lang AND o.t = k.t GROUP BY o.lang, o.source, o.t),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(y.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source) y ON x.lang = y.lang AND x.source = y.source),
p AS (SELECT g.lang, g.source, k.t, coalesce(cnt.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 1)) // (g.n + v.v) AS BIGINT) AS p,
CAST(1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS BIGINT) AS q
FROM g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.t = k.t),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
