"""Queries on the generic star-schema, event and text tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symdex.functions import relational as R
from symdex.streaming.changes import accepted, rate_limited

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query(
    "grep_documents_context",
    """WITH l AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))
    SELECT * FROM (SELECT doc_id, CAST(n AS BIGINT) AS line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS line_before, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS line_after FROM l) WHERE contains(line, 'token')""",
)
def grep_documents_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a literal, each with the line before and after it. Arrays, not windows, give the context: no shuffle."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    hits = lines.select("doc_id", "ls", F.explode(F.expr("filter(sequence(1, size(ls)), i -> contains(ls[i - 1], 'token'))")).alias("i"))
    return hits.select("doc_id", F.col("i").cast("long").alias("line_no"), F.expr("ls[i - 1]").alias("line"), F.expr("try_element_at(ls, nullif(i - 1, 0))").alias("line_before"), F.expr("try_element_at(ls, i + 1)").alias("line_after"))


def _sql(name: str, tables: str, spark_sql: str, duck: str | None = None) -> None:
    """A query whose SQL is the same for both engines, or nearly so; `{table}` stands for a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: read(spark, sf_dir, t) for t in tables.split()})

    text = duck or spark_sql
    for t in tables.split():
        text = text.replace("{" + t + "}", t)
    query(name, text)(run)


_sql(
    "ranked_name_search", "part",
    "SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) = 'blue' THEN 0 WHEN lower(p_name) LIKE 'blue%' THEN 1 ELSE 2 END AS INT) AS tier FROM {part} WHERE lower(p_name) LIKE '%blue%' ORDER BY tier, length(p_name), p_name, p_partkey LIMIT 50",
)
_sql("orders_without_lineitem", "orders lineitem", "SELECT o_orderkey, o_custkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)")
_sql("customers_no_pending", "customer orders", "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
_sql("documents_unlabelled", "documents labels", "SELECT doc_id, lang FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
_sql(
    "unused_twice_over", "customer orders events",
    "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = c.c_custkey AND e.event_type = 'error')",
)
_sql(
    "over_quota_orders", "lineitem",
    "SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM {lineitem} GROUP BY l_orderkey HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AND sum(l_quantity) > 150 AND count(*) > 3",
)
_sql("flagged_events", "events", "SELECT event_id, user_id, value FROM {events} WHERE event_type = 'error' AND value > 50")
_sql(
    "label_coverage_by_source", "documents labels",
    "SELECT d.source, count(*) AS n_docs, count(l.quality) AS n_labelled, CAST(100.0 * count(l.quality) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pct FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source",
)
_sql(
    "coverage_with_total", "documents labels",
    "SELECT coalesce(d.source, '<all>') AS source, count(*) AS n_docs, count(l.quality) AS n_labelled FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((d.source), ())",
)
_sql(
    "table_counts", "customer orders part documents",
    "SELECT 'customers' AS what, count(*) AS n FROM {customer} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'parts', count(*) FROM {part} UNION ALL SELECT 'documents', count(*) FROM {documents}",
)
_sql("kind_histogram", "events", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type")
_sql(
    "ref_counts_split", "customer orders",
    "SELECT c_custkey, count(o_orderkey) AS n_refs, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS n_local FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "SELECT c_custkey, count(o_orderkey) AS n_refs, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_local FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
_sql("distinct_name_counts", "part", "SELECT p_brand, count(DISTINCT p_name) AS n_names, count(*) AS n FROM {part} GROUP BY p_brand")
_sql("bucket_labels", "events", "SELECT event_id, CASE WHEN value >= 90 THEN 'certain' WHEN value >= 75 THEN 'likely' WHEN value >= 55 THEN 'chained' WHEN value >= 30 THEN 'weak' ELSE 'guess' END AS label FROM {events}")
_sql(
    "latest_version_per_key", "events",
    "SELECT user_id, event_type, max_by(event_id, struct(ts, event_id)) AS event_id FROM {events} GROUP BY user_id, event_type",
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
_sql(
    "paged_references", "lineitem part",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name FROM {lineitem} JOIN {part} ON l_partkey = p_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200 OFFSET 100",
)
_sql("distinct_implementations", "part", "SELECT DISTINCT coalesce(nullif(p_type, ''), '<top-level>') AS owner, p_name FROM {part}")
_sql(
    "union_of_occurrences", "orders lineitem events",
    "SELECT DISTINCT key, kind FROM (SELECT o_custkey AS key, 'order' AS kind FROM {orders} WHERE o_totalprice > 200000 UNION ALL SELECT l_suppkey, 'line' FROM {lineitem} WHERE l_quantity > 49 UNION ALL SELECT user_id, 'event' FROM {events} WHERE event_type = 'signup')",
)
_sql("prefix_names", "customer", "SELECT DISTINCT c_mktsegment FROM {customer} WHERE c_mktsegment LIKE 'B%' OR c_mktsegment LIKE 'M%'")
_sql(
    "type_chain_of_nearest", "events",
    "WITH p AS (SELECT user_id, min_by(event_type, struct(abs(value - 50), event_id)) AS event_type FROM {events} GROUP BY user_id) SELECT e.event_id, e.user_id, e.value FROM {events} e JOIN p ON e.user_id = p.user_id AND e.event_type = p.event_type",
    "WITH p AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) = 1) SELECT e.event_id, e.user_id, e.value FROM events e JOIN p ON e.user_id = p.user_id AND e.event_type = p.event_type",
)
_sql(
    "rest_expansion", "nation",
    "SELECT lower(n_name) AS resource, v.verb, concat('/', lower(n_name), v.suffix) AS path, v.action FROM {nation} CROSS JOIN (VALUES ('GET', '', 'index'), ('GET', '/new', 'new'), ('POST', '', 'create'), ('GET', '/:id', 'show'), ('GET', '/:id/edit', 'edit'), ('PATCH', '/:id', 'update'), ('DELETE', '/:id', 'destroy')) AS v(verb, suffix, action) WHERE n_regionkey = 1 OR v.action IN ('index', 'show')",
)


@query("duplicate_parts", "SELECT p_partkey, p_name, p_brand FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)")
def duplicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key occurs more than once. Keys are counted before the shuffle; no self-join of rows."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    twice = part.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return part.join(twice, ["p_name", "p_brand"], "left_semi").select("p_partkey", "p_name", "p_brand")


@query(
    "asof_last_signup",
    "SELECT e.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts",
)
def asof_last_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return R.asof_last(clicks, signups, ["user_id"], "ts", ["signup_id"]).select("event_id", "signup_id")


@query(
    "nearest_order_value",
    "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(o_totalprice - c_acctbal * 20), o_orderkey) = 1",
)
def nearest_order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") * 20).alias("want"))
    values = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")
    return R.nearest(probes, values, ["key"], "want", "o_totalprice", ["o_orderkey"]).select(F.col("key").alias("c_custkey"), "o_orderkey")


@query(
    "clicks_within_signup_window",
    "SELECT s.event_id AS signup_id, c.event_id AS click_id FROM events s JOIN events c ON s.user_id = c.user_id AND s.event_type = 'signup' AND c.event_type = 'click' AND c.ts BETWEEN s.ts AND s.ts + INTERVAL 48 HOUR",
)
def clicks_within_signup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hours = 3_600_000_000
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("us").alias("lo"), (F.col("us") + 48 * hours).alias("hi"))
    points = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "us")
    return R.stabbing(points, spans, ["user_id"], "us", "lo", "hi", 24 * hours).select("signup_id", "click_id")


@query("last_k_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def last_k_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query(
    "reachability_min_depth",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.user_id AS child, b.user_id AS parent FROM events a JOIN events b ON b.event_id = a.event_id + 1),
    r(root, node, depth) AS (SELECT user_id, user_id, 0 FROM (SELECT min(user_id) AS user_id FROM events) UNION SELECT root, parent, depth + 1 FROM r JOIN e ON r.node = e.child WHERE depth < 8)
    SELECT root, node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY root, node""",
)
def reachability_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    edges = e.alias("a").join(e.alias("b"), F.col("b.event_id") == F.col("a.event_id") + 1).select(F.col("a.user_id").alias("child"), F.col("b.user_id").alias("parent"))
    return R.closure(edges, e.agg(F.min("user_id").alias("node")), 8)


@query("first_wins_merge", "SELECT p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) = 1")
def first_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_wins(read(spark, sf_dir, "part").select("p_name", "p_partkey", "p_size"), ["p_name"], ["p_size", "p_partkey"]).select("p_name", "p_partkey")


@query("confidence_merge", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confidence_merge(read(spark, sf_dir, "events"), ["user_id"], "value", "event_id", ["event_id", "event_type"])


@query(
    "line_signature",
    "SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS signature FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey",
)
def line_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.groupBy("l_orderkey").agg(R.listed(F.concat_ws(":", "l_partkey", "l_linenumber"), ["l_linenumber", "l_partkey", "l_suppkey"]).alias("signature"))


@query(
    "similar_part_names",
    "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT p_name, CAST(levenshtein(p_name, 'blue bolt') AS INT) AS dist FROM n WHERE p_name <> 'blue bolt' AND (levenshtein(p_name, 'blue bolt') <= 5 OR contains(p_name, 'blue bolt') OR contains('blue bolt', p_name))",
)
def similar_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.lit("blue bolt")
    n = read(spark, sf_dir, "part").select("p_name").distinct().where(F.col("p_name") != want)
    near = R.edit_distance(F.col("p_name"), want)
    return n.where((near <= 5) | F.contains("p_name", want) | F.contains(want, F.col("p_name"))).select("p_name", near.alias("dist"))


@query("document_slice", "SELECT doc_id, array_to_string((string_split(text, chr(10)))[2:4], '|') AS part FROM documents")
def document_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "|").alias("part"))


@query("grouped_findings", "SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source")
def grouped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    return rows.groupBy("source").agg(R.listed(F.col("doc_id").cast("string"), ["doc_id"], ",").alias("ids"))


@query("url_routes", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages")
def url_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))


@query("json_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("extract_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))  # a page is one row: no shuffle
    return read(spark, sf_dir, "pages").dropDuplicates(["page_id", "html"]).select("page_id", F.explode(own).alias("href"))


@query(
    "conversation_outline",
    "SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS container, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations",
)
def conversation_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("container"), F.lead("turn").over(w).alias("next_turn"))


@query(
    "delta_encode_turns",
    "SELECT conv_id, turn, turn - coalesce(lag(turn) OVER w, 0) AS d_turn, CAST(length(text) - coalesce(lag(length(text)) OVER w, 0) AS BIGINT) AS d_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def delta_encode_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    n = F.char_length("text").cast("bigint")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"))  # texts aren't shuffled
    return rows.select("conv_id", "turn", (F.col("turn") - F.coalesce(F.lag("turn").over(w), F.lit(0))).alias("d_turn"), (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("d_chars"))


@query("changed_documents", "SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, md5(replace(text, 'token', 'key')) AS h FROM documents) b WHERE a.doc_id = b.doc_id AND md5(a.text) = b.h)")
def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose digest differs from an earlier snapshot's. Digests are joined, not texts."""
    docs = read(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.md5("text").alias("h"))
    before = docs.select("doc_id", F.md5(F.replace("text", F.lit("token"), F.lit("key"))).alias("h"))
    return R.without_match(now, before, ["doc_id", "h"]).select("doc_id")


@query(
    "sessionize_events",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, session""",
)
def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("new", F.when(F.col("us") - F.lag("us").over(w) <= 21_600_000_000, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(
    "innermost_range",
    "SELECT c.event_id AS click_id, max(s.event_id) AS signup_id FROM events c JOIN events s ON c.user_id = s.user_id AND c.event_type = 'click' AND s.event_type = 'signup' AND c.event_id BETWEEN s.event_id AND s.event_id + 3000 GROUP BY c.event_id",
)
def innermost_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    points = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"))
    ranges = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), (F.col("event_id") + 3000).alias("hi"))
    return R.stabbing(points, ranges, ["user_id"], "click_id", "signup_id", "hi", 1024).groupBy("click_id").agg(F.max("signup_id").alias("signup_id"))


@query(
    "nearest_purchase",
    "WITH p AS (SELECT user_id, event_id AS probe, value AS want FROM events WHERE event_type = 'error') SELECT probe, event_id FROM p JOIN (SELECT * FROM events WHERE event_type = 'purchase') e USING (user_id) QUALIFY row_number() OVER (PARTITION BY probe ORDER BY abs(value - want), event_id) = 1",
)
def nearest_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    p = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("probe"), F.col("value").alias("want"))
    v = e.where("event_type = 'purchase'").select("user_id", "event_id", "value")
    return R.nearest(p, v, ["user_id"], "want", "value", ["event_id"]).select("probe", "event_id")


@query("subsequence_search", "SELECT DISTINCT p_name FROM part WHERE regexp_matches(lower(p_name), 'b.*o.*t')")
def subsequence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where(R.subsequence("p_name", "BoT")).select("p_name").distinct()


@query("like_without_case", "SELECT page_id, url FROM pages WHERE contains(url, '_top') OR ends_with(lower(url), '#top')")
def like_without_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIKE for ASCII letters in either case, with an escaped wildcard and with a suffix."""
    return read(spark, sf_dir, "pages").where(R.like_ascii("url", "%!_TOP%", "!") | R.like_ascii("url", "%#TOP")).select("page_id", "url")


@query("greatest_and_lists", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_discount, l_tax) AS most FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber IN (1, 3, 5, 7, 11, 13, 17) AND greatest(l_discount, l_tax) > 0.08")
def greatest_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.greatest("l_discount", "l_tax")
    rows = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A") & F.col("l_linenumber").isin(1, 3, 5, 7, 11, 13, 17) & (most > 0.08))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", most.alias("most"))


@query(
    "grep_documents",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), x AS (SELECT *, CASE WHEN length(line) > 80 THEN left(line, 80) || '…' ELSE line END AS c FROM l)
    SELECT doc_id, CAST(n AS INT) AS n, c AS line, coalesce((SELECT string_agg(c, '⏎' ORDER BY n) FROM x y WHERE y.doc_id = x.doc_id AND y.n BETWEEN x.n - 2 AND x.n - 1), '') AS before, coalesce((SELECT string_agg(c, '⏎' ORDER BY n) FROM x y WHERE y.doc_id = x.doc_id AND y.n BETWEEN x.n + 1 AND x.n + 2), '') AS after
    FROM x WHERE contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'token')""",
)
def grep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.grep(read(spark, sf_dir, "documents"), ["doc_id"], "text", literal="ToKen", context=2, width=80)
    return hits.withColumn("before", F.array_join("before", "⏎")).withColumn("after", F.array_join("after", "⏎"))


@query(
    "rate_limited_events",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms FROM events),
    w(user_id, s) AS (SELECT user_id, min(ms) FROM e GROUP BY user_id UNION ALL SELECT w.user_id, (SELECT min(ms) FROM e WHERE e.user_id = w.user_id AND e.ms - w.s > 86400000) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.ms - w.s > 86400000))
    SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id, w.s ORDER BY e.ms, e.event_id) <= 3 AS allowed FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.ms >= w.s""",
)
def rate_limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of a user a day, where a day begins with the first event after the last day's end."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("seq"))
    return rate_limited(rows, 3, 86_400_000).select(F.col("client").alias("user_id"), F.col("seq").alias("event_id"), "allowed")


@query("latest_changes", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, event_type, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before IS NULL OR value > before")
def latest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version gate on events: those whose value is above all that came before for their user."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("uri"), F.col("value").alias("version"), F.col("event_id").alias("seq"))
    return accepted(rows).select(F.col("uri").alias("user_id"), F.col("seq").alias("event_id"))
