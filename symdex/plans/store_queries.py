"""Queries over what the engine stores and keeps up to date: inferred types, hierarchy, trigrams, writes, change feeds and
protocol functions, on facts made from the driver's tables. Each runs the engine's own function; its SQL for DuckDB is
written from what the result means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.functions import text
from symdex.operators import graph, health, hierarchy, infer, references, tokens, type_rounds, writes
from symdex.plans.star_facts import facts, with_facts
from symdex.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- types of calls: orders are methods, a part of which end with a call of the order before; line items call them

_METHODS = """SELECT o_orderkey AS id, CAST(floor(o_orderkey / 40.0) AS BIGINT) AS file_id, 'm' || CAST(o_orderkey AS VARCHAR(20)) AS name, 'classdef' AS kind, 1 AS line, 0 AS col, 1 AS end_line,
    CASE WHEN {open} THEN NULL ELSE 'T' || CAST(o_custkey AS VARCHAR(20)) END AS return_type, 'K' || CAST(o_orderkey AS VARCHAR(20)) AS parent_name, 'public' AS visibility FROM {orders}"""
_OPEN = "o_orderpriority = '5-LOW' AND o_orderstatus = 'O' AND o_totalprice < 150000"
_VARIABLES = "SELECT l_orderkey + 1000000000 AS file_id, 'x' || CAST(l_linenumber AS VARCHAR(20)) AS name, l_linenumber AS line, CAST(l_partkey AS INT) AS col, CAST(NULL AS STRING) AS type_hint, 0 AS confidence, false AS is_block_param FROM {lineitem}"
_CALLS = f"""SELECT CAST(floor(o_orderkey / 40.0) AS BIGINT) AS file_id, 'm' || CAST(o_orderkey AS STRING) AS name, 1 AS line, 0 AS col, 'K' || CAST(o_orderkey - 1 AS STRING) AS receiver, array('m' || CAST(o_orderkey - 1 AS STRING)) AS methods, o_orderkey AS symbol_id FROM {{orders}} WHERE {_OPEN}
    UNION ALL SELECT l_orderkey + 1000000000, 'x' || CAST(l_linenumber AS STRING), l_linenumber, CAST(l_partkey AS INT), 'K' || CAST(l_orderkey AS STRING), array('m' || CAST(l_orderkey AS STRING)), NULL FROM {{lineitem}}"""


def order_facts(spark: SparkSession, sf_dir: str, opened: str = _OPEN) -> Facts:
    orders, lineitem = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    symbols = spark.sql(_METHODS.replace("{open}", opened), orders=orders)
    # rows of one key are cut to one by the three columns that they are made of, not by texts made of these
    lineitem, ending = lineitem.select("l_orderkey", "l_linenumber", "l_partkey").distinct(), orders.where(_OPEN).dropDuplicates(["o_orderkey"])
    return Facts(spark, symbols=symbols, local_vars=spark.sql(_VARIABLES, lineitem=lineitem), calls=spark.sql(_CALLS, orders=ending, lineitem=lineitem))


_TYPED = f"""WITH RECURSIVE m AS (SELECT o_orderkey AS k, {_OPEN} AS open, 'T' || o_custkey AS type FROM orders),
t(k, type, round) AS (SELECT k, type, 0 FROM m WHERE NOT open UNION ALL SELECT m.k, t.type, t.round + 1 FROM t JOIN m ON m.k = t.k + 1 WHERE m.open)"""


@query("x6_results_of_methods", f"{_TYPED} SELECT m.k AS id, t.type AS return_type, CAST(nullif(t.round, 0) AS INT) AS type_round FROM m LEFT JOIN t ON t.k = m.k")
def results_of_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_rounds.typed(order_facts(spark, sf_dir), ()).symbols.select("id", "return_type", "type_round")


_CALL_TYPES = "SELECT DISTINCT l_orderkey + 1000000000 AS file_id, 'x' || l_linenumber AS name, CAST(l_partkey AS INT) AS col, t.type AS type_hint, CASE WHEN t.type IS NULL THEN 0 ELSE 55 END AS confidence, CAST(t.round + 1 AS INT) AS round FROM lineitem LEFT JOIN t ON t.k = l_orderkey"


@query("x6_types_of_calls", f"{_TYPED} {_CALL_TYPES}")
def types_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_rounds.kept(type_rounds.typed(order_facts(spark, sf_dir), ()), "local_vars").local_vars.select("file_id", "name", "col", "type_hint", "confidence", "round")


@query("w6_types_after_changes", f"{_TYPED} {_CALL_TYPES}")
def types_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of facts in which the methods of some files had other results, brought up to date, as of the facts made anew."""
    was = type_rounds.typed_and_kept(order_facts(spark, sf_dir, f"{_OPEN} OR o_totalprice > 490000"), ())
    now = order_facts(spark, sf_dir)
    changed = now.symbols.join(was.symbols.where("return_type IS NULL OR type_round IS NOT NULL").select("id"), "id", "left_semi").select("file_id").distinct()
    new = now.symbols.join(changed, "file_id", "left_semi")
    after = was.replaced(symbols=was.symbols.join(changed, "file_id", "left_anti").unionByName(new))
    return type_rounds.kept(type_rounds.retyped(was, after, changed, ()), "local_vars").local_vars.select("file_id", "name", "col", "type_hint", "confidence", "round")


# --- hierarchy

_ALL_EDGES = "e(child, parent) AS (SELECT DISTINCT name, parent_name FROM symbols WHERE kind IN ('class', 'module') AND parent_name IS NOT NULL UNION SELECT DISTINCT s.name, m.module_name FROM mixins m JOIN symbols s ON s.id = m.class_id)"
_REACH = f"WITH RECURSIVE {_ALL_EDGES}, up(root, node, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT up.root, e.parent, depth + 1 FROM up JOIN e ON e.child = up.node WHERE depth < 32) SELECT root, node, CAST(min(depth) AS INT) AS depth FROM up WHERE root <> node GROUP BY root, node"


@query("a7_all_ancestors", with_facts(_REACH))
def all_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.reach(facts(spark, sf_dir)).where("via = 'all'").select("root", "node", "depth")


@query("a7_ancestors_after_changes", with_facts(_REACH))
def ancestors_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hierarchy of a code base in which some classes had another parent or none, and some mixins were missing,
    brought up to date by its changed edges."""
    now = facts(spark, sf_dir)
    parent = F.when((F.col("kind") == "class") & (F.col("line") + F.col("file_id") > 60), F.concat(F.lit("C"), (F.col("file_id") + 3).cast("string"))).when(F.col("kind") != "module", F.col("parent_name"))
    was = now.replaced(symbols=now.symbols.withColumn("parent_name", parent), mixins=now.mixins.where("kind <> 'include'"))
    return hierarchy.carried(was.replaced(reach=hierarchy.made(was)), now).reach.where("via = 'all'").select("root", "node", "depth")


@query(
    "b19_complete_all_receivers",
    with_facts("""WITH RECURSIVE p(child, parent) AS (SELECT DISTINCT name, parent_name FROM symbols WHERE kind IN ('class', 'module') AND parent_name IS NOT NULL), x(child, module_name, kind) AS (SELECT DISTINCT s.name, m.module_name, m.kind FROM mixins m JOIN symbols s ON s.id = m.class_id),
    roots(n) AS (SELECT child FROM p UNION SELECT parent FROM p UNION SELECT child FROM x UNION SELECT module_name FROM x UNION SELECT parent_name FROM symbols WHERE parent_name IS NOT NULL),
    up(root, cls, depth) AS (SELECT n, n, 0 FROM roots UNION SELECT up.root, p.parent, depth + 1 FROM up JOIN p ON p.child = up.cls WHERE depth < 8), c AS (SELECT root, cls, min(depth) AS depth FROM up GROUP BY root, cls),
    o AS (SELECT root, owner, min(rank) AS rank FROM (SELECT root, cls AS owner, depth * 4 + 1 AS rank FROM c UNION ALL SELECT root, x.module_name, depth * 4 + CASE WHEN x.kind = 'prepend' THEN 0 ELSE 2 END FROM c JOIN x ON x.child = c.cls) GROUP BY root, owner)
    SELECT cls, name, owner, CAST(rank AS INT) AS rank, return_type, doc FROM (SELECT o.root AS cls, s.name, owner, rank, return_type, doc, row_number() OVER (PARTITION BY o.root, s.name ORDER BY rank, s.id) AS k FROM symbols s JOIN o ON o.owner = s.parent_name WHERE s.kind IN ('def', 'classdef') AND visibility = 'public') WHERE k = 1"""),
)
def complete_all_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.complete_all_dots(facts(spark, sf_dir))


# --- text search and near names

_LOW = "translate(l.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _grepped(df: DataFrame) -> DataFrame:
    return df.withColumn("before", F.array_join("before", "⏎")).withColumn("after", F.array_join("after", "⏎"))


def _grep_sql(test: str, files: str = "SELECT id AS file_id, path FROM files WHERE NOT is_gem", more: str = "", limit: int = 100) -> str:
    cut = "CASE WHEN strlen(x.text) > 512 THEN left(x.text, 509) || '…' ELSE x.text END"
    side = "coalesce((SELECT string_agg({cut}, '⏎' ORDER BY x.n) FROM lines x WHERE x.file_id = h.file_id AND x.n = h.n {sign} 1), '')"
    return with_facts(f"""WITH own AS ({files}), h AS (SELECT l.file_id, path, n, l.text FROM lines l JOIN own ON own.file_id = l.file_id WHERE {test} ORDER BY path, n LIMIT {limit})
    SELECT path, n AS line, {cut.replace("x.text", "h.text")} AS text, {side.format(cut=cut, sign="-")} AS before, {side.format(cut=cut, sign="+")} AS after {more} FROM h""")


@query("a12_grep_by_index", _grep_sql(f"contains({_LOW}, 'token')", limit=100000))
def grep_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grepped(references.grep_source(facts(spark, sf_dir), "TOKEN", limit=100_000, indexed=True))


@query("a12_grep_pattern_by_index", _grep_sql("regexp_matches(l.text, 'th.+ing')", limit=100000))
def grep_pattern_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grepped(references.grep_source(facts(spark, sf_dir), "th.+ing", use_regex=True, limit=100_000, indexed=True))


@query("a12_grep_first_files", _grep_sql(f"contains({_LOW}, 'token')", "SELECT id AS file_id, path FROM files WHERE NOT is_gem ORDER BY path LIMIT 500", ", (SELECT count(*) > 500 FROM files WHERE NOT is_gem) AS file_limit_hit"))
def grep_first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grepped(references.grep_source(facts(spark, sf_dir), "TOKEN", file_limit=500))


@query(
    "a32_all_similar_names",
    with_facts("""WITH a AS (SELECT DISTINCT name AS word FROM refs WHERE name IS NOT NULL AND strlen(name) <= 64), b AS (SELECT DISTINCT name AS other FROM symbols WHERE kind IN ('def', 'classdef') AND strlen(name) <= 64),
    p AS (SELECT word, other, levenshtein(word, other) AS d FROM a JOIN b ON abs(strlen(word) - strlen(other)) <= 2) SELECT word, other, CAST(d AS INT) AS d FROM p WHERE d BETWEEN 1 AND 2"""),
)
def all_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return R.near_texts(f.refs.select(F.col("name").alias("word")), f.symbols.where("kind IN ('def', 'classdef')").select(F.col("name").alias("other")))


# --- writes

_NEWER = "SELECT id, path, mtime_ms + 5 AS mtime_ms, content_hash + 1 AS content_hash, is_gem FROM files WHERE content_hash > 7000 UNION ALL SELECT id + 5000000, 'lib/' || path, 1, 2, false FROM files WHERE is_gem"


def _newer(f: Facts) -> DataFrame:
    a = f.files.where("content_hash > 7000").selectExpr("id", "path", "mtime_ms + 5 AS mtime_ms", "content_hash + 1 AS content_hash", "is_gem")
    return a.unionByName(f.files.where("is_gem").selectExpr("id + 5000000 AS id", "'lib/' || path AS path", "1L AS mtime_ms", "2L AS content_hash", "false AS is_gem"))


@query("w1_upsert_files", with_facts(f"WITH n AS ({_NEWER}) SELECT id, path, mtime_ms, content_hash, is_gem FROM n UNION ALL SELECT id, path, mtime_ms, content_hash, is_gem FROM files WHERE path NOT IN (SELECT path FROM n)"))
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return writes.upsert_files(f.files, _newer(f))


_LEFT_OF = "SELECT 'symbols' AS part, id AS key, name FROM symbols WHERE {s} UNION ALL SELECT 'params', symbol_id, name FROM params WHERE symbol_id IN (SELECT id FROM symbols WHERE {s}) OR symbol_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'refs', line, name FROM refs WHERE {s} UNION ALL SELECT 'mixins', class_id, module_name FROM mixins WHERE class_id NOT IN (SELECT id FROM symbols WHERE NOT ({s}))"


def _left(f: Facts) -> DataFrame:
    part = lambda n, t, key, name: t.select(F.lit(n).alias("part"), F.col(key).cast("bigint").alias("key"), F.col(name).alias("name"))
    return part("symbols", f.symbols, "id", "name").unionByName(part("params", f.params, "symbol_id", "name")).unionByName(part("refs", f.refs, "line", "name")).unionByName(part("mixins", f.mixins, "class_id", "module_name"))


@query("w2_replace_files", with_facts(_LEFT_OF.format(s="file_id NOT IN (SELECT id FROM files WHERE content_hash > 350)") + " UNION ALL SELECT 'symbols', id, 'new_' || name FROM symbols WHERE file_id IN (SELECT id FROM files WHERE content_hash > 350) AND kind = 'def'"))
def replace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    files = f.files.where("content_hash > 350")
    symbols = f.symbols.where("kind = 'def'").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").withColumn("name", F.concat(F.lit("new_"), "name"))
    return _left(writes.replace_files(f, Facts(spark, files=files, symbols=symbols)))


@query(
    "w3_insert_or_ignore",
    with_facts("WITH o AS (SELECT DISTINCT file_id, name, line, col FROM local_vars WHERE confidence > 20), n AS (SELECT DISTINCT file_id, name, line, col FROM local_vars) SELECT file_id, name, line, col, 'old' AS type_hint FROM o UNION ALL SELECT file_id, name, line, col, 'new' FROM (SELECT * FROM n EXCEPT SELECT * FROM o) x"),
)
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = facts(spark, sf_dir).local_vars
    old = v.where("confidence > 20").dropDuplicates(["file_id", "name", "line", "col"]).withColumn("type_hint", F.lit("old"))
    return writes.insert_or_ignore("local_vars", old, v.withColumn("type_hint", F.lit("new"))).select("file_id", "name", "line", "col", "type_hint")


@query("w5_remove_stale", with_facts(_LEFT_OF.format(s="file_id NOT IN (SELECT id FROM files WHERE NOT is_gem AND starts_with(path, 'app/b') AND mtime_ms > 12)")))
def remove_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return _left(writes.remove_stale(f, f.files.where("mtime_ms <= 12").select("path"), "app/b"))


@query("w7_rename_and_remove", with_facts("SELECT id, CASE path WHEN 'app/household/customer_000000003.rb' THEN 'lib/three.rb' ELSE path END AS path FROM files WHERE NOT starts_with(path, 'app/auto')"))
def rename_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = writes.rename_file(facts(spark, sf_dir), "app/household/customer_000000003.rb", "lib/three.rb")
    return writes.remove_prefix(f, "app/auto").files.select("id", "path")


@query(
    "x2_changed_files",
    with_facts("WITH s AS (SELECT path, mtime_ms + CASE WHEN mtime_ms > 10 THEN 1 ELSE 0 END AS mtime_ms, content_hash + CASE WHEN mtime_ms > 15 THEN 1 ELSE 0 END AS content_hash FROM files UNION ALL SELECT 'new/' || path, 1, 1 FROM files WHERE is_gem) SELECT s.path, s.mtime_ms, s.content_hash FROM s LEFT JOIN files f ON f.path = s.path WHERE f.path IS NULL OR NOT ((s.mtime_ms = f.mtime_ms AND f.content_hash <> 0) OR s.content_hash = f.content_hash)"),
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    scan = f.files.selectExpr("path", "mtime_ms + int(mtime_ms > 10) AS mtime_ms", "content_hash + int(mtime_ms > 15) AS content_hash")
    scan = scan.unionByName(f.files.where("is_gem").selectExpr("'new/' || path AS path", "1L AS mtime_ms", "1L AS content_hash"))
    return writes.changed_files(f, scan)


@query("k5_check_of_broken_facts", with_facts("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t} without file' AS problem, count(*) AS n FROM {t} WHERE file_id NOT IN (SELECT id FROM files WHERE NOT is_gem)" for t in ("symbols", "refs", "local_vars", "diagnostics", "i18n_keys", "routes")) + " UNION ALL SELECT 'params without symbol', count(*) FROM params WHERE symbol_id NOT IN (SELECT id FROM symbols) UNION ALL "
    + " UNION ALL ".join(f"SELECT '{t} with one key', count(*) FROM (SELECT 1 FROM {src} GROUP BY {key} HAVING count(*) > 1) x" for t, key, src in (("files", "path", "(SELECT * FROM files WHERE NOT is_gem)"), ("refs", "file_id, name, line, col", "refs"), ("params", "symbol_id, position", "(SELECT symbol_id, least(position, 1) AS position FROM params)"), ("local_vars", "file_id, name, line, col", "local_vars"), ("routes", "file_id, http_method, path_pattern, line", "routes"), ("meta", "key", "meta"))) + ") y WHERE n > 0"))
def check_of_broken_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return health.check(f.replaced(files=f.files.where("NOT is_gem"), params=f.params.withColumn("position", F.least("position", F.lit(1)))))


# --- schema files and tokens

_SCHEMA_LINES = """SELECT CAST(n_nationkey AS BIGINT) AS file_id, 3 * n_nationkey + 1 AS n, '  create_table "' || lower(n_name) || '_boxes", force: true do |t|' AS text, n_nationkey FROM {nation}
    UNION ALL SELECT CAST(n_nationkey AS BIGINT), 3 * n_nationkey + 2, CASE WHEN n_regionkey < 2 THEN '    t.string "title", null: false' WHEN n_regionkey = 2 THEN '    t.decimal :price' WHEN n_regionkey = 3 THEN '    t.boolean "done"' ELSE '    t.index ["x"]' END, n_nationkey FROM {nation}
    UNION ALL SELECT CAST(n_nationkey AS BIGINT), 3 * n_nationkey + 3, '  end', n_nationkey FROM {nation}"""


@query("x8_schema_columns", "SELECT CAST(n_nationkey AS BIGINT) AS file_id, lower(n_name) || '_boxes' AS \"table\", 'Nation' || n_nationkey || 'Boxe' AS model, CASE WHEN n_regionkey < 2 THEN 'title' WHEN n_regionkey = 2 THEN 'price' ELSE 'done' END AS \"column\", CASE WHEN n_regionkey < 2 THEN 'String' WHEN n_regionkey = 2 THEN 'Float' ELSE 'TrueClass | FalseClass' END AS type, 3 * n_nationkey + 2 AS line FROM nation WHERE n_regionkey < 4")
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.schema_columns(spark.sql(_SCHEMA_LINES, nation=read(spark, sf_dir, "nation")).drop("n_nationkey"))


_TOKENS = "SELECT DISTINCT file_id, line, col, CAST(length(name) AS INT) AS len, CASE WHEN receiver_type IS NULL THEN 1 ELSE 2 END AS type, arg_count AS mods FROM refs"


def _token_rows(f: Facts) -> DataFrame:
    return f.refs.select("file_id", "line", "col", F.char_length("name").alias("len"), F.when(F.col("receiver_type").isNull(), 1).otherwise(2).alias("type"), F.col("arg_count").alias("mods")).distinct()


_ENCODED = f"""WITH t AS ({_TOKENS}), d AS (SELECT file_id, row_number() OVER w AS i, line - coalesce(lag(line) OVER w, 0) AS dline, CASE WHEN line = lag(line) OVER w THEN col - lag(col) OVER w ELSE col END AS dcol, len, type, mods FROM t WINDOW w AS (PARTITION BY file_id ORDER BY line, col, len, type, mods))
SELECT file_id, string_agg(concat_ws(':', dline, dcol, len, type, mods), ',' ORDER BY i) AS tokens FROM d GROUP BY file_id"""


@query("x16_encoded_tokens", with_facts(_ENCODED))
def encoded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: F.concat_ws(":", *[t[x].cast("string") for x in tokens.FIELDS])
    return tokens.encode(_token_rows(facts(spark, sf_dir))).select("file_id", F.array_join(F.transform("tokens", one), ",").alias("tokens"))


@query("b38_tokens_in_range", with_facts(f"SELECT * FROM ({_TOKENS}) x WHERE line BETWEEN 30 AND 90"))
def tokens_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of some lines, encoded, cut, encoded anew and decoded."""
    return tokens.decode(tokens.in_range(tokens.encode(_token_rows(facts(spark, sf_dir))), 30, 90))


# --- change feeds: events are changes of a user's document

_KIND = "CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 3 ELSE 2 END"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("uri"), F.floor(F.col("value") * 10).alias("version"), F.expr(_KIND).alias("change_type"), F.concat("event_type", F.floor("value").cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq")
    )


@query("t5_live_documents", f"SELECT uri, version, change_type, text, seq FROM (SELECT CAST(user_id AS VARCHAR) AS uri, CAST(floor(value * 10) AS BIGINT) AS version, {_KIND} AS change_type, event_type || CAST(floor(value) AS BIGINT) AS text, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) x WHERE k = 1 AND change_type <> 3")
def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.live(_feed(spark, sf_dir)).select("uri", "version", "change_type", "text", "seq")


@query("t5_tombstones", "SELECT CAST(user_id AS VARCHAR) AS uri FROM events GROUP BY user_id HAVING max_by(event_type, event_id) = 'error'")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.tombstones(_feed(spark, sf_dir))


@query(
    "t2_debounced_changes",
    f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g), x AS (SELECT *, count(*) OVER (PARTITION BY user_id, session) AS n, row_number() OVER (PARTITION BY user_id, session ORDER BY ts DESC, event_id DESC) AS k FROM s)
    SELECT CAST(user_id AS VARCHAR) AS uri, n, CAST(floor(value * 10) AS BIGINT) AS version, {_KIND} AS change_type, event_id AS seq FROM x WHERE k = 1""",
)
def debounced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.debounced(_feed(spark, sf_dir), "6 hours").select("uri", "n", "version", "change_type", "seq")


@query("t6_new_contents", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS uri, event_type || CAST(floor(value) AS BIGINT) AS text FROM events")
def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.new_contents(_feed(spark, sf_dir)).select("uri", "text")


# --- protocol functions

@query(
    "f18_columns",
    """WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(1, len(string_split(t, '')) + 1)) AS i, strlen(t) * 3 // 5 AS b FROM d WHERE t <> ''),
    s AS (SELECT *, coalesce(sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN strlen(s.c) = 4 THEN 2 ELSE 1 END) FILTER (s.before < s.b), 0) AS INT) AS utf16, CAST(coalesce(sum(strlen(s.c)) FILTER (s.before < s.b), 0) AS INT) AS utf8 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in each document's first line in both encodings, and back from one to the other."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("t"))
    d = d.withColumn("utf16", text.utf16_column("t", F.expr("octet_length(t) * 3 DIV 5")))
    return d.select("doc_id", "utf16", text.utf8_column("t", "utf16").alias("utf8"))


_PATH = "'/' || url || ' é' || CAST(page_id AS VARCHAR(20)) || '~'"


@query("f19_addresses", f"SELECT page_id, 'file://' || replace(url_encode({_PATH}), '%2F', '/') AS uri, {_PATH} AS path FROM pages")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").select("page_id", text.to_uri(F.expr(_PATH)).alias("uri"))
    return p.select("page_id", "uri", text.from_uri("uri").alias("path"))


@query(
    "f21_places_of_offsets",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, strlen(text) * 3 // 5 AS n FROM documents WHERE text IS NOT NULL),
    s AS (SELECT *, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM l)
    SELECT doc_id, CAST(max(i) AS INT) AS line, CAST(max_by(least(n - gone, strlen(t)), i) AS INT) AS col FROM s WHERE gone <= n GROUP BY doc_id""",
)
def places_of_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.place_of_offset("text", F.expr("CAST(octet_length(text) * 3 DIV 5 AS INT)")).alias("p")).select("doc_id", "p.line", "p.col")


_GENERIC = "CASE WHEN p_size < 15 THEN 'Hash[' || p_type || ', Array[Int]]' WHEN p_size < 30 THEN '[' || p_type || ']' WHEN p_size < 40 THEN 'Set[' || p_type || ']' ELSE p_type END"


@query("f15_generic_types", "SELECT p_partkey, CASE WHEN p_size < 15 THEN 'Hash' WHEN p_size < 30 THEN 'Array' WHEN p_size < 40 THEN 'Set' ELSE p_type END AS base, CASE WHEN p_size < 15 THEN p_type || ';Array[Int]' WHEN p_size < 40 THEN p_type ELSE '' END AS args FROM part")
def generic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", text.generic_type(F.expr(_GENERIC)).alias("g"))
    return p.select("p_partkey", "g.base", F.array_join("g.args", ";").alias("args"))
