"""Fact tables made from the star-schema, event and text tables, by one SQL text that Spark and DuckDB both run.

Customers are files, suppliers classes, nations modules, parts methods and declarations, line items references, events
variable bindings and findings, documents the lines of files. The texts fill the fact tables from whole tables and
are projections with conditions on attributes, so that questions about code can be asked, and checked, at the scale of those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symdex.facts import Facts

#: Name of a part, as a method: two words, for most with the size behind.
_NAME = "replace(p_name, ' ', '_') || CASE WHEN p_size <= 5 THEN '' ELSE '_' || CAST(p_size AS VARCHAR(9)) END"
_PART_FILE = "CAST(floor(p_partkey / 4.0) AS BIGINT)"
_PART_LINE = "CAST(p_partkey - 4 * floor(p_partkey / 4.0) AS INT) * 60 + p_size"

SQL = {
    "files": """SELECT c_custkey AS id, 'app/' || lower(c_mktsegment) || '/' || replace(lower(c_name), '#', '_') || '.rb' AS path,
        CAST(c_nationkey AS BIGINT) AS mtime_ms, c_custkey * 7 AS content_hash, c_acctbal < 0 AS is_gem FROM {customer}""",
    "symbols": f"""SELECT p_partkey AS id, {_PART_FILE} AS file_id,
        CASE WHEN p_size BETWEEN 26 AND 28 THEN 'LIMIT_' || CAST(p_size AS VARCHAR(9)) ELSE {_NAME} END AS name,
        CASE WHEN p_size <= 18 THEN 'def' WHEN p_size <= 25 THEN 'classdef' WHEN p_size <= 28 THEN 'constant' WHEN p_size <= 32 THEN 'test' WHEN p_size <= 37 THEN 'association'
            WHEN p_size <= 40 THEN 'scope' WHEN p_size <= 44 THEN 'callback' WHEN p_size <= 46 THEN 'validation' ELSE 'def' END AS kind,
        {_PART_LINE} AS line, 2 AS col, {_PART_LINE} + p_size AS end_line,
        CASE p_type WHEN 'PROMO' THEN 'String' WHEN 'LARGE' THEN 'Integer | String' WHEN 'SMALL' THEN 'C' || substr(p_brand, 7) END AS return_type,
        CASE WHEN p_size BETWEEN 33 AND 37 THEN 'has_many' WHEN p_size BETWEEN 41 AND 44 THEN 'before_save' WHEN p_type = 'MEDIUM' THEN 'About ' || p_name END AS doc,
        CASE WHEN p_type = 'ECONOMY' AND p_size < 9 THEN NULL ELSE 'C' || substr(p_brand, 7) END AS parent_name,
        CASE WHEN p_type = 'STANDARD' AND p_size > 12 THEN 'private' ELSE 'public' END AS visibility,
        CASE WHEN p_size = 33 THEN 'through:' || substr(p_name, 1, 3) END AS value_snippet FROM {{part}}
      UNION ALL SELECT 3000000000 + p_partkey, {_PART_FILE}, {_NAME}, 'def', {_PART_LINE} + 1, 2, {_PART_LINE} + 3, NULL, NULL, 'C' || substr(p_brand, 7), 'public', NULL FROM {{part}} WHERE p_size BETWEEN 9 AND 11
      UNION ALL SELECT 1000000000 + s_suppkey, s_suppkey, 'C' || CAST(s_suppkey AS VARCHAR(9)), 'class', 1, 0, 180, NULL, CASE WHEN s_acctbal > 5000 THEN 'A class' END,
        CASE WHEN s_nationkey = s_suppkey THEN NULL ELSE 'C' || CAST(s_nationkey AS VARCHAR(9)) END, 'public', NULL FROM {{supplier}}
      UNION ALL SELECT 2000000000 + n_nationkey, n_nationkey, CASE WHEN n_regionkey = 2 THEN 'Deep::' ELSE '' END || 'M' || CAST(n_nationkey AS VARCHAR(9)), 'module', 181, 0, 260, NULL, NULL,
        CASE WHEN n_nationkey > 4 THEN 'M' || CAST(n_regionkey AS VARCHAR(9)) END, 'public', NULL FROM {{nation}}""",
    "refs": f"""SELECT CAST(floor(l_orderkey / 10.0) AS BIGINT) AS file_id,
        CASE WHEN l_tax > 0.075 THEN 'validates' WHEN l_tax > 0.065 AND p_size > 6 THEN substr({_NAME}, 1, length({_NAME}) - 1) WHEN l_tax > 0.055 THEN 'x' ELSE {_NAME} END AS name,
        l_linenumber * 30 + CAST(l_discount * 100 AS INT) AS line, CAST(l_quantity AS INT) AS col, CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS scope_id, CAST(l_tax * 100 AS INT) AS arg_count,
        CASE l_returnflag WHEN 'N' THEN 'NilClass' WHEN 'R' THEN 'C' || substr(p_brand, 7) END AS receiver_type
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "params": """SELECT p_partkey AS symbol_id, 0 AS position, 'a' || substr(p_name, 1, 1) AS name, 'required' AS kind, CASE WHEN p_type = 'SMALL' THEN 'String' END AS type_hint, CASE WHEN p_type = 'SMALL' THEN 90 END AS confidence, CAST(NULL AS VARCHAR(9)) AS description FROM {part} WHERE p_size > 3
      UNION ALL SELECT p_partkey, 1, '_rest', CASE p_type WHEN 'PROMO' THEN 'rest' WHEN 'LARGE' THEN 'keyword' WHEN 'SMALL' THEN 'keyword_rest' ELSE 'optional' END, 'Integer', 30, NULL FROM {part} WHERE p_size > 6
      UNION ALL SELECT p_partkey, 2, 'x', CASE WHEN p_type = 'MEDIUM' THEN 'block' ELSE 'keyword' END, NULL, NULL, 'The x' FROM {part} WHERE p_size > 14""",
    "local_vars": f"""SELECT user_id AS file_id, CASE event_type WHEN 'click' THEN 'x' WHEN 'error' THEN '_tmp' WHEN 'purchase' THEN '@price' WHEN 'signup' THEN '$flag' ELSE 'big_' || CAST(CAST(floor(value / 50) AS INT) AS VARCHAR(9)) END AS name,
        CAST(floor(value) AS INT) + 1 AS line, CAST(event_id AS INT) AS col, CASE WHEN value > 300 THEN 'String' WHEN value > 150 THEN 'Integer | C3' WHEN value > 60 THEN 'C7' WHEN value > 30 THEN 'Array' END AS type_hint,
        CAST(least(floor(value / 2.0), 95) AS INT) AS confidence, CASE WHEN value < 200 THEN user_id + 5 END AS scope_id, CASE WHEN event_type = 'purchase' THEN 1000000000 + user_id END AS class_id, false AS is_block_param FROM {{events}}
      UNION ALL SELECT {_PART_FILE}, {_NAME}, {_PART_LINE} + 1, 4, CASE WHEN p_type <> 'ECONOMY' THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) END, p_size, NULL, NULL, false FROM {{part}}""",
    "mixins": """SELECT 1000000000 + s_suppkey AS class_id, CASE WHEN s_acctbal > 3000 THEN 'M' ELSE 'Deep::M' END || CAST(s_nationkey AS VARCHAR(9)) AS module_name, CASE WHEN s_acctbal > 7000 THEN 'prepend' WHEN s_acctbal > 2000 THEN 'include' ELSE 'extend' END AS kind FROM {supplier}""",
    "diagnostics": """SELECT user_id AS file_id, CAST(floor(value) AS INT) AS line, CAST(event_id AS INT) AS col, 'finding ' || event_type AS message, CASE WHEN value > 250 THEN 2 ELSE 4 END AS severity, 'code-' || event_type AS code FROM {events} WHERE event_type IN ('error', 'signup')""",
    "i18n_keys": """SELECT CAST(n_nationkey AS BIGINT) AS file_id, lower(r_name) || '.' || lower(n_name) AS key, n_name AS value, lower(substr(r_name, 1, 2)) AS locale FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "routes": """SELECT CAST(n_nationkey AS BIGINT) AS file_id, CASE WHEN n_regionkey = 0 THEN 'POST' ELSE 'GET' END AS http_method, '/' || lower(n_name) AS path_pattern, lower(n_name) || '_path' AS helper_name, lower(n_name) AS controller, 'index' AS action, n_nationkey + 1 AS line, 2 AS col FROM {nation}""",
    "lines": """SELECT doc_id AS file_id, n, text FROM ({document_lines}) AS d
      UNION ALL SELECT s_suppkey, 90001, 'require "' || 'customer_' || substr('000000000' || CAST(s_nationkey AS VARCHAR(9)), length(CAST(s_nationkey AS VARCHAR(9))) + 1) || '"' FROM {supplier}
      UNION ALL SELECT CAST(r_regionkey AS BIGINT), 90002, 'home = ENV["' || replace(r_name, ' ', '_') || '"] || ENV.fetch("' || lower(substr(r_name, 1, 3)) || '_DIR", 1)' FROM {region}""",
    "meta": "SELECT 'schema_version' AS key, '5' AS value",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem", "events", "documents")
#: A text's lines with their numbers, the one thing that the two engines say differently.
_LINES = {
    "spark": "SELECT doc_id, CAST(x.pos + 1 AS INT) AS n, x.col AS text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, col",
    "duckdb": "SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INT) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents} WHERE text IS NOT NULL)",
}
_made: dict = {}


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The facts of a folder of tables; nothing is run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}

        def one(name: str) -> DataFrame:
            text = SQL[name].replace("{document_lines}", _LINES["spark"])
            return spark.sql(text, **{t: df for t, df in given.items() if "{" + t + "}" in text})

        _made.clear()
        _made[key] = Facts(spark, **{name: one(name) for name in SQL})
    return _made[key]


def with_facts(query: str) -> str:
    """DuckDB SQL: a query over the fact tables, with those that it names defined before it."""
    import re

    said = [name for name in SQL if re.search(rf"\b{name}\b", query)]
    texts = {name: SQL[name].replace("{document_lines}", _LINES["duckdb"]) for name in said}
    for t in _TABLES:
        texts = {n: x.replace("{" + t + "}", t) for n, x in texts.items()}
    defined = ", ".join(f"{n} AS ({x})" for n, x in texts.items())
    recursive = query.lstrip().upper().startswith("WITH RECURSIVE")
    rest = query.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if rest.startswith(start):
            return f"WITH {'RECURSIVE ' if recursive else ''}{defined}, {rest[len(start):]}"
    return f"WITH {defined} {rest}"
