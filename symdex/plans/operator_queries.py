"""Every named operator over the facts of `star_facts`, with the same question asked in plain SQL of the same facts.

A query runs the operator through the registry, as a client would; arrays and structs of its result are put into text
so that the two engines' rows can be compared. The SQL is written from what the operator means, not from how it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.operators import lint
from symdex.plans import registry
from symdex.plans.star_facts import facts, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def ask(key: str, operator: str, sql: str, post: Callable[[DataFrame], DataFrame] = lambda d: d, /, **arguments) -> None:
    """Register an operator with its arguments under a key that begins with its id."""
    QUERIES[key] = lambda spark, sf_dir: post(registry.run(facts(spark, sf_dir), operator, **arguments))
    ORACLE_SQL[key] = with_facts(sql)


def _text(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumn(column, F.array_join(column, ","))


def _rows_text(column: str, *fields: str) -> Callable[[DataFrame], DataFrame]:
    """An array of structs as one text: fields with colons, rows with commas."""
    one = lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])
    return lambda d: d.withColumn(column, F.array_join(F.transform(column, one), ","))


def _sql(text: str, **values) -> str:
    for k, v in values.items():
        text = text.replace(f"${k}", "'" + v + "'" if isinstance(v, str) else str(v))
    return text


P3, P400 = "app/household/customer_000000003.rb", "app/automobile/customer_000000400.rb"
_LABEL = "CASE WHEN confidence >= 90 THEN 'rbs_annotation' WHEN confidence >= 85 THEN 'literal_or_guard' WHEN confidence >= 75 THEN 'method_return' WHEN confidence >= 55 THEN 'chain_1' WHEN confidence >= 38 THEN 'chain_2' ELSE 'inferred' END"
_PLACES = [(P3, 44, 300), (P3, 35, 5000), (P3, 32, 1), ("app/automobile/customer_000000005.rb", 60, 0), (P3, 9999, 1), (P400, 50, 3)]
_PARAMS = "CASE kind WHEN 'keyword' THEN name || ':' WHEN 'rest' THEN '*' || name WHEN 'keyword_rest' THEN '**' || name WHEN 'block' THEN '&' || name ELSE name END"
_SIGNATURES = f"SELECT symbol_id, string_agg({_PARAMS}, ', ' ORDER BY position) AS signature, string_agg(concat_ws(':', position, name, kind, type_hint, confidence), ',' ORDER BY position) AS params FROM params GROUP BY symbol_id"
_PAGE_REFS = "SELECT path, r.line, r.col, trim(t.text) AS context FROM refs r JOIN files f ON f.id = r.file_id LEFT JOIN lines t ON t.file_id = r.file_id AND t.n = r.line WHERE r.name = $name ORDER BY path, r.line, r.col LIMIT 200 OFFSET $offset"
_FIELDS = ("position", "name", "kind", "type_hint", "confidence")

# --- tool operators

ask("a1_resolve_type", "resolve_type", _sql(f"SELECT name, type_hint AS type, confidence, {_LABEL} AS label, replace(type_hint, ' | ', ',') AS types FROM local_vars JOIN files f ON f.id = file_id WHERE path = $p AND line = 44 AND type_hint IS NOT NULL ORDER BY abs(col - 3000), col, name LIMIT 1", p=P3), _text("types"), path=P3, line=44, col=3000)
ask("a1_resolve_type_of_symbol", "resolve_type", _sql("SELECT name, return_type AS type, CAST(NULL AS INT) AS confidence, 'inferred' AS label, replace(return_type, ' | ', ',') AS types FROM symbols s JOIN files f ON f.id = file_id WHERE path = $p AND line = 164 AND return_type IS NOT NULL ORDER BY col, s.id LIMIT 1", p=P3), _text("types"), path=P3, line=164)
ask(
    "a2_class_summary", "class_summary",
    """SELECT 'members' AS section, name, kind, line, return_type FROM (SELECT * FROM symbols WHERE parent_name = 'C3' AND kind IN ('def', 'classdef', 'constant') ORDER BY kind, name, id LIMIT 200)
    UNION ALL SELECT 'mixins', module_name, kind, NULL, NULL FROM (SELECT DISTINCT module_name, m.kind FROM mixins m JOIN symbols s ON s.id = m.class_id WHERE s.name = 'C3' AND s.kind IN ('class', 'module') ORDER BY 1, 2 LIMIT 50)
    UNION ALL SELECT 'ivars', name, 'ivar', NULL, type_hint FROM (SELECT DISTINCT v.name, v.type_hint FROM local_vars v JOIN symbols s ON s.id = v.class_id WHERE s.name = 'C3' AND s.kind IN ('class', 'module') AND starts_with(v.name, '@') ORDER BY 1, 2 NULLS FIRST LIMIT 100)
    UNION ALL SELECT 'callbacks', name, kind, line, return_type FROM (SELECT * FROM symbols WHERE parent_name = 'C3' AND kind = 'callback' ORDER BY line, name, id LIMIT 50)
    UNION ALL SELECT 'scopes', name, kind, line, return_type FROM (SELECT * FROM symbols WHERE parent_name = 'C3' AND kind = 'classdef' ORDER BY name, id LIMIT 50)""",
    name="C3",
)
ask(
    "a3_method_signature", "method_signature",
    f"SELECT name, parent_name, return_type, coalesce(params, '') AS params, coalesce(signature, '') AS signature, visibility, doc FROM (SELECT * FROM symbols WHERE parent_name = 'C7' AND kind IN ('def', 'classdef') AND name = 'cold_anvil' ORDER BY file_id, line, col, id LIMIT 1) s LEFT JOIN ({_SIGNATURES}) p ON p.symbol_id = s.id",
    _rows_text("params", *_FIELDS), qualified="C7#cold_anvil",
)
for _key, _tool, _name, _at in (("a4_find_callers", "find_callers", "large_gear", 0), ("a4_find_callers_second_page", "find_callers", "x", 200), ("a20_find_references", "find_references", "validates", 20)):
    ask(_key, _tool, _sql(_PAGE_REFS, name=_name, offset=_at), offset=_at, **({"method": _name, "owner": "C1"} if _tool == "find_callers" else {"name": _name}))
ask("a5_find_implementations", "find_implementations", "SELECT DISTINCT coalesce(parent_name, '<top-level>') AS owner, path, line, return_type FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'large_gear' AND kind IN ('def', 'classdef') ORDER BY owner, path, line, return_type NULLS FIRST LIMIT 100", method="large_gear")
_SYMBOLS = "SELECT name, kind, path, line, col, parent_name, return_type FROM symbols s JOIN files f ON f.id = file_id WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%$q%' $kind ORDER BY name, path, line, col LIMIT 500 OFFSET $at"
ask("a6_workspace_symbols", "workspace_symbols", _SYMBOLS.replace("$q", "bolt_1").replace("$kind", "").replace("$at", "3"), query="BOLT_1", offset=3)
ask("a6_find_symbol", "find_symbol", _SYMBOLS.replace("$q", "red_").replace("$kind", "AND kind = 'association'").replace("$at", "0"), query="red_", kind="association")
ask("a6_search_symbols", "search_symbols", _SYMBOLS.replace("$q", "m_t").replace("$kind", "").replace("$at", "0"), query="M_T")
_EDGES = "e(child, parent) AS (SELECT DISTINCT name, parent_name FROM symbols WHERE kind IN ('class', 'module') AND parent_name IS NOT NULL UNION SELECT DISTINCT s.name, m.module_name FROM mixins m JOIN symbols s ON s.id = m.class_id)"
ask(
    "a7_type_hierarchy", "type_hierarchy",
    f"""WITH RECURSIVE {_EDGES}, up(node, depth) AS (SELECT 'C31', 0 UNION SELECT parent, depth + 1 FROM up JOIN e ON e.child = node WHERE depth < 20),
    a AS (SELECT 'ancestor' AS direction, node AS name, CAST(min(depth) AS INT) AS depth FROM up GROUP BY node HAVING min(depth) > 0 ORDER BY 3, 2 LIMIT 50)
    SELECT * FROM a UNION ALL SELECT 'descendant', name, 1 FROM (SELECT DISTINCT s.name FROM symbols s JOIN mixins m ON m.class_id = s.id WHERE m.module_name = 'C31' AND s.kind IN ('class', 'module') ORDER BY 1 LIMIT 50)""",
    name="C31",
)
ask(
    "a7_type_hierarchy_of_module", "type_hierarchy",
    f"""WITH RECURSIVE {_EDGES}, up(node, depth) AS (SELECT 'M9', 0 UNION SELECT parent, depth + 1 FROM up JOIN e ON e.child = node WHERE depth < 20)
    SELECT 'ancestor' AS direction, node AS name, CAST(min(depth) AS INT) AS depth FROM up GROUP BY node HAVING min(depth) > 0
    UNION ALL SELECT 'descendant', name, 1 FROM (SELECT DISTINCT s.name FROM symbols s JOIN mixins m ON m.class_id = s.id WHERE m.module_name = 'M9' AND s.kind IN ('class', 'module') ORDER BY 1 LIMIT 50 OFFSET 2)""",
    name="M9", descendants_offset=2,
)
ask("a8_association_graph", "association_graph", "SELECT name, coalesce(doc, kind) AS type, return_type AS target, CASE WHEN starts_with(value_snippet, 'through:') THEN substr(value_snippet, 9) END AS through, line FROM symbols WHERE parent_name = 'C8' AND kind IN ('association', 'scope') ORDER BY name, type, line LIMIT 100 OFFSET 1", owner="C8", offset=1)
_ROUTES = "SELECT http_method, path_pattern, helper_name, controller, action, path, line FROM routes JOIN files f ON f.id = file_id WHERE starts_with(helper_name, '$q') ORDER BY path_pattern, http_method, path, line LIMIT $n OFFSET $at"
ask("a9_route_map", "route_map", _ROUTES.replace("$q", "nation_1").replace("$n", "200").replace("$at", "0"), prefix="NATION_1")
ask("a25_list_routes", "list_routes", _ROUTES.replace("$q", "").replace("$n", "100").replace("$at", "5"), offset=5)
ask("a10_diagnostics_of_file", "diagnostics", _sql("SELECT path, line, col, severity, code, message FROM diagnostics JOIN files f ON f.id = file_id WHERE path = $p ORDER BY line, col, code, message LIMIT 1000", p=P3), path=P3)
ask(
    "a10_diagnostics", "diagnostics",
    "SELECT path, string_agg(concat_ws(':', line, col, severity, code, message), ',' ORDER BY line, col, severity, code, message) AS findings FROM (SELECT * FROM diagnostics JOIN files f ON f.id = file_id WHERE NOT is_gem ORDER BY path, line, col, code, message LIMIT 2000 OFFSET 7) GROUP BY path",
    _rows_text("findings", "line", "col", "severity", "code", "message"), offset=7,
)
ask(
    "a11_get_symbol_source", "get_symbol_source",
    "WITH s AS (SELECT id, file_id, line AS lo, least(end_line, line + 199) AS hi FROM symbols WHERE parent_name = 'C5' AND name = 'blue_anvil_23' AND kind IN ('def', 'classdef') ORDER BY file_id, line, id LIMIT 1) SELECT s.id, lo, hi, string_agg(n || ': ' || text, chr(10) ORDER BY n) AS source FROM s JOIN lines l ON l.file_id = s.file_id AND n BETWEEN lo AND hi GROUP BY ALL",
    owner="C5", method="blue_anvil_23",
)
for _key, _args, _test in (
    ("a12_grep_source", {"query": "TOKEN"}, "contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'token')"),
    ("a12_grep_source_by_pattern", {"query": "th.+ing", "use_regex": True, "context": 2, "offset": 3, "path_pattern": "household"}, "regexp_matches(text, 'th.+ing') AND contains(path, 'household')"),
):
    _n, _at = _args.get("context", 1), _args.get("offset", 0)
    _cut = "CASE WHEN strlen(text) > 512 THEN left(text, 509) || '…' ELSE text END"
    ask(
        _key, "grep_source",
        f"""WITH own AS (SELECT id AS file_id, path FROM files WHERE NOT is_gem), h AS (SELECT l.file_id, path, n, text FROM lines l JOIN own USING (file_id) WHERE {_test} ORDER BY path, n LIMIT 100 OFFSET {_at}),
        c AS (SELECT h.path, h.n, l.n AS m, {_cut.replace("text", "l.text")} AS t FROM h JOIN lines l ON l.file_id = h.file_id AND l.n BETWEEN h.n - {_n} AND h.n + {_n})
        SELECT path, n AS line, {_cut} AS text, coalesce((SELECT string_agg(t, '⏎' ORDER BY m) FROM c WHERE c.path = h.path AND c.n = h.n AND m < h.n), '') AS before, coalesce((SELECT string_agg(t, '⏎' ORDER BY m) FROM c WHERE c.path = h.path AND c.n = h.n AND m > h.n), '') AS after FROM h""",
        lambda d: d.withColumn("before", F.array_join("before", "⏎")).withColumn("after", F.array_join("after", "⏎")), **_args,
    )
ask("a13_i18n_lookup", "i18n_lookup", "SELECT key, value, locale, path FROM i18n_keys JOIN files f ON f.id = file_id WHERE key LIKE '%a.nation_1%' ORDER BY key, locale, path LIMIT 100", query="A.Nation_1")
ask("a14_list_by_kind", "list_by_kind", "SELECT DISTINCT name, path, line FROM symbols s JOIN files f ON f.id = file_id WHERE kind = 'def' AND starts_with(name, 'cold_') AND NOT is_gem ORDER BY name, path, line LIMIT 200 OFFSET 4", kind="def", prefix="Cold_", offset=4)
ask("a15_find_unused", "find_unused", "SELECT s.name, parent_name, path, s.line FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN refs r ON r.name = s.name WHERE r.name IS NULL AND s.kind = 'def' AND NOT is_gem AND visibility <> 'private' ORDER BY path, s.line, s.name LIMIT 100")
ask("a15_find_unused_of_owner", "find_unused", "SELECT s.name, parent_name, path, s.line FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN refs r ON r.name = s.name WHERE r.name IS NULL AND s.kind = 'constant' AND parent_name = 'C25' AND NOT is_gem AND visibility <> 'private' ORDER BY path, s.line, s.name LIMIT 100", kind="constant", parent="C25")
ask("a16_get_file_overview", "get_file_overview", _sql("SELECT name, kind, line, end_line, parent_name, return_type FROM symbols WHERE file_id = (SELECT id FROM files WHERE path = $p) ORDER BY line, id LIMIT 500", p=P3), path=P3)
ask(
    "a17_list_validations", "list_validations",
    """SELECT r.name, path, r.line, r.col, trim(t.text) AS source FROM refs r JOIN files f ON f.id = r.file_id LEFT JOIN lines t ON t.file_id = r.file_id AND t.n = r.line
    WHERE r.name = 'validates' AND r.file_id IN (SELECT file_id FROM symbols WHERE name = 'C4' AND kind IN ('class', 'module')) ORDER BY r.line, path, r.col, r.name LIMIT 100""",
    owner="C4",
)
ask("a18_list_callbacks", "list_callbacks", "SELECT name, doc AS callback_type, line FROM symbols WHERE parent_name = 'C9' AND kind = 'callback' AND doc = 'before_save' ORDER BY line, name LIMIT 100", owner="C9", callback_type="before_save")
ask("a19_concern_usage", "concern_usage", "SELECT DISTINCT s.name, m.kind AS mixin_kind, path, s.line FROM symbols s JOIN files f ON f.id = s.file_id JOIN mixins m ON m.class_id = s.id WHERE (m.module_name = 'M9' OR m.module_name LIKE '%::M9') AND m.kind IN ('include', 'prepend', 'extend') ORDER BY s.name, m.kind, path, s.line LIMIT 100", module="M9")
ask(
    "a21_explain_symbol", "explain_symbol",
    f"""WITH s AS (SELECT s.*, path FROM symbols s JOIN files f ON f.id = file_id WHERE parent_name = 'C4' AND name = 'red_gear' AND kind IN ('def', 'classdef') ORDER BY file_id, line, col, s.id LIMIT 1)
    SELECT name, parent_name, path, line, return_type, doc, coalesce(params, '') AS params, coalesce(signature, '') AS signature, (SELECT count(*) FROM refs WHERE name = 'red_gear') AS n_refs,
    (SELECT string_agg(concat_ws(':', path, line, col), ',' ORDER BY path, line, col) FROM (SELECT path, r.line, r.col FROM refs r JOIN files f ON f.id = r.file_id WHERE name = 'red_gear' ORDER BY ALL LIMIT 3)) AS samples,
    (SELECT string_agg(concat_ws(':', line, col, code, message), ',' ORDER BY line, col, code, message) FROM (SELECT d.line, d.col, d.code, d.message FROM diagnostics d WHERE d.file_id = (SELECT file_id FROM s) ORDER BY d.line, d.col, d.code LIMIT 10)) AS diagnostics
    FROM s LEFT JOIN ({_SIGNATURES}) p ON p.symbol_id = s.id""",
    lambda d: _rows_text("diagnostics", "line", "col", "code", "message")(_rows_text("samples", "path", "line", "col")(_rows_text("params", *_FIELDS)(d))), qualified="C4#red_gear",
)
ask(
    "a22_batch_resolve", "batch_resolve",
    "WITH p(seq, path, line, col) AS (VALUES " + ", ".join(f"({i}, '{p}', {line}, {c})" for i, (p, line, c) in enumerate(_PLACES)) + """), b AS (SELECT p.*, v.name, v.type_hint, v.confidence, row_number() OVER (PARTITION BY seq ORDER BY abs(v.col - p.col), v.col, v.name) AS k
    FROM p LEFT JOIN (SELECT path, lv.* FROM local_vars lv JOIN files f ON f.id = file_id WHERE type_hint IS NOT NULL) v ON v.path = p.path AND v.line = p.line) SELECT seq, path, line, col, name, type_hint, confidence, replace(type_hint, ' | ', ',') AS types FROM b WHERE k = 1""",
    _text("types"), positions=_PLACES,
)
ask(
    "a23_workspace_health", "workspace_health",
    """SELECT 'files' AS what, CAST(count(*) AS DOUBLE) AS n FROM files WHERE NOT is_gem UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'methods', count(*) FROM symbols WHERE kind IN ('def', 'classdef') UNION ALL SELECT 'variables', count(*) FROM local_vars
    UNION ALL SELECT 'typed_variables', count(type_hint) FROM local_vars UNION ALL SELECT 'typed_pct', CAST(100.0 * count(type_hint) AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM local_vars
    UNION ALL SELECT 'unused_methods', count(*) FROM symbols s WHERE kind = 'def' AND visibility = 'public' AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name = s.name) UNION ALL SELECT 'severity_' || severity, count(*) FROM diagnostics GROUP BY severity""",
)
ask("a24_test_summary", "test_summary", "SELECT name, line, parent_name FROM symbols WHERE kind = 'test' AND file_id = (SELECT id FROM files WHERE path = 'app/machinery/customer_000000001.rb') ORDER BY line, name LIMIT 500", path="app/machinery/customer_000000001.rb")
ask("a27_available_code_actions", "available_code_actions", _sql("WITH t AS (SELECT count(*) AS n, bool_or(contains(text, 'frozen_string_literal')) AS frozen FROM lines WHERE file_id = (SELECT id FROM files WHERE path = $p)) SELECT unnest(['extract_method', 'extract_variable']) AS action FROM t WHERE n >= 2 UNION ALL SELECT 'add_frozen_string_literal' FROM t WHERE NOT coalesce(frozen, false)", p=P3), path=P3, line=2)
ask("a28_diagnostic_summary", "diagnostic_summary", "SELECT path, line, col, severity, code, message FROM diagnostics JOIN files f ON f.id = file_id WHERE severity = 2 AND code = 'code-error' ORDER BY path, line, col, code LIMIT 500", severity=2, code="code-error")
ask(
    "a29_explain_type_chain", "explain_type_chain",
    _sql("""WITH v AS (SELECT lv.*, path FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p OR path LIKE '%/customer_000000003.rb')
    SELECT name, line, col, type_hint, confidence, CASE WHEN confidence >= 90 THEN 'rbs' WHEN confidence >= 85 THEN 'literal_or_guard' WHEN confidence >= 75 THEN 'method_return' WHEN confidence >= 55 THEN 'chain_1_level' WHEN confidence >= 30 THEN 'chain_multi_level' ELSE 'inferred' END AS label
    FROM v WHERE type_hint IS NOT NULL AND name = (SELECT name FROM v WHERE line = 44 ORDER BY abs(col - 400), name LIMIT 1)""", p=P3),
    path="customer_000000003.rb", line=44, col=400,
)
ask(
    "a30_suggest_types", "suggest_types",
    _sql("""SELECT s.name, parent_name, s.line, coalesce(best.type_hint, 'untyped') AS suggested, best.confidence FROM (SELECT s.* FROM symbols s WHERE file_id = (SELECT id FROM files WHERE path = $p) AND kind = 'def' AND return_type IS NULL ORDER BY line, id LIMIT 20) s
    LEFT JOIN (SELECT name, type_hint, confidence FROM local_vars WHERE type_hint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY confidence DESC NULLS LAST, type_hint DESC) = 1) best ON best.name = s.name""", p=P3),
    path=P3,
)
ask(
    "a31_type_coverage", "type_coverage",
    """WITH k AS (SELECT path, count(*) AS total, count(return_type) AS typed, CAST(100.0 * count(return_type) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS pct FROM symbols s JOIN files f ON f.id = file_id WHERE kind = 'def' AND NOT is_gem GROUP BY path HAVING pct <= 60)
    SELECT * FROM k UNION ALL SELECT NULL, CAST(coalesce(sum(total), 0) AS BIGINT), CAST(coalesce(sum(typed), 0) AS BIGINT), CASE WHEN sum(total) > 0 THEN CAST(100.0 * sum(typed) AS DOUBLE) / CAST(sum(total) AS DOUBLE) END FROM k""",
    max_pct=60.0,
)
ask(
    "a32_find_similar", "find_similar",
    """SELECT name, parent_name AS class, CAST(d AS INT) AS distance, CASE WHEN d <= 2 THEN 'edit_distance' ELSE 'substring' END AS match FROM (SELECT DISTINCT name, parent_name, levenshtein(name, 'red_gear') AS d FROM symbols s WHERE kind = 'def' AND name <> 'red_gear' AND file_id IN (SELECT id FROM files WHERE NOT is_gem))
    WHERE d <= 2 OR (length(name) >= 3 AND (contains(name, 'red_gear') OR contains('red_gear', name))) ORDER BY d, name, class NULLS FIRST LIMIT 50""",
    name="red_gear", max_distance=2,
)

# --- editor operators

_RANKED = """WITH t AS (SELECT s.name, kind, path, line, col, CASE WHEN starts_with(lower(name), '$q') THEN 0 WHEN contains(lower(name), '$q') THEN 1 WHEN regexp_matches(lower(name), '$fuzzy') THEN 2 END AS tier, CASE WHEN lower(name) = '$q' THEN 0 WHEN starts_with(lower(name), '$q') THEN 1 ELSE 2 END AS rank
    FROM symbols s JOIN files f ON f.id = file_id WHERE NOT is_gem), n AS (SELECT count(*) FILTER (tier = 0) AS n0, count(*) FILTER (tier <= 1) AS n1 FROM t)
    SELECT t.* FROM t, n WHERE tier = 0 OR tier = 1 AND n0 < 10 OR tier = 2 AND n1 < 10 ORDER BY tier, rank, length(name), name, path, line, col LIMIT 500"""
ask("b1_workspace_symbol", "workspace/symbol", _RANKED.replace("$q", "red_rod").replace("$fuzzy", "r.*e.*d.*_.*r.*o.*d"), query="Red_Rod")
ask("b1_workspace_symbol_fuzzy", "workspace/symbol", _RANKED.replace("$q", "ldpl1").replace("$fuzzy", "l.*d.*p.*l.*1"), query="ldpl1")
ask("b1_workspace_symbol_variables", "workspace/symbol", "SELECT DISTINCT name, 'variable' AS kind, path, line, col FROM local_vars lv JOIN files f ON f.id = file_id WHERE starts_with(name, '$fl') AND NOT is_gem ORDER BY name, path, line, col LIMIT 100", query="$FL")
ask(
    "b2_document_symbol", "documentSymbol",
    _sql("""SELECT s.id, name, kind, line, greatest(coalesce(end_line, lead(line) OVER w - 1, line), line) AS end_line, CASE WHEN kind NOT IN ('class', 'module') THEN (SELECT o.id FROM symbols o WHERE o.file_id = s.file_id AND o.kind IN ('class', 'module') AND (o.line, o.col, o.id) < (s.line, s.col, s.id) ORDER BY o.line DESC, o.col DESC, o.id DESC LIMIT 1) END AS container_id
    FROM symbols s WHERE file_id = (SELECT id FROM files WHERE path = $p) WINDOW w AS (ORDER BY line, col, s.id)""", p=P3),
    path=P3,
)
ask("b3_definition_of_variable", "variable", _sql("SELECT path, name, line, col, type_hint, confidence, scope_id FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND name = 'x' AND line <= 150 ORDER BY line DESC, col DESC LIMIT 1", p=P3), path=P3, name="x", line=150)
ask("b3_definition_in_scope", "variable", _sql("SELECT path, name, line, col, type_hint, confidence, scope_id FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND name = 'x' AND scope_id = 8 ORDER BY line DESC, col DESC LIMIT 1", p=P3), path=P3, name="x", line=20, scope_id=8)
_DEFINED = """SELECT name, kind, line, col, path FROM (SELECT name, kind, s.line, s.col, path FROM symbols s JOIN files f ON f.id = file_id WHERE name = '$q' OR name LIKE '%::$q' AND kind IN ('class', 'module', 'association', 'scope', 'validation', 'callback')
    UNION SELECT s.name, s.kind, s.line, s.col, path FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.name = '$q' AND s.kind = 'def' AND s.file_id IN (SELECT o.file_id FROM symbols o JOIN mixins m ON m.module_name = o.name WHERE o.kind IN ('class', 'module'))) ORDER BY name <> '$q', path, line, col LIMIT 10"""
ask("b4_definitions_by_name", "definition", _DEFINED.replace("$q", "large_gear"), name="large_gear")
ask("b4_definitions_by_last_part", "definition", _DEFINED.replace("$q", "M7"), name="M7")
ask("b5_implementation", "implementation", "SELECT parent_name, path, line, col FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'large_gear' AND kind IN ('def', 'classdef') AND parent_name <> 'C4' ORDER BY parent_name, path, line, col LIMIT 50", method="large_gear", owner="C4")
ask("b6_references_in_scope", "references", _sql("SELECT DISTINCT path, line, col FROM (SELECT file_id, line, col FROM local_vars WHERE name = 'x' AND scope_id = 8 UNION ALL SELECT file_id, line, col FROM refs WHERE name = 'x' AND scope_id = 8) v JOIN files f ON f.id = file_id WHERE path = $p", p=P3), path=P3, name="x", scope_id=8)
ask("b6_references_by_name", "references", "SELECT DISTINCT path, r.line, r.col FROM refs r JOIN files f ON f.id = file_id WHERE name = 'validates'", path=P3, name="validates", scope_id=None)
ask(
    "b7_type_definition", "typeDefinition",
    _sql("""WITH t AS (SELECT unnest(string_split(type_hint, ' | ')) AS t FROM (SELECT type_hint FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND name = 'x' AND line <= 200 ORDER BY line DESC, lv.col DESC LIMIT 1))
    SELECT s.name, t AS full, path, s.line, s.col FROM symbols s JOIN files f ON f.id = file_id JOIN t ON s.name = t OR s.name LIKE '%::' || t WHERE kind IN ('class', 'module') ORDER BY s.name <> t, s.id LIMIT 5""", p=P3),
    path=P3, name="x", line=200,
)
ask("b8_prepare_type_hierarchy", "prepareTypeHierarchy", "SELECT s.id, name, kind, path, line, col FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'M3' AND kind IN ('class', 'module', 'classdef') ORDER BY path, line, s.id LIMIT 1", name="M3")
ask(
    "b9_supertypes", "supertypes",
    """WITH RECURSIVE up(name, depth) AS (SELECT parent_name, 1 FROM symbols WHERE name = 'C31' AND kind IN ('class', 'module') UNION SELECT s.parent_name, depth + 1 FROM up JOIN symbols s ON s.name = up.name AND s.kind IN ('class', 'module') WHERE depth < 8)
    SELECT DISTINCT name FROM (SELECT name FROM up WHERE name IS NOT NULL AND name <> 'C31' UNION ALL SELECT m.module_name FROM mixins m JOIN symbols s ON s.id = m.class_id WHERE s.name = 'C31')""",
    name="C31",
)
ask("b10_subtypes", "subtypes", "SELECT name, path, line FROM symbols s JOIN files f ON f.id = file_id WHERE parent_name = 'C9' AND kind = 'class' ORDER BY name, path, line LIMIT 50", name="C9")
ask("b11_prepare_call_hierarchy", "prepareCallHierarchy", "SELECT s.id, name, kind, path, line, col FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'large_gear' ORDER BY path, line, s.id LIMIT 1", name="large_gear")
ask(
    "b12_incoming_calls", "incomingCalls",
    """WITH r AS (SELECT r.file_id, path, r.line, r.col FROM refs r JOIN files f ON f.id = file_id WHERE name = 'x' ORDER BY path, r.line, r.col LIMIT 100), d AS (SELECT file_id, line, max(name) AS name, max_by(kind, name || ' ' || kind) AS kind FROM symbols WHERE kind IN ('def', 'classdef', 'test') GROUP BY file_id, line)
    SELECT r.path, r.line, r.col, coalesce(d.name, regexp_extract(path, '[^/]*$')) AS caller, d.kind AS caller_kind, d.line AS def_line FROM r ASOF LEFT JOIN d ON r.file_id = d.file_id AND r.line >= d.line""",
    name="x",
)
ask(
    "b13_outgoing_calls", "outgoingCalls",
    _sql("""WITH c AS (SELECT DISTINCT r.name, r.line, r.col FROM refs r JOIN symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.line AND s.end_line JOIN files f ON f.id = s.file_id WHERE path = $p AND s.name = 'red_gear_49' AND s.kind IN ('def', 'classdef'))
    SELECT c.name, c.line, c.col, t.path AS target_path, t.line AS target_line FROM c LEFT JOIN (SELECT s.name, path, s.line FROM symbols s JOIN files f ON f.id = file_id WHERE kind = 'def' QUALIFY row_number() OVER (PARTITION BY s.name ORDER BY path, s.line, s.id) = 1) t ON t.name = c.name""", p=P400),
    path=P400, name="red_gear_49",
)
ask(
    "b14_hover_local", "hover/local",
    _sql("""WITH k AS (SELECT type_hint, confidence FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND name = '@price' AND line <= 300 AND type_hint IS NOT NULL ORDER BY line DESC, lv.col DESC LIMIT 10)
    SELECT '@price' AS name, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT unnest(string_split(type_hint, ' | ')) AS t FROM k)) AS types, max(confidence) AS confidence FROM k HAVING count(*) > 0""", p=P3),
    _text("types"), path=P3, name="@price", line=300,
)
ask(
    "b15_hover_method", "hover/method",
    f"""SELECT name, parent_name, return_type, doc, coalesce(signature, '') AS signature FROM (SELECT * FROM symbols s WHERE name = 'red_gear' AND kind IN ('def', 'classdef') AND (parent_name = 'C4' OR parent_name IS NULL AND file_id IN (SELECT file_id FROM symbols WHERE kind IN ('class', 'module') AND name = 'C4')) ORDER BY coalesce(parent_name = 'C4', false) DESC, doc IS NOT NULL DESC, id LIMIT 1) s LEFT JOIN ({_SIGNATURES}) p ON p.symbol_id = s.id""",
    owner="C4", name="red_gear",
)
ask(
    "b16_hover_name", "hover/name",
    _sql("""WITH s AS (SELECT s.*, path FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'C3' OR name LIKE '%::C3' AND kind IN ('class', 'module', 'association', 'scope', 'validation', 'callback') ORDER BY path <> $p, name <> 'C3', s.id LIMIT 1)
    SELECT name, kind, path, line, return_type, doc, '' AS signature, '' AS params, (SELECT string_agg(m.kind || ':' || module_name, ',' ORDER BY m.kind, module_name) FROM mixins m WHERE m.class_id = s.id) AS mixins FROM s""", p=P3),
    lambda d: _rows_text("mixins", "kind", "module_name")(_rows_text("params", *_FIELDS)(d)), name="C3", path=P3,
)
_TYPED = "CASE WHEN type_hint IS NOT NULL AND coalesce(confidence, 50) >= 50 THEN $sep || type_hint ELSE '' END"
ask(
    "b16_hover_method_name", "hover/name",
    f"""WITH s AS (SELECT s.*, path FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'red_bolt_19' ORDER BY path <> '{P3}', name <> 'red_bolt_19', s.id LIMIT 1)
    SELECT name, kind, path, line, return_type, doc, (SELECT string_agg(CASE kind WHEN 'keyword' THEN name || ':' || {_TYPED.replace("$sep", "' '")} WHEN 'rest' THEN '*' || name || {_TYPED.replace("$sep", "': '")} WHEN 'keyword_rest' THEN '**' || name WHEN 'block' THEN '&' || name ELSE name || {_TYPED.replace("$sep", "': '")} END, ', ' ORDER BY position) FROM params WHERE symbol_id = s.id) AS signature,
    (SELECT string_agg(concat_ws(':', position, name, kind, type_hint, confidence), ',' ORDER BY position) FROM params WHERE symbol_id = s.id) AS params, NULL::VARCHAR AS mixins FROM s""",
    lambda d: _rows_text("mixins", "kind", "module_name")(_rows_text("params", *_FIELDS)(d)), name="red_bolt_19", path=P3,
)
ask("b17_class_methods", "hover/class", "SELECT name, bool_or(doc IS NOT NULL) AS documented, (SELECT count(DISTINCT name) FROM symbols WHERE parent_name = 'C4' AND kind = 'def' AND visibility <> 'private') AS n_methods FROM symbols WHERE parent_name = 'C4' AND kind = 'def' AND visibility <> 'private' GROUP BY name ORDER BY documented DESC, name LIMIT 10", owner="C4")
ask("b18_hover_i18n", "hover/i18n", "SELECT locale, value FROM i18n_keys WHERE key = 'asia.nation_2' ORDER BY locale, value LIMIT 10", key="asia.nation_2")
ask(
    "b19_complete_dot", "completion/dot",
    """WITH RECURSIVE parts(i, t) AS (VALUES (0, 'C31'), (1, 'C3')), p(child, parent) AS (SELECT DISTINCT name, parent_name FROM symbols WHERE kind IN ('class', 'module') AND parent_name IS NOT NULL), x(child, module_name, kind) AS (SELECT DISTINCT s.name, m.module_name, m.kind FROM mixins m JOIN symbols s ON s.id = m.class_id),
    up(i, cls, depth) AS (SELECT i, t, 0 FROM parts UNION SELECT i, p.parent, depth + 1 FROM up JOIN p ON p.child = up.cls WHERE depth < 8), c AS (SELECT i, cls, min(depth) AS depth FROM up GROUP BY i, cls),
    o AS (SELECT owner, min(rank) AS rank FROM (SELECT cls AS owner, i * 1000 + depth * 4 + 1 AS rank FROM c UNION ALL SELECT x.module_name, i * 1000 + depth * 4 + CASE WHEN x.kind = 'prepend' THEN 0 ELSE 2 END FROM c JOIN x ON x.child = c.cls) GROUP BY owner)
    SELECT name, owner, CAST(rank AS INT) AS rank, return_type, doc FROM (SELECT s.name, owner, rank, return_type, doc, row_number() OVER (PARTITION BY s.name ORDER BY rank, s.id) AS k FROM symbols s JOIN o ON o.owner = s.parent_name WHERE kind IN ('def', 'classdef') AND starts_with(s.name, 'r') AND visibility = 'public') WHERE k = 1 ORDER BY rank, name LIMIT 200""",
    receiver="C31 | C3", prefix="r",
)
ask("b20_complete_namespace", "completion/namespace", "SELECT name, kind FROM symbols WHERE parent_name = 'C3' AND kind IN ('classdef', 'constant', 'def', 'class', 'module') ORDER BY name, kind, id LIMIT 100", parent="C3")
ask(
    "b21_complete_arguments", "completion/arguments",
    _sql("""SELECT 0 AS tier, name, 'variable' AS kind FROM (SELECT DISTINCT lv.name FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND line <= 400 AND starts_with(lower(lv.name), 'b') ORDER BY 1 LIMIT 50)
    UNION ALL SELECT 1, name, kind FROM (SELECT DISTINCT name, kind FROM symbols WHERE kind IN ('def', 'classdef', 'class', 'module', 'constant') AND starts_with(lower(name), 'b') ORDER BY length(name), name, kind LIMIT 200)""", p=P3),
    path=P3, line=400, prefix="b",
)
ask("b22_complete_all", "completion/all", "SELECT DISTINCT name, kind FROM symbols ORDER BY length(name), name, kind LIMIT 500")
ask(
    "b23_complete_instance_variables", "completion/ivars",
    _sql("""SELECT DISTINCT name, type_hint FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND starts_with(name, '@') AND (class_id IS NULL OR class_id = (SELECT s.id FROM symbols s JOIN files g ON g.id = s.file_id WHERE g.path = $p AND s.kind IN ('class', 'module') AND s.line <= 100 ORDER BY s.line DESC, s.id DESC LIMIT 1))""", p=P3),
    path=P3, line=100,
)
ask("b24_complete_globals", "completion/globals", "SELECT DISTINCT name FROM local_vars WHERE starts_with(name, '$f') ORDER BY name LIMIT 200", prefix="$F")
ask("b25_complete_i18n", "completion/i18n", "SELECT DISTINCT key, value FROM i18n_keys WHERE starts_with(key, 'europe.') ORDER BY key, value LIMIT 50", prefix="Europe.")
ask("b25_complete_routes", "completion/routes", "SELECT helper_name, http_method, path_pattern FROM routes WHERE starts_with(helper_name, 'nation_2') ORDER BY helper_name, http_method, path_pattern LIMIT 50", prefix="nation_2")
ask(
    "b26_complete_general", "completion/general",
    f"""WITH c AS (SELECT name, kind, return_type, doc, CASE WHEN starts_with(lower(name), 'x') THEN 2 ELSE 3 END AS rank, id AS tie, id FROM symbols WHERE contains(lower(name), 'x')
    UNION ALL SELECT name, 'variable', type_hint, NULL, 0, line, NULL FROM local_vars lv WHERE file_id = (SELECT id FROM files WHERE path = '{P3}') AND starts_with(lower(name), 'x') AND line <= 400
    UNION ALL SELECT p.name, 'keyword', type_hint, NULL, 1, position, NULL FROM params p JOIN symbols s ON s.id = symbol_id WHERE s.name = 'red_anvil_48' AND s.kind = 'def' AND p.kind = 'keyword' AND starts_with(lower(p.name), 'x'))
    SELECT name, kind, return_type, doc, rank, coalesce(signature, '') AS signature FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, tie, kind) = 1 ORDER BY rank, length(name), name LIMIT 200) LEFT JOIN ({_SIGNATURES}) p ON p.symbol_id = id""",
    prefix="x", path=P3, line=400, callee="red_anvil_48",
)
ask(
    "b26_complete_general_by_name", "completion/general",
    f"""SELECT name, kind, return_type, doc, rank, coalesce(signature, '') AS signature FROM (SELECT *, CASE WHEN starts_with(name, 'rod_1') THEN 2 ELSE 3 END AS rank FROM symbols WHERE contains(lower(name), 'rod_1') QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, id, kind) = 1 ORDER BY rank, length(name), name LIMIT 200) LEFT JOIN ({_SIGNATURES}) p ON p.symbol_id = id""",
    prefix="Rod_1",
)
ask("b27_complete_env", "completion/env", """SELECT DISTINCT unnest(regexp_extract_all(text, 'ENV\\["([A-Za-z0-9_]+)"\\]', 1) || regexp_extract_all(text, 'ENV\\.fetch\\(\\s*"([A-Za-z0-9_]+)"', 1)) AS name FROM lines l JOIN files f ON f.id = file_id WHERE NOT is_gem AND contains(text, 'ENV')""")
ask("b27_complete_require", "completion/require", "SELECT DISTINCT regexp_replace(path, '\\.rb$', '') AS name FROM files WHERE NOT is_gem AND starts_with(path, 'app/furniture/customer_0000001') ORDER BY name LIMIT 50", prefix="app/furniture/customer_0000001")
ask("b28_completion_resolve", "completion/resolve", "SELECT doc, return_type FROM symbols WHERE name = 'red_plate' AND kind = 'def' ORDER BY doc IS NULL, id LIMIT 1", name="red_plate")
ask(
    "b30_signature_help", "signatureHelp",
    f"SELECT name, parent_name, return_type, coalesce(params, '') AS params, coalesce(signature, '') AS signature, visibility, doc FROM (SELECT * FROM symbols WHERE name = 'red_plate' AND kind IN ('def', 'classdef') ORDER BY file_id, line, col, id LIMIT 1) s LEFT JOIN ({_SIGNATURES}) p ON p.symbol_id = s.id",
    _rows_text("params", *_FIELDS), qualified="red_plate",
)
ask("b31_inlay_hint", "inlayHint", _sql("SELECT DISTINCT line, CAST(lv.col + length(name) AS INT) AS col, ': ' || type_hint AS label FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND type_hint IS NOT NULL AND line BETWEEN 30 AND 200 UNION SELECT line, s.col, ' -> ' || return_type FROM symbols s JOIN files f ON f.id = file_id WHERE path = $p AND return_type IS NOT NULL AND kind = 'def' AND line BETWEEN 30 AND 200", p=P3), path=P3, first=30, last=200)
ask("b32_document_highlight", "documentHighlight", _sql("SELECT line, col, max(kind) AS kind FROM (SELECT file_id, line, col, 'write' AS kind FROM symbols WHERE name = 'x' UNION ALL SELECT file_id, line, col, 'write' FROM local_vars WHERE name = 'x' UNION ALL SELECT file_id, line, col, 'read' FROM refs WHERE name = 'x') h JOIN files f ON f.id = file_id WHERE path = $p GROUP BY line, col", p=P3), path=P3, name="x")
ask("b33_scope", "scope", _sql("SELECT coalesce((SELECT scope_id FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND name = 'x' AND line <= 300 AND scope_id IS NOT NULL ORDER BY line DESC, lv.col DESC LIMIT 1), (SELECT scope_id FROM refs r JOIN files f ON f.id = file_id WHERE path = $p AND name = 'x' AND line = 300 AND r.col <= 5 ORDER BY r.col DESC LIMIT 1)) AS scope_id", p=P3), path=P3, name="x", line=300, col=5)
ask("b34_selection_range", "selectionRange", _sql("SELECT name, kind, line, end_line, end_line - line AS span FROM symbols s JOIN files f ON f.id = file_id WHERE path = $p AND line <= 130 AND end_line >= 130", p=P3), path=P3, line=130)
ask("b35_linked_editing_range", "linkedEditingRange", _sql("SELECT DISTINCT path, line, col FROM local_vars lv JOIN files f ON f.id = file_id WHERE path = $p AND name = '_tmp' AND scope_id = 8", p=P3), path=P3, name="_tmp", scope_id=8)
ask("b36_code_lens", "codeLens", _sql("SELECT s.name, s.kind, s.line, count(r.name) FILTER (r.file_id = s.file_id) AS local_refs, count(r.name) FILTER (r.file_id <> s.file_id) AS other_refs FROM symbols s JOIN files f ON f.id = s.file_id LEFT JOIN refs r ON r.name = s.name WHERE path = $p AND s.kind IN ('class', 'module', 'def', 'classdef') GROUP BY s.id, s.name, s.kind, s.line", p=P400), path=P400)
ask("b37_document_link", "documentLink", _sql("SELECT n AS line, regexp_extract(text, 'require \"([^\"]+)\"', 1) AS target, (SELECT min(path) FROM files WHERE NOT is_gem AND path LIKE '%/' || regexp_extract(text, 'require \"([^\"]+)\"', 1) || '.rb') AS target_path FROM lines l JOIN files f ON f.id = file_id WHERE path = $p AND starts_with(text, 'require')", p=P3), path=P3)
_DOWN = """WITH RECURSIVE own AS (SELECT s.* FROM symbols s JOIN files f ON f.id = file_id WHERE NOT is_gem AND kind IN ('class', 'module')), e(parent, child) AS (SELECT parent_name, name FROM own WHERE parent_name IS NOT NULL UNION SELECT m.module_name, own.name FROM mixins m JOIN own ON own.id = m.class_id),
    down(name, depth) AS (SELECT 'C9', 0 UNION SELECT e.child, depth + 1 FROM down JOIN e ON e.parent = down.name WHERE depth < 4)"""
ask(
    "b39_rename_method", "rename",
    f"""{_DOWN}, homes AS (SELECT DISTINCT file_id FROM symbols WHERE kind IN ('class', 'module', 'classdef', 'def') AND name IN (SELECT name FROM down))
    SELECT DISTINCT path, line, col FROM (SELECT file_id, line, col FROM symbols WHERE name = 'x' UNION ALL SELECT file_id, line, col FROM refs WHERE name = 'x') u JOIN files f ON f.id = file_id WHERE NOT is_gem AND file_id IN (SELECT file_id FROM homes)""",
    name="x", owner="C9",
)
ask("b39_rename_everywhere", "rename", "SELECT DISTINCT path, line, col FROM (SELECT file_id, line, col FROM symbols WHERE name = 'large_gear' UNION ALL SELECT file_id, line, col FROM refs WHERE name = 'large_gear') u JOIN files f ON f.id = file_id WHERE NOT is_gem", name="large_gear")
ask("b39_rename_local", "rename/local", _sql("SELECT DISTINCT path, line, col FROM (SELECT file_id, line, col FROM local_vars WHERE name = '_tmp' AND scope_id IS NULL UNION ALL SELECT file_id, line, col FROM local_vars WHERE name = '_tmp' AND scope_id = 8 UNION ALL SELECT file_id, line, col FROM refs WHERE name = '_tmp' AND scope_id = 8) u JOIN files f ON f.id = file_id WHERE path = $p AND (file_id, line, col) IN (SELECT file_id, line, col FROM local_vars WHERE name = '_tmp' AND scope_id = 8)", p=P3), path=P3, name="_tmp", scope_id=8)
ask("b40_prepare_rename", "prepareRename", "SELECT count(*) > 0 AS valid FROM (SELECT s.name FROM symbols s JOIN files f ON f.id = file_id WHERE NOT is_gem AND name = 'large_gear' UNION ALL SELECT lv.name FROM local_vars lv JOIN files f ON f.id = file_id WHERE NOT is_gem AND name = 'large_gear')", name="large_gear")
ask("b40_will_rename_files", "willRenameFiles", "SELECT path, n AS line, replace(text, 'customer_000000003', 'client') AS text FROM lines l JOIN files f ON f.id = file_id WHERE NOT is_gem AND text = 'require \"customer_000000003\"'", old="lib/customer_000000003.rb", new="lib/client.rb")
ask(
    "resource_class_card", "card",
    f"""WITH s AS (SELECT s.*, path FROM symbols s JOIN files f ON f.id = file_id WHERE name = 'C3' AND kind IN ('class', 'module') ORDER BY path, line, s.id LIMIT 1)
    SELECT name, '# ' || kind || ' ' || name || chr(10) || path || ':' || line || chr(10) || chr(10) || '## Methods' || chr(10) || coalesce((SELECT string_agg('- ' || name, chr(10) ORDER BY name) FROM (SELECT name FROM symbols WHERE parent_name = 'C3' AND kind IN ('def', 'classdef') ORDER BY kind DESC, name, id LIMIT 50)), '') || chr(10) || chr(10) || '## Associations' || chr(10)
    || coalesce((SELECT string_agg('- ' || name, chr(10) ORDER BY name) FROM (SELECT name FROM symbols WHERE parent_name = 'C3' AND kind = 'association' ORDER BY name, id LIMIT 30)), '') || chr(10) || chr(10) || '## Mixins' || chr(10) || coalesce((SELECT string_agg('- ' || m.kind || ' ' || module_name, chr(10) ORDER BY m.kind, module_name) FROM mixins m WHERE m.class_id = s.id), '') || chr(10) AS markdown FROM s""",
    name="C3",
)

# --- administration and checks

ask("k1_stats", "stats", "SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'diagnostics', count(*) FROM diagnostics")
ask("k2_kinds", "kinds", "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
ask("k2_summary", "summary", "SELECT (SELECT count(*) FROM files WHERE NOT is_gem) AS files, (SELECT count(*) FROM files WHERE is_gem) AS gem_files, (SELECT count(*) FROM symbols) AS symbols, (SELECT value FROM meta WHERE key = 'schema_version') AS schema_version")
ask(
    "k3_dump_symbols", "dump-symbols",
    """SELECT '{"path":"' || path || '","name":"' || name || '","kind":"' || kind || '","line":' || line || ',"col":' || s.col || coalesce(',"parent_name":"' || parent_name || '"', '') || coalesce(',"return_type":"' || return_type || '"', '') || '}' AS value FROM symbols s JOIN files f ON f.id = file_id WHERE NOT is_gem""",
)
ask(
    "k5_check", "check",
    """SELECT problem, n FROM (SELECT 'symbols without file' AS problem, count(*) AS n FROM symbols WHERE file_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'refs without file', count(*) FROM refs WHERE file_id NOT IN (SELECT id FROM files) UNION ALL SELECT 'params without symbol', count(*) FROM params WHERE symbol_id NOT IN (SELECT id FROM symbols)
    UNION ALL SELECT 'lines without file', 0 UNION ALL SELECT 'refs with one key', count(*) FROM (SELECT 1 FROM refs GROUP BY file_id, name, line, col HAVING count(*) > 1) UNION ALL SELECT 'local_vars with one key', count(*) FROM (SELECT 1 FROM local_vars GROUP BY file_id, name, line, col HAVING count(*) > 1)) WHERE n > 0""",
)


def check(key: str, code: str, sql: str) -> None:
    """Register one check; its SQL gives file_id, line, col and message."""
    QUERIES[key] = lambda spark, sf_dir: lint.CHECKS[code](facts(spark, sf_dir))
    ORACLE_SQL[key] = with_facts(sql)


def _finding(code: str, severity: int, message: str, rest: str) -> str:
    return f"SELECT file_id, line, col, {message} AS message, {severity} AS severity, '{code}' AS code FROM {rest}"


check("l1_unused_variable", "unused-variable", _finding("unused-variable", 2, "'unused variable ' || name", "local_vars v WHERE left(name, 1) NOT IN ('_', '@', '$') AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.file_id = v.file_id AND r.name = v.name)"))
check("l2_unused_parameter", "unused-parameter", _finding("unused-parameter", 4, "'unused parameter ' || p", "(SELECT s.*, p.name AS p FROM params p JOIN symbols s ON s.id = symbol_id WHERE s.kind = 'def' AND left(p.name, 1) <> '_') s WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.file_id = s.file_id AND r.name = p) AND NOT EXISTS (SELECT 1 FROM local_vars v WHERE v.file_id = s.file_id AND v.name = p)"))
check("l3_unused_method", "unused-method", _finding("unused-method", 4, "'nothing calls ' || name", "symbols s WHERE kind = 'def' AND visibility = 'public' AND left(name, 1) <> '_' AND NOT starts_with(name, 'test_') AND file_id IN (SELECT id FROM files WHERE NOT is_gem) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.name = s.name)"))
check("l4_duplicate_method", "duplicate-method", _finding("duplicate-method", 2, "name || ' is defined more than once'", "symbols s WHERE kind = 'def' AND EXISTS (SELECT 1 FROM symbols o WHERE o.file_id = s.file_id AND o.name = s.name AND o.kind = 'def' AND o.id <> s.id AND coalesce(o.parent_name, '') = coalesce(s.parent_name, ''))"))
check(
    "l5_undefined_method", "undefined-method",
    """WITH RECURSIVE c AS (SELECT r.* FROM refs r WHERE NOT regexp_matches(r.name, '^[A-Z_]') AND r.name NOT IN ('validates', 'x') AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = r.name) AND NOT EXISTS (SELECT 1 FROM local_vars v WHERE v.file_id = r.file_id AND v.name = r.name)),
    o AS (SELECT DISTINCT name FROM symbols WHERE kind IN ('def', 'classdef') AND regexp_matches(name, '^[a-z_]')),
    b AS (SELECT DISTINCT c.name, o.name AS best, levenshtein(c.name, o.name) AS d FROM (SELECT DISTINCT name FROM c) c JOIN o ON contains(lower(o.name), lower(c.name)) WHERE levenshtein(c.name, o.name) BETWEEN 1 AND least(2, length(c.name) // 2 + 1) QUALIFY row_number() OVER (PARTITION BY c.name ORDER BY d, o.name) = 1),
    i AS (SELECT c.file_id, c.name, c.line, c.col, s.name AS cls FROM c JOIN symbols s ON s.file_id = c.file_id AND s.kind IN ('class', 'module') AND c.line BETWEEN s.line AND s.end_line QUALIFY row_number() OVER (PARTITION BY c.file_id, c.name, c.line, c.col ORDER BY s.line DESC, s.end_line, s.name DESC) = 1),
    e(child, parent) AS (SELECT DISTINCT name, parent_name FROM symbols WHERE kind IN ('class', 'module') AND parent_name IS NOT NULL UNION SELECT DISTINCT s.name, m.module_name FROM mixins m JOIN symbols s ON s.id = m.class_id),
    up(root, node) AS (SELECT DISTINCT cls, cls FROM i UNION SELECT root, parent FROM up JOIN e ON e.child = node)
    SELECT file_id, line, col, 'undefined method ' || i.name || ', did you mean ' || best || '?' AS message, 2 AS severity, 'undefined-method' AS code FROM i JOIN b ON b.name = i.name WHERE NOT EXISTS (SELECT 1 FROM up WHERE root = cls AND node NOT IN (SELECT name FROM symbols WHERE kind IN ('class', 'module')))""",
)
check("l6_nil_receiver", "nil-receiver", _finding("nil-receiver", 2, "name || ' is called on nil'", "refs WHERE receiver_type = 'NilClass'"))
check(
    "l7_wrong_arity", "wrong-arity",
    """SELECT r.file_id, r.line, r.col, r.name || ' takes ' || a.fixed || ' arguments, not ' || r.arg_count AS message, 2 AS severity, 'wrong-arity' AS code FROM refs r JOIN symbols s ON s.name = r.name AND s.parent_name = r.receiver_type AND s.kind IN ('def', 'classdef')
    JOIN (SELECT symbol_id, sum(CASE WHEN kind IN ('rest', 'keyword_rest', 'block') THEN 1 ELSE 0 END) AS more, CAST(sum(CASE WHEN kind IN ('rest', 'keyword_rest', 'block') THEN 0 ELSE 1 END) AS BIGINT) AS fixed FROM params GROUP BY symbol_id) a ON a.symbol_id = s.id
    WHERE r.arg_count > 0 AND r.receiver_type <> 'NilClass' AND more = 0 AND fixed > 0 AND r.arg_count > fixed AND (SELECT count(*) FROM symbols o WHERE o.name = r.name AND o.parent_name = r.receiver_type AND o.kind IN ('def', 'classdef')) = 1""",
)
