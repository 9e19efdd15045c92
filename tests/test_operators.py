"""Named operators on a small hand-written code base."""

import pytest
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.operators import graph, health, lint, lookup, references, search, tokens, writes
from symdex.plans import registry


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_every_tool_is_registered():
    assert len(registry.TOOLS) == 34 and {"find_symbol", "search_symbols"} <= set(registry.TOOLS)


def test_search(facts):
    assert rows(search.workspace_symbols(facts, "NAME"), "name") == [("full_name",), ("name",)]
    assert rows(search.workspace_symbols(facts, "n_me"), "name") == [("full_name",), ("name",)]  # wildcards work
    assert rows(search.ranked_symbols(facts, "na"), "name", "tier") == [("name", 0), ("full_name", 1), ("normalize", 2)][:2] + [("normalize", 2)]
    assert rows(search.ranked_symbols(facts, "$de"), "name") == [("$debug",)]
    assert rows(search.list_by_kind(facts, "class"), "name") == [("Loop",), ("Order",), ("User",)]
    assert rows(search.find_similar(facts, "totals"), "name", "distance") == [("total", 1), ("total_sum", 3)]
    assert rows(search.i18n_lookup(facts, "user"), "locale") == [("de",), ("en",)]
    assert rows(search.list_routes(facts, "USERS"), "action") == [("index",)]
    assert rows(search.complete_general(facts, "total", "app/order.rb", 9), "name")[0] == ("total",)
    assert rows(search.complete_env(facts)) == [("HOME_DIR",)]
    assert rows(search.complete_globals(facts)) == [("$debug",)]
    assert rows(search.complete_instance_variables(facts, "app/user.rb", 5)) == [("@name", "String")]
    assert rows(search.complete_detail(facts, "name"), "doc") == [("The name.",)]


def test_lookup(facts):
    assert rows(lookup.resolve_type(facts, "app/order.rb", 5, 9), "name", "type", "label") == [("y", "Hash", "literal_or_guard")]
    assert rows(lookup.resolve_type(facts, "app/user.rb", 2, 0), "name", "types") == [("@name", ["String"])]
    assert rows(lookup.resolve_type(facts, "app/order.rb", 2), "name", "type") == [("total", "Integer")]
    assert rows(lookup.batch_resolve(facts, [("app/order.rb", 5, 9), ("nowhere", 1, 1), ("app/order.rb", 3, 0)]), "seq", "name") == [(0, "y"), (1, None), (2, "x")]
    assert rows(lookup.method_signature(facts, "User#name"), "signature", "return_type") == [("style, *rest", "String")]
    assert rows(lookup.explain_type_chain(facts, "order.rb", 5, 0), "line", "confidence") == [(5, 90), (3, 55)]
    one = lookup.explain_symbol(facts, "User#name").first()
    assert one["n_refs"] == 2 and len(one["samples"]) == 2 and len(one["params"]) == 2
    assert {r["section"] for r in lookup.class_summary(facts, "User").collect()} == {"members", "mixins", "ivars", "callbacks"}
    assert rows(lookup.association_graph(facts, "User"), "type", "through") == [("has_many", "memberships")]
    assert rows(lookup.list_callbacks(facts, "User", "before_save"), "name") == [("normalize",)]
    assert rows(lookup.list_validations(facts, "User"), "name", "source") == [("validates", "validates :name")]
    assert rows(lookup.variable_at(facts, "app/order.rb", "x", 4), "type_hint") == [("Integer | String",)]
    assert rows(lookup.hover_local(facts, "app/order.rb", "x", 9), "types") == [(["Float", "Integer", "String"],)]
    assert rows(lookup.symbol_source(facts, "User", "full_name"), "source")[0][0].startswith("5:   def full_name")
    assert rows(lookup.enclosing(facts, "app/user.rb", 6), "name") == [("full_name",), ("User",)]
    assert rows(lookup.definitions(facts, "touch"), "path") == [("gems/base.rb",)]
    assert {r["action"] for r in lookup.code_actions(facts, "app/user.rb", 3).collect()} == {"extract_method", "extract_variable", "add_frozen_string_literal"}
    assert rows(lookup.document_symbols(facts, "app/user.rb").orderBy("id"), "name", "container_id")[1] == ("name", 1)
    assert "## Methods" in lookup.class_card(facts, "User").first()["markdown"]
    assert rows(lookup.find_implementations(facts, "total"), "owner", "line") == [("Order", 2), ("Order", 10)]


def test_references(facts):
    assert rows(references.find_references(facts, "name"), "path", "line", "context") == [("app/order.rb", 3, "NAME here"), ("app/user.rb", 6, "name")]
    assert {r["name"] for r in references.find_unused(facts).collect()} == {"total", "total_sum"}
    assert rows(references.incoming_calls(facts, "name"), "path", "caller") == [("app/order.rb", "total"), ("app/user.rb", "full_name")]
    assert rows(references.outgoing_calls(facts, "app/order.rb", "total"), "name", "target_path")[0] == ("name", "app/user.rb")
    lens = {r["name"]: (r["local_refs"], r["other_refs"]) for r in references.code_lens(facts, "app/user.rb").collect()}
    assert lens["name"] == (1, 1) and lens["secret"] == (0, 0)
    hit = references.grep_source(facts, "name", context=1).collect()
    assert [(r["path"], r["line"]) for r in hit] == [("app/order.rb", 3), ("app/user.rb", 2), ("app/user.rb", 3), ("app/user.rb", 5), ("app/user.rb", 6)]
    assert hit[0]["before"] == ["require_relative 'lib/user'"] and hit[0]["after"] == ["  x = 1"]
    assert len(references.grep_source(facts, "^class.*Base$", use_regex=True).collect()) == 1
    assert rows(references.document_links(facts, "app/order.rb"), "line", "target_path") == []
    assert rows(references.highlights(facts, "app/order.rb", "x", 2), "line", "kind") == [(3, "write"), (5, "write"), (5, "read")]


def test_graph_with_cycle_and_missing_ancestor(facts):
    assert rows(graph.ancestors(facts, "Order"), "name", "depth") == [("Deep::Track", 1), ("User", 1), ("Base", 2), ("Track", 2)]
    assert rows(graph.ancestors(facts, "Loop")) == []
    assert rows(graph.concern_usage(facts, "Track"), "name") == [("Order",), ("User",)]
    assert rows(graph.supertypes(facts, "Order")) == [("Base",), ("Deep::Track",), ("User",)]
    assert rows(graph.subtypes(facts, "User"), "name") == [("Order",)]
    dot = {r["name"]: r["owner"] for r in graph.complete_dot(facts, "Order").collect()}
    assert dot["total"] == "Order" and dot["name"] == "User" and dot["save"] == "Base" and dot["touch"] == "Track" and "secret" not in dot
    assert {r["name"] for r in graph.related_classes(facts, "User").collect()} == {"User", "Order"}
    assert ("app/user.rb", 2, 0) in rows(graph.rename_occurrences(facts, "name", "User"))


def test_health(facts):
    assert dict(rows(health.kind_histogram(facts)))["class"] == 4
    h = dict(rows(health.workspace_health(facts)))
    assert h["files"] == 2 and h["typed_variables"] == 5 and h["unused_methods"] == 5
    cover = {r["path"]: (r["total"], r["typed"]) for r in health.type_coverage(facts).collect()}
    assert cover["app/user.rb"] == (3, 1) and cover[None] == (6, 2)
    assert dict(rows(health.suggest_types(facts, "app/order.rb"), "name", "suggested")) == {"total": "untyped", "total_sum": "Integer"}
    assert health.check(facts).collect() == []


def test_lint(facts):
    found = {}
    for r in lint.run_checks(facts).collect():
        found.setdefault(r["code"], set()).add((r["file_id"], r["line"]))
    assert found["unused-variable"] == {(2, 5), (2, 8), (1, 3)}  # y, dead, total_sum
    assert found["unused-parameter"] == {(1, 2), (1, 5)}
    assert found["duplicate-method"] == {(2, 2), (2, 10)}
    assert found["nil-receiver"] == {(2, 6)}
    assert found["wrong-arity"] == {(2, 4)}
    both = facts.replaced(symbols=facts.symbols.withColumn("kind", F.when(F.col("name") == "total", "classdef").otherwise(F.col("kind"))))
    assert lint.duplicate_methods(both).collect() == []  # methods of the class itself aren't looked at
    key = Facts.from_rows(facts.spark, params=[dict(symbol_id=3, position=1, name="b", kind="keyword")])
    assert [r["message"] for r in lint.wrong_arity(facts.replaced(params=facts.params.unionByName(key.params))).collect()] == ["full_name takes 2 arguments, not 3"]
    assert "undefined-method" not in found  # an ancestor, Deep::Track, is outside the index
    assert {r["severity"] for r in lint.run_checks(facts, disabled=lint.disabled_codes("# no\nunused-variable\n"), severity=1).collect()} == {1}
    near = facts.replaced(mixins=facts.mixins.where("module_name = 'Track'"))
    messages = {r["message"] for r in lint.undefined_methods(near).collect()}
    assert messages == set()  # only names that hold the called one are proposed, and without one nothing is said
    more = Facts.from_rows(facts.spark, refs=[dict(file_id=2, name="tota", line=7, col=4), dict(file_id=2, name="tota", line=90, col=4), dict(file_id=2, name="otal_s", line=8, col=1)])
    near = near.replaced(refs=near.refs.unionByName(more.refs))
    assert sorted((r["line"], r["message"]) for r in lint.undefined_methods(near).collect()) == [(7, "undefined method tota, did you mean total?")]


@pytest.mark.parametrize("name", sorted(registry.EDITOR))
def test_editor_operators_analyse(facts, name):
    """Each plan resolves; calls with these arguments run on nothing unknown."""
    import inspect

    given = {"query": "na", "name": "name", "method": "total", "owner": "User", "path": "app/order.rb", "line": 5, "col": 1, "prefix": "", "parent": "User", "receiver": "User | Order", "module": "Track", "scope_id": 2, "first": 1, "last": 9, "qualified": "User#name", "key": "en.user.name", "old": "lib/user.rb", "new": "lib/member.rb"}
    f = registry.EDITOR[name]
    need = [p.name for p in inspect.signature(f).parameters.values() if p.default is p.empty and p.name != "f"]
    f(facts, **{k: given[k] for k in need}).collect()


def test_tokens_round_trip(spark):
    data = [(1, 3, 4, 2, 0, 0), (1, 3, 9, 1, 1, 0), (1, 7, 2, 5, 2, 1), (2, 0, 0, 1, 0, 0)]
    df = spark.createDataFrame(data, "file_id bigint, line int, col int, len int, type int, mods int")
    enc = tokens.encode(df)
    assert [tuple(x) for x in enc.where("file_id = 1").first()["tokens"]] == [(3, 4, 2, 0, 0), (0, 5, 1, 1, 0), (4, 2, 5, 2, 1)]
    assert sorted(rows(tokens.decode(enc))) == sorted(data)
    packed = tokens.packed(enc).where("file_id = 1").first()["tokens"]
    assert tokens.from_bytes(bytes(packed)) == [(3, 4, 2, 0, 0), (0, 5, 1, 1, 0), (4, 2, 5, 2, 1)] and tokens.to_bytes(tokens.from_bytes(bytes(packed))) == bytes(packed)
    a = [(1, 0, 1, 0, 0), (1, 0, 2, 0, 0), (1, 0, 3, 0, 0)]
    b = [(1, 0, 1, 0, 0), (9, 9, 9, 9, 9), (8, 8, 8, 8, 8), (1, 0, 3, 0, 0)]
    two = spark.createDataFrame([(1, b, a), (2, a, a), (3, a, [])], f"file_id bigint, tokens {tokens.TOKEN_TYPE.simpleString()}, prev_tokens {tokens.TOKEN_TYPE.simpleString()}")
    got = {r["file_id"]: (r["start"], r["delete_count"], len(r["insert"])) for r in tokens.splice(two).collect()}
    assert got == {1: (1, 1, 2), 2: (3, 0, 0), 3: (0, 0, 3)}


def test_writes(spark, facts):
    from symdex.facts import Facts

    new = Facts.from_rows(spark, files=[dict(id=1, path="app/user.rb", mtime_ms=9, content_hash=99, is_gem=False)], symbols=[dict(id=50, file_id=1, name="fresh", kind="def", line=1, col=0)])
    after = writes.replace_files(facts, new)
    assert {r["name"] for r in after.symbols.where("file_id = 1").collect()} == {"fresh"}
    assert after.params.count() == 0 and after.files.where("id = 1").first()["mtime_ms"] == 9 and after.files.count() == 3
    scan = spark.createDataFrame([("app/user.rb", 1, 11), ("app/order.rb", 5, 12), ("app/new.rb", 5, 1), ("gems/base.rb", 7, 8)], "path string, mtime_ms bigint, content_hash bigint")
    assert {r["path"] for r in writes.changed_files(facts, scan).collect()} == {"app/new.rb", "gems/base.rb"}
    gone = writes.remove_stale(facts, scan.where("path <> 'app/order.rb'"))
    assert gone.files.count() == 2 and gone.refs.where("file_id = 2").count() == 0
    v = spark.createDataFrame([(1, "a", 1, 1, "X", 50, 1, None, False, 1), (1, "a", 1, 1, "Y", 50, 1, 7, False, 2), (1, "a", 1, 1, "Z", 40, 1, None, False, 3)], "file_id bigint, name string, line int, col int, type_hint string, confidence int, scope_id bigint, class_id bigint, is_block_param boolean, arrival int")
    assert rows(writes.merge_variables(v), "type_hint", "confidence", "class_id") == [("X", 50, 7)]
    refs = facts.refs
    assert writes.insert_or_ignore("refs", refs, refs.unionByName(refs.withColumn("line", refs["line"] + 100))).count() == 2 * refs.count()


def test_refactor_tool_and_prompts(facts):
    text = registry.run(facts, "refactor", path="app/user.rb", start_line=6, end_line=6, kind="extract_method").first()["text"]
    assert "def extracted_method\n" in text
    assert "extracted = " in registry.run(facts, "refactor", path="app/order.rb", start_line=4, end_line=4, kind="extract_variable").first()["text"]
    for name, args in (("class-overview", ["User"]), ("trace-callers", ["name"]), ("find-bugs", ["app/order.rb"])):
        assert all(df.columns for df in registry.PROMPTS[name](facts, *args).values())


def test_pages_say_whether_there_is_more(facts):
    names = [r["name"] for r in registry.run(facts, "find_unused").collect()]
    assert len(names) == 3
    for limit, more in ((2, True), (3, False), (9, False)):
        got = registry.run_page(facts, "find_unused", limit=limit).collect()
        assert [r["name"] for r in got] == names[:limit] and {r["has_more"] for r in got} == {more}
    assert registry.run_page(facts, "find_unused", kind="nothing").collect() == []
    with pytest.raises(TypeError):
        registry.run_page(facts, "class_summary", name="User")
