"""Places without a variable of their own, and pages whose order has ties."""

from symdex.facts import Facts
from symdex.operators import graph, lookup


def var(file, name, line, col, kind, sure):
    return dict(file_id=file, name=name, line=line, col=col, type_hint=kind, confidence=sure, is_block_param=False)


def test_type_chain_is_of_the_line_and_of_all_files_of_the_path(spark):
    files = [dict(id=i, path=f"{d}/user.rb", mtime_ms=1, content_hash=1, is_gem=False) for i, d in enumerate(("app", "lib"), 1)]
    f = Facts.from_rows(spark, files=files, local_vars=[var(1, "x", 3, 2, "Float", 90), var(2, "x", 8, 0, "String", 55), var(2, "y", 3, 9, None, 0), var(2, "z", 4, 2, "Hash", 60)])
    got = lambda line, col: [(r["name"], r["line"], r["type_hint"]) for r in lookup.explain_type_chain(f, "user.rb", line, col).collect()]
    assert got(3, 0) == [("x", 3, "Float"), ("x", 8, "String")]
    assert got(3, 9) == []  # a variable without a type is the nearest
    assert got(5, 2) == []  # no variable on the line


def test_associations_of_equal_order_come_by_id(spark):
    row = lambda i, target: dict(id=i, file_id=1, name="posts", kind="association", line=2, col=0, doc="has_many", parent_name="User", return_type=target)
    rows = [row(i, "ABC"[i % 3]) for i in range(40)]
    for given in (rows, rows[::-1], rows[20:] + rows[:20]):
        f = Facts.from_rows(spark, symbols=given)
        assert [r["target"] for r in lookup.association_graph(f, "User", offset=1, limit=9).collect()] == list("BCABCABCA")


def test_members_of_all_classes_are_found_once_for_those_of_one_lookup_order(spark):
    classes = [dict(id=100 + i, file_id=1, name=f"K{i}", kind="class", line=1, col=0, parent_name="Base", visibility="public") for i in range(30)]
    methods = [dict(id=i, file_id=1, name=n, kind="def", line=i, col=0, parent_name=owner, return_type=f"T{i}", visibility="public") for i, (owner, n) in enumerate([("Base", "a"), ("Base", "a"), ("Base", "b"), ("K7", "b"), ("K7", "b")], 1)]
    df = graph.complete_all_dots(Facts.from_rows(spark, symbols=classes + methods))
    want = {(c, n): "T1" if n == "a" else "T4" if c == "K7" else "T3" for c in ["Base", *(f"K{i}" for i in range(30))] for n in "ab"}
    got = df.collect()
    assert {(r["cls"], r["name"]): r["return_type"] for r in got} == want and len(got) == len(want)
    assert "windowspecdefinition(cls" not in df._jdf.queryExecution().optimizedPlan().toString()  # no sort of classes times definitions
