"""Stored hierarchy and its upkeep, the trigram index, and near names, against plain versions."""

import random

import pytest

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.operators import graph, hierarchy, references, trigrams
from symdex.plans import registry


def reached(edges, most=32):
    out = {}
    for root in {a for a, _ in edges}:
        seen, now = {root: 0}, [root]
        for depth in range(1, most + 1):
            now = [b for a in now for x, b in edges if x == a and b not in seen and not seen.update({b: depth})]
        out |= {(root, b): d for b, d in seen.items() if d}
    return out


def as_rows(spark, edges, depth=None):
    return spark.createDataFrame([("all", a, b) for a, b in edges], "via string, root string, node string")


def test_reach_is_kept_up_to_date(spark):
    r = random.Random(7)
    names = [f"n{i}" for i in range(9)]
    edges = {(a, r.choice(names)) for a in names for _ in range(2)}
    edges = {(a, b) for a, b in edges if a != b}
    before = as_rows(spark, edges)
    known = hierarchy._saturated(before.limit(0).selectExpr("*", "1 AS depth"), before.selectExpr("*", "1 AS depth"), 32)
    assert {(x["root"], x["node"]): x["depth"] for x in known.collect()} == reached(edges)
    gone = set(r.sample(sorted(edges), 4))
    now = (edges - gone) | {("n0", "new"), ("new", "n5")}
    after = hierarchy.updated(known, before, as_rows(spark, now))
    assert {(x["root"], x["node"]): x["depth"] for x in after.collect()} == reached(now)


def test_few_jobs_once_the_hierarchy_is_stored(spark, facts):
    hierarchy.reach(facts)
    tracker, group = spark.sparkContext.statusTracker(), "hierarchy-jobs"
    spark.sparkContext.setJobGroup(group, "count jobs")
    try:
        for ask in ({"operator": "type_hierarchy", "name": "User"}, {"operator": "supertypes", "name": "User"}, {"operator": "completion/dot", "receiver": "User | Order"}, {"operator": "rename", "name": "name", "owner": "User"}):
            operator = ask.pop("operator")
            before = len(tracker.getJobIdsForGroup(group))
            df = registry.run(facts, operator, **ask)
            assert len(tracker.getJobIdsForGroup(group)) == before  # nothing is run before the rows are asked for
            df.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_dots_of_all_classes_and_saved_hierarchy(spark, facts, tmp_path):
    every = {}
    for r in graph.complete_all_dots(facts).collect():
        every.setdefault(r["cls"], set()).add((r["name"], r["owner"], r["rank"]))
    for cls in every:
        one = {(r["name"], r["owner"], r["rank"]) for r in graph.complete_dot(facts, cls, limit=10_000).collect()}
        assert one == every[cls]
    facts.save(str(tmp_path / "f"))
    again = Facts.load(spark, str(tmp_path / "f"))
    assert again.has("reach") and not again.replaced(mixins=again.mixins).has("reach") and not again.has("trigrams")
    assert sorted(map(str, again.reach.collect())) == sorted(map(str, hierarchy.made(facts).collect()))


TEXTS = {1: "def Total(x)\n  x + 1\nend", 2: "total = 5\nsum the TOTALS", 3: "tot al\né total é", 4: "", 5: "aab b\nab"}


@pytest.fixture(scope="module")
def source(spark):
    files = [dict(id=i, path=f"f{i}.rb", is_gem=False) for i in TEXTS]
    lines = [dict(file_id=i, n=n, text=t) for i, text in TEXTS.items() for n, t in enumerate(text.split("\n"), 1)]
    return Facts.from_rows(spark, files=files, lines=lines)


@pytest.mark.parametrize(("query", "regex"), [("TOTAL", False), ("to", False), ("é t", False), ("zzz", False), ("to.al", True), ("tot.*s", True), ("a+b", True), ("^def", True), ("xa*b b", True)])
def test_search_by_index_is_the_scan(source, query, regex):
    by_scan, by_index = (list(map(str, references.grep_source(source, query, use_regex=regex, indexed=x).collect())) for x in (False, True))
    assert by_scan == by_index


def test_what_a_pattern_needs():
    assert trigrams.runs_of("ab+cd*e.f") == ["ab", "bc", "e", "f"] and trigrams.runs_of("^abc$") == ["abc"] and trigrams.runs_of(".*") == []
    assert trigrams.needed("ToT") == {"tot"} and trigrams.needed("to") == set() and trigrams.needed("abcd+e", True) == {"abc", "bcd"}


def test_file_limit_says_whether_it_cut(source):
    one = references.grep_source(source, "total", file_limit=1).collect()
    assert [(r["path"], r["file_limit_hit"]) for r in one] == [("f1.rb", True)]
    assert {r["file_limit_hit"] for r in references.grep_source(source, "total", file_limit=5).collect()} == {False}
    assert "file_limit_hit" not in references.grep_source(source, "total").columns


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_names_in_bytes(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcé", k=r.randint(1, 6))) for _ in range(60)] + ["é", "e", "x" * 65, "x" * 64, ""]
    others = ["".join(r.choices("abcé", k=r.randint(1, 6))) for _ in range(60)] + ["e", "x" * 63]
    a, b = (spark.createDataFrame([(w,) for w in x], f"{n} string") for x, n in ((words, "word"), (others, "other")))
    got = {(x["word"], x["other"], x["d"]) for x in R.near_texts(a, b).collect()}
    assert got == {(w, o, d) for w in set(words) for o in set(others) if max(len(w.encode()), len(o.encode())) <= 64 and 1 <= (d := distance(w.encode(), o.encode())) <= 2}
    assert a.where("word = 'é'").select(R.edit_distance(a["word"], a["word"]).alias("d")).first()["d"] == 0
    assert spark.range(1).selectExpr("'é' AS x", "'e' AS y").select(R.edit_distance(*map(__import__("pyspark").sql.functions.col, "xy")).alias("d")).first()["d"] == 2
