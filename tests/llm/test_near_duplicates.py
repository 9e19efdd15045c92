"""Near duplicates against all pairs of sets, and the pieces of the method by themselves."""

import random
import re

import numpy as np
import pytest

from symdex.llm import near_duplicates as N
from symdex.llm.shared import Workspace
from symdex.llm.wordhash import mix


def plain(docs, shingle=4, threshold=80):
    """doc -> (set size, component) by comparing all pairs."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()})
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


def test_superminhash_as_defined():
    values = mix(np.arange(1, 60, dtype=np.uint64))
    slots = 24
    want = [None] * slots
    for e in values.tolist():
        p = list(range(slots))
        for j in range(slots):
            r = int(mix(np.array([(e + (j + 1) * N._GOLDEN) & (1 << 64) - 1], np.uint64))[0])
            k = j + (((r & 0xFFFFFFFF) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            v = (j << 32) | (r >> 32)
            want[p[j]] = v if want[p[j]] is None else min(v, want[p[j]])
    got = N.superminhash(np.concatenate([values, values[:2]]), np.array([0, 59, 59, 61]), slots, chunk=30)
    assert got[0].tolist() == want and (got[1] == np.iinfo(np.uint64).max).all() and (got[2] != np.iinfo(np.uint64).max).all()


def test_families_near_the_threshold(spark, prose):
    """Copies of one text with some words changed: links form by chance, chains and lone copies among them."""
    r = random.Random(8)
    docs = []
    for family in range(3):
        base = prose(90, 1000 + family).split()
        for k in range(45):
            w = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 4, 5))):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            docs.append((len(docs) * 3 + 5, " ".join(w)))
    docs += [(1, "one two"), (2, "One  TWO"), (3, ""), (4, None), (7, " \n"), (10, "one two three"), (13, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(spark, df).collect()}
    want = plain(docs)
    assert got == want
    assert len({c for _, c in want.values()}) > 8


def test_repeated_ids_are_one_node(spark, prose):
    a, b, c, d = (prose(60, 500 + i) for i in range(4))
    near = b.split()
    near[30] = "changed"
    docs = [(5, a), (5, b), (1, a), (3, " ".join(near)), (5, a), (8, c), (8, d), (9, d), (9, d), (7, c), (5, ""), (12, prose(60, 600))]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    out = N.near_duplicates(spark, df)
    assert dict(out.dtypes)["doc_id"] == dict(out.dtypes)["component_id"] == "int"
    got = sorted(tuple(x) for x in out.select("doc_id", "component_id", "n_shingles", "kept").collect())
    one = {1: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7, 12: 12}
    assert got == sorted((i, one[i] if t else i, 57 if t else 0, one[i] == i or not t) for i, t in docs)
    with pytest.raises(TypeError):
        N.near_duplicates(spark, df.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"))


@pytest.mark.parametrize("block, nodes", [(300, 1 << 20), (3000, 4)])
def test_blocks_give_the_same(spark, prose, monkeypatch, block, nodes):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(N, "FOREST_NODES", nodes)
    r = random.Random(9)
    base = prose(80, 5).split()
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice((1, 3, 4, 5))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == plain(docs)


def test_wide_families_are_searched_by_bucket(spark, prose, monkeypatch):
    """A chain of texts that overlap with the next by less than the threshold, and some by more."""
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 300)
    words, r, docs, at, blocks = prose(1500, 77).split(), random.Random(3), [], 0, []
    for i in range(90):
        docs.append((i, " ".join(words[at : at + 80])))
        at += r.choice((8, 9, 10, 11))
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: (out := write(self, df, name), blocks.append(out) if name == "blocks" else None)[0])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    want = plain(docs)
    assert got == want and len({c for _, c in want.values()}) > 20
    assert blocks[0].where("k IS NOT NULL").count() > 20


def test_odd_rows(spark, odd_docs, no_docs):
    got = N.near_duplicates(spark, odd_docs).collect()
    assert len(got) == 10
    rows = {x["doc_id"]: x for x in got}
    assert rows[7]["component_id"] == 1 and not rows[7]["kept"] and rows[1]["kept"] and rows[2]["kept"] and rows[2]["n_shingles"] == 0
    assert rows[None]["component_id"] is None and not rows[None]["kept"]
    assert N.near_duplicates(spark, no_docs).collect() == []


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(900, x) for x in range(901, 990)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {x["id"]: x["component"] for x in N.components(df, Workspace(spark, "t")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert N.components(df.limit(0), Workspace(spark, "t")).collect() == []
