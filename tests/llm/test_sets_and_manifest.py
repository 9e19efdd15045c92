"""Operators 11 to 13 against plain versions, on odd rows, repeated rows, families and empty tables."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from symdex.llm import manifest as M
from symdex.llm import set_join as J
from symdex.llm import source_divergence as D
from symdex.llm.shared import Workspace
from tests.llm.test_near_duplicates import plain as plain_components

LOWER = {c: c + 32 for c in range(65, 91)}


def hexed(x):
    return sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    """Sorted result rows of (doc_id, text, lang, source, n_chars), each level made in full."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(doc_id, text, lang, source, n_chars):
        return hexed("".join(map(field, (doc_id, source, lang, n_chars, text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([hexed("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            run = i - i % 3
            yield nodes[run:i], nodes[i + 1 : run + 3]
            i //= 3

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order}
    over = levels([trees[s][-1][0] for s in order])
    root, out = over[-1][0], []
    for at, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(over, at)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if bad else own
            for before, after in steps:
                now = hexed("".join([*before, now, *after]))
            proof = hexed("".join(x for before, after in steps for x in [*before, *after]))
            out.append((str(r[0]), own, trees[s][-1][0], root, proof, now, now == root))
    return sorted(out)


def made_manifest(spark, df):
    got = M.manifest(spark, df, tampered=M.even_crc())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r)[:5] for r in odd_docs.collect()]
    assert made_manifest(spark, odd_docs) == plain_manifest(rows)
    assert made_manifest(spark, no_docs) == []


@pytest.mark.parametrize("sizes", [(1,), (1, 3), (2, 1, 9), (10, 27, 28), (730, 5)])
def test_manifest_of_sources_of_many_sizes(spark, sizes):
    rows = [(1000 * s + i, f"t{i}\n{s}" * (i % 3), "en", None if s == 1 else f"sé{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert made_manifest(spark, df) == plain_manifest(rows)


def test_paths_of_a_tree_of_several_tiers(spark):
    rows = [(i, f"t{i}", "en", "a", i) for i in range(200)]
    leaves = [hexed(str(i)) for i in range(200)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(leaves)], "g string, id bigint, digest string")
    tree = M.Tree(Workspace(spark, "tiers"), df, ["id"], height=1, stacked=2)
    assert len(tree.tiers) == 4  # 200 leaves in blocks of 9: 23, 3 and 1
    root = tree.tiers[-1].first()["digest"]
    assert root == M.root_of(leaves, 5)
    got = tree.proved(tree.tiers[-1].select("g", F.lit("").alias("path"))).collect()
    assert len(got) == len(rows) and all(M.fold(leaves[r["idx"]], r["path"]) == root for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 26, 27, 28, 81, 200])
def test_fractal_traversal_holds_few_nodes_and_gives_every_path(n):
    leaves, levels = [hexed(str(i)) for i in range(n)], 5
    root = M.root_of(leaves, levels)
    for height in (1, 2, 3):
        got = list(M.paths(leaves, levels, height))
        assert len(got) == n and all(M.fold(x, p) == root and p.count(M.END) == levels for x, p in zip(leaves, got, strict=True))


def plain_divergence(rows, min_docs=3, top=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for g, s, words in docs:
        groups[g].add(s)
        in_docs[g].update(set(words))
        counts[g, s].update(words)
    out = set()
    for g, sources in groups.items():
        kept = [t for t, n in in_docs[g].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total.update({t: counts[g, s][t] for t in kept})

        def p(c, kept=kept):
            size = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // size for t in kept}

        of = {s: p(counts[g, s]) for s in sources}
        q = p(total)
        for s in sources:
            pairs = sorted((-sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-((of[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[g, s][t] and of[s][t] > q[t])
            out |= {(g, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)} | {(g, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms[:top], 1)}
    return out


@pytest.mark.parametrize("held", [3, 1 << 18])
def test_divergence_by_term(spark, odd_docs, no_docs, prose, held, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", held)
    monkeypatch.setattr(D, "PIECE", 50)
    extra = [(100 + i, prose(30 + i, i) + " Été-x" * (i % 4), ("en", "de")[i % 2], f"s{i % 3}" if i % 5 else None, i, "k", "s", 1) for i in range(40)]
    extra += [(300 + i, "#", "xx", f"s{i}", 1, "k", "s", 1) for i in range(3)]  # a language without terms
    df = odd_docs.unionByName(spark.createDataFrame(extra, odd_docs.schema)).repartition(3)
    got = D.divergence(spark, df, top=7).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_divergence([tuple(r) for r in df.collect()], top=7)
    assert D.divergence(spark, no_docs).collect() == []


def test_counts_in_full_pieces():
    text = "ab, cd\x00EF  é" * 50
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    for size in (1, 3, 7, 1000):
        assert [w.decode() for part in D.pieces(text.encode(), size) for w in part] == want


def test_joint_histograms_have_implied_zeros(spark):
    lists = spark.createDataFrame([("en", [("a", 2), ("b", 1)], 3), ("en", [("a", 2)], 4), ("en", [("c", 5)], 2)], "lang string, by_source array<struct<source:string,n:bigint>>, m bigint")
    groups = spark.createDataFrame([("en", x, 1, 20) for x in "abcd"], "lang string, source string, n bigint, v bigint")
    got = {(r["a"], r["b"], r["ca"], r["cb"]): r["m"] for r in D.joint_histograms(lists, groups).collect()}
    assert got[("a", "b", 2, 1)] == 3 and got[("a", "b", 2, 0)] == 4 and got[("a", "b", 0, 0)] == 13 and ("a", "b", 0, 1) not in got
    assert got[("a", "d", 2, 0)] == 7 and got[("c", "d", 5, 0)] == 2
    for pair in {k[:2] for k in got}:
        assert sum(m for k, m in got.items() if k[:2] == pair) == 20


def mutated(words, share, r):
    return " ".join(w if r.random() > share else f"m{r.randrange(10**6)}" for w in words)


def families(seed, n_families, copies, length, share):
    r = random.Random(seed)
    docs = []
    for f in range(n_families):
        base = [f"w{r.randrange(300)}" for _ in range(length)]
        docs += [mutated(base, share * r.random(), r) for _ in range(copies)]
    r.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize(("block", "copies"), [(1 << 20, 5), (2000, 30), (400, 25)])
def test_join_against_all_pairs(spark, block, copies):
    docs = families(block + copies, 4, copies, 60, 0.04) + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three")]
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(spark, df, shingle=4, threshold=85, block=block).collect()}
    assert got == plain_components(docs, 4, 85)
    assert len({c for _, c in got.values()}) < len(docs) - 10


def test_join_of_a_chain_of_passages(spark):
    """Texts that share a frequent passage, in a family wider than a block, searched bucket by bucket or as one."""
    r = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    docs = [(i, " ".join([*passage, *(f"u{r.randrange(10**6)}" for _ in range(3 + i % 3))])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.jaccard_join(spark, df, shingle=4, threshold=85, block=300).collect()}
    assert got == plain_components(docs, 4, 85)


def test_join_of_odd_rows(spark, odd_docs, no_docs, prose):
    more = spark.createDataFrame([(7, prose(50, 9), "en", "a", 1, "k", "s", 1), (20, prose(50, 9), "en", "a", 1, "k", "s", 1)], odd_docs.schema)
    got = {(r[0], r[1], r[2]) for r in J.jaccard_join(spark, odd_docs.unionByName(more)).collect()}
    assert {(1, 76, 1), (7, 76, 1), (7, 46, 1), (20, 46, 1), (2, 0, 2), (3, 0, 3), (5, 0, 5), (6, 1, 6), (None, 56, None)} <= got
    assert J.jaccard_join(spark, no_docs).collect() == []
    with pytest.raises(TypeError):
        J.jaccard_join(spark, odd_docs.withColumn("doc_id", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("seed", range(6))
def test_block_search_joins_what_all_pairs_join(seed):
    r = np.random.default_rng(seed)
    base = [r.integers(0, 400, 60) for _ in range(5)]
    rows = [np.unique(np.concatenate([b[r.random(60) > 0.05 * r.random()], r.integers(400, 10_000, r.integers(0, 4))])) for b in base for _ in range(40)]
    rows = [r.permutation(x) if False else x for x in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    sets = J.Sets(np.concatenate([x[::-1] for x in rows]).astype(np.int64), offsets)  # from high to low: rare ones first
    n = len(rows)
    for asked, held in ((np.arange(n), np.arange(n)), (np.arange(0, n, 2), np.arange(1, n, 2))):
        want = J.Forest(np.arange(n))
        for a in asked:
            for b in held:
                same = len(np.intersect1d(rows[a], rows[b]))
                if a != b and 185 * same >= 85 * (len(rows[a]) + len(rows[b])):
                    x, y = want.root(a), want.root(b)
                    want.join(x, y)
        got = J.Forest(np.arange(n))
        found = J.search(sets, np.arange(n), asked, held, 85)
        for a, b in found:
            got.join(got.root(a), got.root(b))
        assert (got.roots(np.arange(n)) == want.roots(np.arange(n))).all()
        assert len(found) < n


def test_followers_and_skips_are_used():
    r = np.random.default_rng(1)
    base = np.arange(200)
    rows = [np.delete(base, r.integers(10, 200, 2)) for _ in range(30)]
    sets = J.Sets(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(x) for x in rows]))))
    groups = list(J.led(sets, np.arange(30)))
    assert sum(len(g) for g, _ in groups) == 30 and len(groups) < 15 and all(0 < s <= 4 for g, s in groups if len(g) > 1)
    small = J.Sets(np.concatenate([base, base[:20]]), np.array([0, 200, 220]))
    lists = J.Lists(small, np.arange(2))
    assert lists.candidates(base, 0, 85).tolist() == [0]  # 20 of 200 are too few, whatever they share


def test_bitmaps_bound_the_difference():
    a, b = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 500).astype(np.uint64)), None
    b = np.sort(np.concatenate([a[:450], np.arange(70, dtype=np.uint64)]))
    bits = J.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    differ = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
    assert 60 < differ <= len(np.setxor1d(a, b))


def test_join_moves_no_text_and_frees_what_it_used(spark, monkeypatch):
    docs = families(7, 60, 5, 120, 0.04) + [(900, None), (901, "one two")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    plans, spaces, made, space = [], [], J._ordered_sets, J.Workspace
    monkeypatch.setattr(J, "_ordered_sets", lambda texts, *rest: plans.append(texts._jdf.queryExecution().executedPlan().toString()) or made(texts, *rest))
    monkeypatch.setattr(J, "Workspace", lambda *a, **k: spaces.append(space(*a, **k)) or spaces[-1])
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = [x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x]
        return {x: os.path.getsize(x) for x in files if os.path.exists(x)}

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.jaccard_join(spark, df, shingle=4, threshold=85)
        kept = sum(n for x, n in shuffled().items() if x not in before)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == plain_components(docs, 4, 85)
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    assert kept < 50_000
    tables = os.listdir(spaces[0].root.removeprefix("file:").replace("//", "/"))
    assert not any(t.endswith(("profiles", "classes", "members", "sets")) for t in tables)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_ids_are_all_picked_through_a_full_bitmap(spark, monkeypatch):
    docs = spark.range(3000).select("id", F.lit("a").alias("text"))
    ids = docs.where("id % 3 = 0").select("id")
    for bits in (6, 10, 26):
        monkeypatch.setattr(J, "FILTER_BITS", bits)
        got = [r["id"] for r in J.picked(docs, ids, Workspace(spark, "picked")).collect()]
        assert len(got) == len(set(got)) and set(range(0, 3000, 3)) <= set(got) and (bits < 26 or len(got) < 1100)


@pytest.mark.parametrize("most", [0, 1, 255, 256, 70_000, 1 << 33])
def test_packed_counts(most):
    counts = np.arange(64, dtype=np.uint64)
    counts[5] = most
    counts = np.minimum(counts, most).astype(np.uint64)
    assert (J.unpacked(J.packed(counts), 64) == counts).all()


def test_partners_are_what_the_filters_leave_of_another_component():
    r = np.random.default_rng(4)
    base = [r.integers(0, 1 << 62, 100).astype(np.uint64) for _ in range(30)]
    rows = [np.unique(np.concatenate([b[i:], r.integers(0, 1 << 62, i).astype(np.uint64)])) for b in base for i in (0, 3)] + [r.integers(0, 1 << 62, 100).astype(np.uint64) for _ in range(100)]
    n = np.array([len(x) for x in rows])
    bits = J.bitmaps(np.concatenate(rows), np.concatenate(([0], np.cumsum(n)))).reshape(len(rows), -1).view(np.uint64)
    every, apart = np.arange(len(rows)), np.arange(len(rows))
    assert J.partners(n, np.zeros(len(rows), np.int64), apart, bits, every, every, 85).tolist() == list(range(60))  # sets with a near one
    assert J.partners(n, np.zeros(len(rows), np.int64), apart // 2, bits, every, every, 85).tolist() == []  # joined already
    assert J.partners(n, np.full(len(rows), 60), apart, bits, every, every, 85).tolist() == []  # places rule them out


def test_folded_bitmaps_bound_the_difference():
    r = np.random.default_rng(5)
    a = np.sort(r.integers(0, 1 << 62, 5000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:4600], np.arange(100, dtype=np.uint64)]))
    words = np.array([128, 64])
    bits = J.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), words).view(np.uint64)
    x, y = J.folded(bits, np.array([0, 128]), words)
    assert len(x) == 64 and (x == J.bitmaps(a, np.array([0, len(a)]), 64)[0].view(np.uint64)).all()
    assert 400 < np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert J.long_words(np.array([2048, 2049, 5000]), 85, 2048).tolist() == [0, 64, 128]


@pytest.mark.parametrize("sides", [1, 2])
def test_cells_join_what_the_filters_leave(sides):
    r = np.random.default_rng(6)
    base = [r.integers(0, 1 << 62, 100).astype(np.uint64) for _ in range(20)]
    rows = [np.unique(np.concatenate([b[i:], r.integers(0, 1 << 62, r.integers(0, 6)).astype(np.uint64)])) for b in base for i in range(0, 24, 3)]
    rows.sort(key=len)
    n = np.array([len(x) for x in rows])
    bits = J.bitmaps(np.concatenate(rows), np.concatenate(([0], np.cumsum(n)))).view(np.uint64)
    pos, side = r.integers(0, 15, len(rows)), np.arange(len(rows)) % sides
    want, got = J.Forest(np.arange(len(rows))), J.Forest(np.arange(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            total, differ = n[i] + n[j], int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            fits = 100 * n[j] >= 85 * n[i] and 185 * min(n[i] - pos[i], n[j] - pos[j]) >= 85 * total and 185 * (total - differ) >= 170 * total
            if fits and (sides == 1 or side[i] != side[j]):
                want.join(want.root(i), want.root(j))
    a, b = J.spanned(n, pos, bits, side, 85)
    for x, y in zip(a, b, strict=True):
        got.join(got.root(x), got.root(y))
    assert (got.roots(np.arange(len(rows))) == want.roots(np.arange(len(rows)))).all() and 20 < len(a) < len(rows)


def test_a_frequent_passage_makes_no_family(spark):
    """Unlike texts that share a passage, or are so long that their prefixes meet, are no candidates of each other."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(8)]
    docs = [(i, " ".join([*(f"u{r.randrange(10**6)}" for _ in range(4)), *passage])) for i in range(30)]
    docs += [(100 + i, " ".join([*passage, *(f"v{r.randrange(3)}" for _ in range(5000 + 10 * i))])) for i in range(12)]
    docs += [(200 + i, " ".join([*passage, *(f"w{r.randrange(10**6)}" for _ in range(3000 + 20 * i))])) for i in range(12)]
    docs += [(300, docs[-1][1] + " and some more words"), (301, docs[0][1] + " so")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    work = Workspace(spark, "families")
    texts = df.select(F.col("doc_id").alias("id"), "text")
    levels = spark.sparkContext.broadcast(J.rarity(texts, work, 4))
    classes = work.write(J.profiles(texts, levels, 4, 85).withColumnRenamed("id", "node"), "classes")
    edges, large, _ = J.candidates(classes, work, 85)
    families = {x for e in edges.collect() for x in e}
    assert {219 - 8, 300} <= families and not families & set(range(200, 211)) and large.where("NOT wide").count() > 0
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.jaccard_join(spark, df, shingle=4, threshold=85).collect()}
    assert got == plain_components(docs, 4, 85)


@pytest.mark.parametrize(("long", "cell", "block"), [(20, 4096, 1 << 20), (20, 16, 400), (2048, 16, 2000), (55, 16, 400)])
def test_join_of_long_sets_in_small_cells(spark, long, cell, block, monkeypatch):
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "CELLS_BYTES", 1 << 12)
    docs = families(long + cell, 5, 24, 60, 0.05)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(spark, df, shingle=4, threshold=85, block=block).collect()}
    assert got == plain_components(docs, 4, 85)
