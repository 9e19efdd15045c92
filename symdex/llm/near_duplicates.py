"""Operator 9: near duplicates by SuperMinHash, banding, verification on full sets and union-find grouping.

1. Each whole text's set of distinct word shingles is hashed; SuperMinHash (Ertl 2017) gives `bands * rows` slots.
   An element deals its j-th rank j + u(j) to the j-th slot of its own random permutation; a slot keeps its least
   value. Values of level j lie in [j, j + 1), so all elements of a text go level by level, and a text stops as
   soon as each of its slots is filled: later levels can't change any.
2. Texts with equal sets are one class from here on, named by the smallest doc_id. A class has one row of band keys.
3. Classes that share a band key are members of its bucket. Each class is first verified against its smallest
   bucket mate, which already joins most groups of copies: one pair a class. Buckets that then still hold several
   components are searched: every class outside the bucket's largest component, on full sets, against all members of
   other components, through an inverted index of their shingles. Buckets that share classes make a family
   (a component of the candidate graph), which is searched as one, so that a pair of classes meets once, if it fits
   one block or if that is less work than its buckets one by one; a wide family that only chains of shared passages
   hold together is searched bucket by bucket, so its work grows with its buckets, not with the square of the family.
   Members and searched classes are dealt to blocks of a bounded number of shingles, and a search returns one link to
   each component it meets, never a row a pair. Pairs inside one component need no test, all other candidate pairs
   get one, so no link between components is lost.
4. Links become components by alternating large-star and small-star contraction after a union-find within partitions.

A pair at the threshold of 0.8 shares one of 45 bands of 6 rows with probability 1 - 1.2e-6, above it more.
Key counts and pivots are combined before they are shuffled, joins on keys are plain joins that skew handling can
split. Intermediate tables are written to the shared folder.

Null or empty text, or text without words, has an empty set and is linked with nothing, also where other rows of its
doc_id have words. Fewer words than a shingle make one shingle of them all. Equal texts are linked. Rows that repeat a
doc_id are one node: all their sets are linked through it. A null doc_id keeps a null component and is not kept. Ties
go to the smallest doc_id. An empty table gives no rows. Further columns are not looked at. The key is of an integer
type and keeps it; keys of other types are refused.

Shingles are compared by 64-bit hashes: two different ones of a pair of texts with a million shingles each agree by
chance with a probability below 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symdex.llm.shared import Workspace, bytes_of, map_texts, table
from symdex.llm.wordhash import BY_SPACE, U, mix, runs

BANDS, ROWS = 45, 6
#: Shingles to a block of a search, which bounds what one task holds.
BLOCK_SHINGLES = 1 << 20
#: Nodes that a task joins before it gives its forest out and starts a new one.
FOREST_NODES = 1 << 20
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_sets(raws: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first of each text and one more)."""
    h, first, _, _, _ = BY_SPACE.hashes(raws)
    n = np.diff(first)
    text = np.repeat(np.arange(len(raws)), np.where(n >= shingle, n - shingle + 1, 0))
    start = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(n - shingle + 1, 0)) - np.maximum(n - shingle + 1, 0), np.maximum(n - shingle + 1, 0)) + first[:-1][text]
    values = runs(h, shingle)[start] if len(start) else np.empty(0, U)
    few = np.flatnonzero((n > 0) & (n < shingle))
    if len(few):
        values = np.concatenate([values, np.array([runs(h[first[i] : first[i + 1]], int(n[i]))[0] for i in few], U)])
        text = np.concatenate([text, few])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(len(raws) + 1))


def superminhash(values: np.ndarray, first: np.ndarray, slots: int, chunk: int = 1 << 15) -> np.ndarray:
    """One row of `slots` values a text; a text without elements keeps the largest value throughout."""
    n_texts = len(first) - 1
    out = np.full((n_texts, slots), np.iinfo(np.uint64).max, U)
    i = 0
    while i < n_texts:
        j = max(i + 1, int(np.searchsorted(first, first[i] + chunk, side="right")) - 1)
        _levels(values[first[i] : first[j]], np.repeat(np.arange(j - i), np.diff(first[i : j + 1])), out[i:j])
        i = j
    return out


def _levels(values: np.ndarray, text: np.ndarray, out: np.ndarray) -> None:
    slots = out.shape[1]
    flat = out.reshape(-1)
    order = None
    for j in range(slots):
        if not len(values):
            return
        r = mix(values + U((j + 1) * _GOLDEN & (1 << 64) - 1))
        k = j + ((r & U(0xFFFFFFFF)) * U(slots - j) >> U(32)).astype(np.int64)
        if j == 0:
            place, first_k = k, k
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
                order[np.arange(len(values)), first_k] = 0
                order[:, 0] = first_k
            rows = np.arange(len(values))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, text * slots + place, (U(j) << U(32)) | (r >> U(32)))
        done = out.max(1) != np.iinfo(np.uint64).max
        stay = ~done[text]
        if not stay.all():
            values, text = values[stay], text[stay]
            if j == 0:
                first_k = first_k[stay]
            elif order is not None:
                order = order[stay]


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.zeros((len(signatures), bands), U)
    for r in range(rows):
        key = mix(key * U(_GOLDEN) + parts[:, :, r] + U(r + 1))
    return mix(key + np.arange(1, bands + 1, dtype=U) * U(0xD6E8FEB86659FD93))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_sums(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed shingles, which together with the size name a set."""
    sums = [np.concatenate(([U(0)], np.cumsum(mix(values ^ U(salt)), dtype=U))) for salt in (0x8CB92BA72F3D8DD7, 0x1B873593CC9E2D51)]
    return [s[first[1:]] - s[first[:-1]] for s in sums]


def signatures(docs: DataFrame, key: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, h1, h2, bands): two sums name the set; bands is null for an empty set."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, first = shingle_sets(bytes_of(batch, "text"), shingle)
            n = np.diff(first)
            keys = band_keys(superminhash(values, first, bands * rows), bands, rows)
            some = np.flatnonzero(n)
            offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(keys[some].reshape(-1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *map(_signed, _set_sums(values, first)), lists], ["id", "n_shingles", "h1", "h2", "bands"])

        return each

    return map_texts(docs.select(docs[key].cast("bigint").alias("id"), docs[text].alias("text")), "text", make, "id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, h1, h2, shingles) of (id, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values, first = shingle_sets(bytes_of(batch, "text"), shingle)
            return pa.RecordBatch.from_arrays([batch.column(0), *map(_signed, _set_sums(values, first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _signed(values))], ["id", "h1", "h2", "shingles"])

        return each

    return map_texts(docs, "text", make, "id bigint, h1 bigint, h2 bigint, shingles array<bigint>")


def _local_forests(edges: DataFrame) -> DataFrame:
    """Union-find over up to FOREST_NODES nodes of a partition at a time: at most one edge a node, to the smallest node of its tree."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def grown():
            rows = [(x, root(x)) for x in parent]
            rows = [x for x in rows if x[0] != x[1]]
            parent.clear()
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([y for _, y in part], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) >= FOREST_NODES:
                yield from grown()
        yield from grown()

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, work: Workspace, limit: int = 50) -> DataFrame:
    """(id, component) of every node of (a, b) edges: stars whose centre is the smallest id of the component.

    What is aggregated by a key is written before it is joined, so that the join has plain exchanges on both sides and
    skew handling can split the rows of a hub.
    """
    e = work.write(_local_forests(edges.select("a", "b").where("a <> b")), "forest")
    for _ in range(limit):
        if _are_stars(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.write(large.where("a <> b"), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        work.drop(least)
        least = work.write(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = work.write(small, "small")
        for done in (large, least, e):
            work.drop(done)
        e = small
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _are_stars(e: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node and no node that others point to has any."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold in hundredths."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    same = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", same.alias("same"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(100 * F.col("same") >= threshold * (F.col("total") - F.col("same"))).select("a", "b").distinct()


def links(docs: DataFrame, classes: DataFrame, repeated: DataFrame | None, work: Workspace, key: str, text: str, shingle: int, threshold: int) -> DataFrame:
    """Links (a, b) between classes (id, n_shingles, h1, h2, bands) that connect every component.

    `docs` has the texts; `repeated` has the ids that occur in several rows, if there are any.
    """
    shared = classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("k"))
    buckets = shared.groupBy("k").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = work.write(buckets.select("k", "pivot"), "buckets")
    members = work.write(shared.join(buckets, "k").select("k", "id", "n", "pivot"), "members")
    # stored first, so that its size is known: a small one is sent to the texts, and only a large one moves them
    ids = work.write(members.select("id").distinct(), "ids")
    texts = docs.select(docs[key].cast("bigint").alias("id"), docs[text].alias("text"))
    sets = _sets(texts.join(ids, "id", "left_semi"), shingle)
    if repeated is not None:  # a class has one row's set: the one that it is named by
        own = classes.select("id", "h1", "h2").join(repeated, "id", "left_semi")
        own = sets.join(own, ["id", "h1", "h2"], "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))
        sets = sets.join(repeated, "id", "left_anti").select("id", "shingles").unionByName(own)
    sets = work.write(sets.select("id", "shingles"), "sets")

    size_ok = 100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    sizes = members.groupBy("id", "n").agg(F.min("pivot").alias("pivot"))
    first = sizes.where("pivot < id").select("id", "n", "pivot").join(sizes.select(F.col("id").alias("pivot"), F.col("n").alias("np")), "pivot")
    first = first.select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb")).where(size_ok).select("a", "b").distinct()
    tested = work.write(first, "pairs")
    found = work.write(_verified(tested, sets, threshold), "links")
    parts = work.write(components(found, work), "parts")
    known = members.join(parts, "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = known.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("k")
    mixed = work.write(mixed, "mixed")
    open_members = work.write(members.join(mixed, "k", "left_semi").select("k", "id", "n", "pivot"), "open")
    families = components(open_members.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), work)
    families = families.unionByName(families.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("component", "family")
    rows = families.join(parts, "id", "left").select("family", "id", F.coalesce("component", "id").alias("c"))
    rows = work.write(open_members.join(rows, "id").select("family", "k", "id", "c", "n"), "families")
    one_each = rows.select("family", F.lit(None).cast("bigint").alias("k"), "id", "c", "n").distinct()
    both = _blocks(one_each, "family").unionByName(_blocks(rows, "family", "k"))
    both = both.withColumn("work", F.col("s") * F.col("asked")).withColumn("whole", F.col("k").isNull())
    ways = both.groupBy("family").agg(F.sum(F.when(F.col("whole"), F.col("work"))).alias("as_one"), F.max(F.when(F.col("whole"), F.col("mb") * F.col("rb"))).alias("pieces"), F.sum(F.when(~F.col("whole"), F.col("work"))).alias("apart"))
    ways = ways.select("family", ((F.col("pieces") <= 1) | (F.col("as_one") <= F.col("apart"))).alias("as_one"))
    chosen = both.join(ways, "family").where(F.col("whole") == F.col("as_one")).where("rb > 0")
    chosen = work.write(chosen.select("family", "k", "top", "mb", "rb"), "blocks")
    wide = rows.join(chosen.where("k IS NOT NULL"), ["family", "k"]).select("family", "k", "id", "c", "top", "mb", "rb")
    whole = one_each.drop("k").join(chosen.where("k IS NULL"), "family").select("family", "k", "id", "c", "top", "mb", "rb")
    dealt = wide.unionByName(whole).join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    held = dealt.select("family", "k", (own % F.col("mb")).cast("int").alias("x"), each("rb").alias("y"), F.lit(False).alias("q"), "id", "c", "shingles")
    asked = dealt.where("c <> top").select("family", "k", each("mb").alias("x"), (own % F.col("rb")).cast("int").alias("y"), F.lit(True).alias("q"), "id", "c", "shingles")
    more = held.unionByName(asked).groupBy("family", "k", "x", "y").applyInArrow(_searcher(threshold), "a bigint, b bigint")
    return found.unionByName(work.write(more, "links"))


def _blocks(rows: DataFrame, *by: str) -> DataFrame:
    """(family, k, top component, shingles held and asked, blocks of both) of what is searched as one; `rows` are (family, k, id, c, n)."""
    sizes = rows.groupBy(*by, "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").cast("double").alias("s"))
    out = sizes.groupBy(*by).agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("top"), F.max_by("s", F.struct("m", -F.col("c"))).alias("ts"), F.sum("s").alias("s"))
    asked = F.col("s") - F.col("ts")
    k = F.col("k") if "k" in by else F.lit(None).cast("bigint")
    return out.select("family", k.alias("k"), "top", "s", asked.alias("asked"), F.ceil(F.col("s") / BLOCK_SHINGLES).alias("mb"), F.ceil(asked / BLOCK_SHINGLES).alias("rb"))


def _searcher(threshold: int):
    """Of one block: for each asked class one held class of each other component that reaches the threshold."""

    def search(block: pa.Table) -> pa.Table:
        asked = np.asarray(block.column("q").to_pylist(), bool)
        ids, comps = block.column("id").to_numpy(), block.column("c").to_numpy()
        lists = block.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = np.diff(offsets)
        held = np.flatnonzero(~asked)
        row = np.repeat(np.arange(len(held)), size[held])
        mine = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in held]) if len(held) else np.empty(0, np.int64)
        order = np.argsort(mine, kind="stable")
        mine, row = mine[order], row[order]
        a, b = [], []
        for i in np.flatnonzero(asked):
            own = values[offsets[i] : offsets[i + 1]]
            low, high = np.searchsorted(mine, own, "left"), np.searchsorted(mine, own, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            same = np.bincount(row[at], minlength=len(held))
            near = np.flatnonzero((100 * same >= threshold * (size[held] + size[i] - same)) & (comps[held] != comps[i]))
            if len(near):
                _, first = np.unique(comps[held][near], return_index=True)
                for j in held[near[first]]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return search


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, threshold: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of docs."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{key} is {kind.simpleString()}, not an integer")
    work = Workspace(spark, "near")
    signed = work.write(signatures(docs, key, text, shingle, bands, rows), "signatures")
    name = ["n_shingles", "h1", "h2"]
    some = signed.where("n_shingles > 0 AND id IS NOT NULL")
    classes = work.write(some.groupBy(*name).agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    repeated = work.write(some.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*name)).alias("least"), F.max(F.struct(*name)).alias("most")).where("n > 1").select("id", (F.col("least") != F.col("most")).alias("several")), "repeated")
    any_repeated = not repeated.isEmpty()
    found = links(docs, classes.select(F.col("rep").alias("id"), *name, "bands"), repeated.select("id") if any_repeated else None, work, key, text, shingle, threshold)
    if any_repeated:  # the classes of one id's sets are linked through it
        of_id = work.write(some.select("id", *name).distinct().join(repeated.where("several"), "id", "left_semi").join(classes.select(*name, "rep"), name).select("id", "rep").distinct(), "of_id")
        found = found.unionByName(of_id.join(of_id.groupBy("id").agg(F.min("rep").alias("least")), "id").where("rep > least").select(F.col("least").alias("a"), F.col("rep").alias("b")))
    parts = components(found, work)
    named = classes.select(*name, "rep").join(parts, F.col("rep") == F.col("id"), "left").select(*name, F.coalesce("component", "rep").alias("component"))
    full, empty = signed.where("n_shingles > 0").select("id", *name), signed.where("n_shingles = 0")
    out = full.join(named, name, "left").select("id", "n_shingles", "component").unionByName(empty.select("id", "n_shingles", F.lit(None).cast("bigint").alias("component")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast(kind)
    return out.select(F.col("id").cast(kind).alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))
