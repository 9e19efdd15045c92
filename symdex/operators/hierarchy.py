"""The class hierarchy as stored relations: who reaches whom over which edges, and in whose members a name is looked up.

`reach` has (via, root, node, depth): the least number of edges from a root to each node it reaches, over superclasses and
mixins (`all`), superclasses alone (`parent`), or all edges of the workspace's own classes (`own`). It is made by
doubling, so depth 32 takes six rounds, and is a table of the facts from then on: a question about ancestors,
descendants or lookup order is a filter or a join of it, whatever the depth.

When edges change, pairs whose shortest way may use a removed edge are deleted and derived again from what is left, and
added edges are joined in; pairs that no change concerns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions.workdir import written
from symdex.schema import present

MAX_DEPTH = 32
#: Order of one class's own members, and of what is mixed in, when a method is looked up.
MIXIN_RANK = {"prepend": 0, "own": 1, "include": 2, "extend": 2}
#: Superclasses up to which members are looked up.
LOOKUP_DEPTH = 8
_PAIR = ["via", "root", "node"]


def edges(f: Facts) -> DataFrame:
    """(child, parent, kind): parent names of classes and modules, and mixins, as one relation."""
    up = f.symbols.where(F.col("kind").isin("class", "module") & present("parent_name").isNotNull()).select(F.col("name").alias("child"), F.col("parent_name").alias("parent"), F.lit("parent").alias("kind"))
    mixed = f.mixins.join(f.symbols.select(F.col("id").alias("class_id"), F.col("name").alias("child")), "class_id").select("child", F.col("module_name").alias("parent"), "kind")
    return up.unionByName(mixed).distinct()


def steps(f: Facts) -> DataFrame:
    """(via, root, node): the edges of each relation."""
    e = edges(f).where("child IS NOT NULL AND parent IS NOT NULL")
    own = f.symbols.join(f.workspace().select("file_id"), "file_id", "left_semi").where(F.col("kind").isin("class", "module")).select(F.col("name").alias("child")).distinct()
    mine = e.join(own, "child", "left_semi")
    parts = [(e, "all"), (e.where("kind = 'parent'"), "parent"), (mine, "own")]
    out = [df.select(F.lit(via).alias("via"), F.col("child").alias("root"), F.col("parent").alias("node")) for df, via in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def _joined(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Pairs of a way of `a` and one of `b` that goes on from its end, of at most so many edges in all."""
    left = a.select("via", "root", F.col("node").alias("mid"), F.col("depth").alias("d1"))
    right = b.select("via", F.col("root").alias("mid"), "node", F.col("depth").alias("d2"))
    out = left.join(right, ["via", "mid"]).where((F.col("root") != F.col("node")) & (F.col("d1") + F.col("d2") <= most))
    return out.select(*_PAIR, (F.col("d1") + F.col("d2")).alias("depth"))


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*_PAIR).agg(F.min("depth").alias("depth"))


def _saturated(known: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """`known` and `fresh` pairs with all that follow from them by ways through at least one fresh pair."""
    known = written(_least(known.unionByName(fresh)), "reach")
    while not fresh.isEmpty():
        found = _least(_joined(fresh, known, most).unionByName(_joined(known, fresh, most)))
        old = known.select(*_PAIR, F.col("depth").alias("old"))
        fresh = written(found.join(old, _PAIR, "left").where("old IS NULL OR depth < old").select(*_PAIR, "depth"), "fresh")
        known = written(_least(known.unionByName(fresh)), "reach")
    return known


def made(f: Facts, most: int = MAX_DEPTH) -> DataFrame:
    """The relation from the facts alone. A class doesn't reach itself, however its edges run."""
    first = written(steps(f).where("root <> node").withColumn("depth", F.lit(1)), "edges")
    return _saturated(first.limit(0), first, most)


def updated(before: DataFrame, old: DataFrame, new: DataFrame, most: int = MAX_DEPTH) -> DataFrame:
    """`before`, the relation of `old` edges (via, root, node), as the relation of `new` ones."""
    old, new = (x.where("root <> node").select(*_PAIR).distinct() for x in (old, new))
    gone, added = written(old.exceptAll(new), "gone"), written(new.exceptAll(old).withColumn("depth", F.lit(1)), "added")
    none = F.lit(0).alias("depth")
    ends = gone.select("via", F.col("root").alias("c"), F.col("node").alias("p"))
    to = before.select("via", "root", F.col("node").alias("c"), F.col("depth").alias("d1")).unionByName(ends.select("via", F.col("c").alias("root"), "c", none.alias("d1")).distinct())
    back = before.select("via", F.col("root").alias("p"), "node", F.col("depth").alias("d2")).unionByName(ends.select("via", "p", F.col("p").alias("node"), none.alias("d2")).distinct())
    through = ends.join(to, ["via", "c"]).join(back, ["via", "p"]).select(*_PAIR, (F.col("d1") + F.col("d2") + 1).alias("depth"))
    lost = written(before.join(through, [*_PAIR, "depth"], "left_semi").select(*_PAIR), "lost")
    kept = written(before.join(lost, _PAIR, "left_anti").unionByName(new.join(lost, _PAIR, "left_semi").withColumn("depth", F.lit(1))), "kept")
    again = _joined(kept, kept.join(lost.select("via", "node").distinct(), ["via", "node"], "left_semi"), most).join(lost, _PAIR, "left_semi")
    return _saturated(kept, written(_least(again.unionByName(added)).unionByName(kept.join(lost, _PAIR, "left_semi")), "fresh"), most)


def reach(f: Facts) -> DataFrame:
    """The stored relation of the facts, made now if they have none."""
    return f.derived("reach", lambda: made(f))


def carried(before: Facts, after: Facts) -> Facts:
    """`after` with the relation of `before` brought up to date, if it has one."""
    if not before.has("reach"):
        return after
    return after.replaced(reach=updated(before.reach, steps(before), steps(after)))


def owners(f: Facts, depth: int = LOOKUP_DEPTH) -> DataFrame:
    """(cls, owner, rank) for every class: whose members a receiver of the class has, in lookup order: for each class of
    the chain what is prepended, the class itself, what is included or extended, then its parent."""
    e = edges(f)
    names = e.select(F.col("child").alias("cls")).unionByName(e.select(F.col("parent").alias("cls"))).unionByName(f.symbols.where("parent_name IS NOT NULL").select(F.col("parent_name").alias("cls"))).distinct()
    chain = reach(f).where((F.col("via") == "parent") & (F.col("depth") <= depth)).select(F.col("root").alias("cls"), F.col("node").alias("at"), "depth")
    return _ranked(f, chain.unionByName(names.select("cls", F.col("cls").alias("at"), F.lit(0).alias("depth"))))


def owners_of(f: Facts, names: list[str], depth: int = LOOKUP_DEPTH) -> DataFrame:
    """`owners` of some classes alone; a name that no edge has owns what is its own."""
    chain = reach(f).where((F.col("via") == "parent") & F.col("root").isin(*names) & (F.col("depth") <= depth)).select(F.col("root").alias("cls"), F.col("node").alias("at"), "depth")
    own = f.spark.createDataFrame([(n, n, 0) for n in names], "cls string, at string, depth int")
    return _ranked(f, chain.unionByName(own))


def _ranked(f: Facts, chain: DataFrame) -> DataFrame:
    mixed = edges(f).where("kind <> 'parent'").select(F.col("child").alias("at"), F.col("parent").alias("owner"), F.when(F.col("kind") == "prepend", MIXIN_RANK["prepend"]).otherwise(MIXIN_RANK["include"]).alias("place"))
    rows = chain.join(mixed, "at").select("cls", "owner", (F.col("depth") * 4 + F.col("place")).alias("rank"))
    own = chain.select("cls", F.col("at").alias("owner"), (F.col("depth") * 4 + MIXIN_RANK["own"]).alias("rank"))
    return own.unionByName(rows).groupBy("cls", "owner").agg(F.min("rank").alias("rank"))
