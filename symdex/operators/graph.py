"""Class hierarchy: ancestors, descendants, members in resolution order, rename sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.functions.workdir import written
from symdex.operators.hierarchy import LOOKUP_DEPTH, edges, owners, owners_of, reach

def ancestors(f: Facts, name: str, depth: int = 20, offset: int = 0, limit: int = 50) -> DataFrame:
    up = reach(f).where((F.col("via") == "all") & (F.col("root") == name) & (F.col("depth") <= depth))
    return R.page(up.select(F.col("node").alias("name"), "depth"), ["depth", "name"], limit, offset)


def includers(f: Facts, name: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Classes that mix a module in."""
    hit = f.mixins.where(F.col("module_name") == name).join(f.symbols, f.mixins["class_id"] == f.symbols["id"]).join(f.paths(), "file_id")
    return R.page(hit.select("name", "path", f.symbols["line"]).distinct(), ["name", "path", "line"], limit, offset)


def type_hierarchy(f: Facts, name: str, ancestors_offset: int = 0, descendants_offset: int = 0, limit: int = 50) -> DataFrame:
    """Ancestors by depth, and the classes and modules that mix it in, tagged by direction."""
    up = ancestors(f, name, offset=ancestors_offset, limit=limit).select(F.lit("ancestor").alias("direction"), "name", "depth")
    mixed = f.symbols.where(F.col("kind").isin("class", "module")).join(f.mixins.where(F.col("module_name") == name).select(F.col("class_id").alias("id")), "id", "left_semi")
    down = R.page(mixed.select("name").distinct(), ["name"], limit, descendants_offset)
    return up.unionByName(down.select(F.lit("descendant").alias("direction"), "name", F.lit(1).alias("depth")))


def prepare_type(f: Facts, name: str) -> DataFrame:
    hit = f.symbols.where((F.col("name") == name) & F.col("kind").isin("class", "module", "classdef")).join(f.paths(), "file_id")
    return R.page(hit.select("id", "name", "kind", "path", "line", "col"), ["path", "line", "id"], 1)


def supertypes(f: Facts, name: str, depth: int = 8) -> DataFrame:
    """The chain of parent names, and the modules mixed in directly."""
    chain = reach(f).where((F.col("via") == "parent") & (F.col("root") == name) & (F.col("depth") <= depth)).select(F.col("node").alias("name"))
    return chain.union(edges(f).where((F.col("child") == name) & (F.col("kind") != "parent")).select("parent")).distinct().orderBy("name")


def subtypes(f: Facts, name: str, limit: int = 50) -> DataFrame:
    hit = f.symbols.where((F.col("parent_name") == name) & (F.col("kind") == "class")).join(f.paths(), "file_id")
    return R.page(hit.select("name", "path", "line"), ["name", "path", "line"], limit)


def concern_usage(f: Facts, module: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Classes that mix in a module by its name or by a name that ends in ::name."""
    m = f.mixins.where(((F.col("module_name") == module) | F.col("module_name").endswith("::" + module)) & F.col("kind").isin("include", "prepend", "extend"))
    s = f.symbols.select(F.col("id").alias("class_id"), "name", "file_id", "line")
    out = m.join(s, "class_id").join(f.paths(), "file_id").select("name", F.col("kind").alias("mixin_kind"), "path", "line")
    return R.page(out.distinct(), ["name", "mixin_kind", "path", "line"], limit, offset)


def resolution_order(f: Facts, name: str, depth: int = LOOKUP_DEPTH) -> DataFrame:
    """(owner, rank): whose members a receiver of this class has, in lookup order."""
    return owners_of(f, [name], depth).select("owner", "rank")


def _methods(f: Facts, prefix: str, inside: bool) -> DataFrame:
    m = f.symbols.where(F.col("kind").isin("def", "classdef") & F.col("name").startswith(prefix))
    return m if inside else m.where(F.coalesce("visibility", F.lit("public")) == "public")


def complete_dot(f: Facts, receiver: str, prefix: str = "", inside: bool = False, limit: int = 200) -> DataFrame:
    """Methods of a receiver type (each part of a union), each name from the first owner that has it."""
    parts = receiver.split(" | ")
    place = F.lit(0)
    for i, part in reversed(list(enumerate(parts))):
        place = F.when(F.col("cls") == part, i * 1000).otherwise(place)
    order = owners_of(f, parts).groupBy("owner").agg(F.min(F.col("rank") + place).cast("int").alias("rank"))
    m = _methods(f, prefix, inside)
    one = R.first_wins(m.join(order, m["parent_name"] == F.col("owner")), ["name"], ["rank", "id"])
    return R.page(one.select("name", "owner", "rank", "return_type", "doc"), ["rank", "name"], limit)


def complete_all_dots(f: Facts, prefix: str = "", inside: bool = False) -> DataFrame:
    """(cls, name, owner, rank, return_type, doc): what `complete_dot` gives, without a limit, for every class at once."""
    m = _methods(f, prefix, inside).where("parent_name IS NOT NULL").select(F.col("parent_name").alias("owner"), "name", "id", "return_type", "doc")
    m = R.first_wins(m, ["owner", "name"], ["id"])
    # classes that look a name up in the same owners at the same ranks have the same members: these are found once for all of them
    order = owners(f).join(m.select("owner").distinct(), "owner", "left_semi").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("owner", "rank"))).alias("order"))
    order = written(order, "lookup-orders")
    each = order.select("order").distinct().select("order", F.explode("order").alias("o")).select("order", "o.*")
    one = R.first_wins(m.join(each, "owner"), ["order", "name"], ["rank", "id"])
    return order.join(one, "order").select("cls", "name", "owner", "rank", "return_type", "doc")


def related_classes(f: Facts, name: str, depth: int = 4) -> DataFrame:
    """A class, its subclasses and includers, down to a depth, in the workspace."""
    down = reach(f).where((F.col("via") == "own") & (F.col("node") == name) & (F.col("depth") <= depth))
    return down.select(F.col("root").alias("name"), "depth").unionByName(f.spark.createDataFrame([(name, 0)], "name string, depth int"))


def rename_occurrences(f: Facts, name: str, owner: str | None = None, depth: int = 4) -> DataFrame:
    """Places to edit when a method is renamed: definitions and references in the files of related classes."""
    sym = f.symbols.where(F.col("name") == name)
    refs = f.refs.where(F.col("name") == name)
    if owner is not None:
        classes = related_classes(f, owner, depth)
        files = f.symbols.where(F.col("kind").isin("class", "module", "classdef", "def")).join(classes.select("name"), "name", "left_semi").select("file_id").distinct()
        sym, refs = sym.join(files, "file_id", "left_semi"), refs.join(files, "file_id", "left_semi")
    both = sym.select("file_id", "line", "col").union(refs.select("file_id", "line", "col")).distinct()
    return both.join(f.workspace(), "file_id").select("path", "line", "col").orderBy("path", "line", "col")


def rename_local(f: Facts, path: str, name: str, scope_id: int | None) -> DataFrame:
    """Places of a local variable within its scope."""
    here = f.file(path)
    same = F.col("scope_id").eqNullSafe(F.lit(scope_id).cast("bigint"))
    v = f.local_vars.join(here, "file_id").where((F.col("name") == name) & same).select("path", "line", "col")
    r = f.refs.join(here, "file_id").where((F.col("name") == name) & same).select("path", "line", "col")
    return v.union(r).distinct().orderBy("line", "col")


def linked_editing_ranges(f: Facts, path: str, name: str, scope_id: int | None) -> DataFrame:
    """Bindings of a local variable within its scope."""
    v = f.local_vars.join(f.file(path), "file_id").where((F.col("name") == name) & F.col("scope_id").eqNullSafe(F.lit(scope_id).cast("bigint")))
    return v.select("path", "line", "col").distinct().orderBy("line", "col")


def can_rename(f: Facts, name: str) -> DataFrame:
    """Whether anything of that name is the workspace's own."""
    own = f.workspace().select("file_id")
    n = f.symbols.where(F.col("name") == name).join(own, "file_id", "left_semi").select("name").union(f.local_vars.where(F.col("name") == name).join(own, "file_id", "left_semi").select("name"))
    return n.agg((F.count(F.lit(1)) > 0).alias("valid"))


def renamed_requires(f: Facts, old: str, new: str) -> DataFrame:
    """Require lines that name a moved file, with their new text."""
    stem = lambda p: p.removesuffix(".rb").split("lib/", 1)[-1]
    a, b = stem(old), stem(new)
    leaf_a = a.rsplit("/", 1)[-1]
    pattern = rf"""^(\s*require(?:_relative)?\s*\(?\s*["'])((?:[^"']*/)?{leaf_a})(["'].*)$"""
    hit = f.lines.join(f.workspace(), "file_id").where(F.contains("text", F.lit("require")) & F.col("text").rlike(pattern))
    said = F.regexp_extract("text", pattern, 2)
    keep = (said == a) | F.endswith(F.lit("/" + a), F.concat(F.lit("/"), F.regexp_replace(said, r"^(\.\./|\./)+", "")))
    return hit.where(keep).select("path", F.col("n").alias("line"), F.concat(F.regexp_extract("text", pattern, 1), F.when(said == a, F.lit(b)).otherwise(F.concat(F.regexp_extract(said, r"^(.*/)?", 0), F.lit(b.rsplit("/", 1)[-1]))), F.regexp_extract("text", pattern, 3)).alias("text")).orderBy("path", "line")
