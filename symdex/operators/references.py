"""References, callers, call hierarchy, occurrences and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.operators import trigrams
from symdex.schema import present

METHOD_KINDS = ("def", "classdef")


def find_references(f: Facts, name: str, offset: int = 0, limit: int = 200, kind: str | None = None) -> DataFrame:
    """References by name, with the trimmed source line. The page is cut before lines are joined. `kind` is accepted and changes nothing."""
    rows = R.page(f.refs.where(F.col("name") == name).join(f.paths(), "file_id").select("file_id", "path", "line", "col"), ["path", "line", "col"], limit, offset)
    text = f.lines.select("file_id", F.col("n").alias("line"), F.trim("text").alias("context"))
    return rows.join(text, ["file_id", "line"], "left").select("path", "line", "col", "context").orderBy("path", "line", "col")


def find_callers(f: Facts, method: str, owner: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
    """Callers by method name; an owner doesn't narrow the search."""
    return find_references(f, method, offset, limit)


def find_unused(f: Facts, kind: str = "def", parent: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols whose name nothing refers to, private ones and packages left out."""
    own = f.symbols.where((F.col("kind") == kind) & (F.coalesce("visibility", F.lit("public")) != "private") & R.optional("parent_name", parent)).join(f.workspace(), "file_id")
    return R.page(R.without_match(own, f.refs, ["name"]).select("name", present("parent_name").alias("parent_name"), "path", "line"), ["path", "line", "name"], limit)


def scoped_references(f: Facts, path: str, name: str, scope_id: int | None) -> DataFrame:
    """A local's bindings and references in its scope; with no scope all references of the name."""
    if scope_id is None:
        return f.refs.where(F.col("name") == name).join(f.paths(), "file_id").select("path", "line", "col").distinct().orderBy("path", "line", "col")
    here = f.file(path)
    mine = (F.col("name") == name) & (F.col("scope_id") == scope_id)
    both = f.local_vars.where(mine).join(here, "file_id").select("path", "line", "col").union(f.refs.where(mine).join(here, "file_id").select("path", "line", "col"))
    return both.distinct().orderBy("path", "line", "col")


def highlights(f: Facts, path: str, name: str, scope_id: int | None = None) -> DataFrame:
    """All places of a name in a file, with what is there."""
    here = f.file(path)
    s = f.symbols.join(here, "file_id").where(F.col("name") == name).select("line", "col", F.lit("write").alias("kind"))
    v = f.local_vars.join(here, "file_id").where((F.col("name") == name) & (F.lit(scope_id is None) | (F.col("scope_id") == (scope_id or 0)))).select("line", "col", F.lit("write").alias("kind"))
    r = f.refs.join(here, "file_id").where((F.col("name") == name) & (F.lit(scope_id is None) | (F.col("scope_id") == (scope_id or 0)))).select("line", "col", F.lit("read").alias("kind"))
    return s.union(v).union(r).groupBy("line", "col").agg(F.max("kind").alias("kind")).orderBy("line", "col")


def prepare_call(f: Facts, name: str) -> DataFrame:
    hit = f.symbols.where(F.col("name") == name).join(f.paths(), "file_id")
    return R.page(hit.select("id", "name", "kind", "path", "line", "col"), ["path", "line", "id"], 1)


def incoming_calls(f: Facts, name: str, limit: int = 100) -> DataFrame:
    """References of a method, each with the latest method of its file that begins at or before it and its kind, or the file's name."""
    rows = R.page(f.refs.where(F.col("name") == name).join(f.paths(), "file_id").select("file_id", "path", "line", "col"), ["path", "line", "col"], limit)
    defs = f.symbols.where(F.col("kind").isin(*METHOD_KINDS, "test")).join(rows.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "line", F.col("name").alias("def_name"), F.col("line").alias("def_line"), F.col("kind").alias("def_kind"))
    seen = R.asof_last(rows, defs, ["file_id"], "line", ["def_name", "def_line", "def_kind"])
    return seen.select("path", "line", "col", F.coalesce("def_name", F.element_at(F.split("path", "/"), -1)).alias("caller"), F.col("def_kind").alias("caller_kind"), "def_line").orderBy("path", "line", "col")


def outgoing_calls(f: Facts, path: str, name: str) -> DataFrame:
    """Calls within a method's lines, each with where a method of that name is first defined."""
    me = f.symbols.join(f.file(path), "file_id").where((F.col("name") == name) & F.col("kind").isin(*METHOD_KINDS)).select("file_id", F.col("line").alias("lo"), F.coalesce("end_line", "line").alias("hi"))
    called = R.stabbing(f.refs.join(me.select("file_id"), "file_id", "left_semi"), me, ["file_id"], "line", "lo", "hi").select("name", "line", "col").distinct()
    target = f.symbols.where(F.col("kind") == "def").join(called.select("name").distinct(), "name", "left_semi").join(f.paths(), "file_id").groupBy("name").agg(F.min(F.struct("path", "line", "id")).alias("t"))
    return called.join(target, "name", "left").select("name", "line", "col", F.col("t.path").alias("target_path"), F.col("t.line").alias("target_line")).orderBy("line", "col", "name")


def code_lens(f: Facts, path: str) -> DataFrame:
    """For each symbol of a file how often its name is referred to there and elsewhere, in one pass."""
    here = f.file(path)
    own = f.symbols.join(here, "file_id").where(F.col("kind").isin("class", "module", *METHOD_KINDS))
    refs = f.refs.join(own.select("name").distinct(), "name", "left_semi").join(F.broadcast(here.select(F.col("file_id").alias("here"))))
    n = refs.groupBy("name").agg(F.count_if(F.col("file_id") == F.col("here")).alias("local_refs"), F.count_if(F.col("file_id") != F.col("here")).alias("other_refs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(n, "name", "left").select("name", "kind", "line", zero("local_refs"), zero("other_refs")).orderBy("line", "name")


def grep_source(f: Facts, query: str, use_regex: bool = False, path_pattern: str | None = None, context: int = 1, offset: int = 0, limit: int = 100, file_limit: int | None = None, indexed: bool | None = None) -> DataFrame:
    """Lines of workspace files that hold a literal (ASCII letters in either case) or match a small regular expression
    of ^ $ . * + (in its own case), with up to five lines around. Files come in the order of their paths.

    All files are looked at, by the trigram index if the facts have one (or, with `indexed`, in any case). A `file_limit`
    looks at the first files alone, and `file_limit_hit` then says whether there are more.
    """
    files = f.workspace().where(F.contains("path", F.lit(path_pattern))) if path_pattern else f.workspace()
    cut_off = None
    if file_limit is not None:
        cut_off = R.page(files, ["path"], file_limit + 1).agg((F.count(F.lit(1)) > file_limit).alias("file_limit_hit"))
        files = R.page(files, ["path"], file_limit)
    grams = trigrams.needed(query, use_regex)
    if grams and (f.has("trigrams") if indexed is None else indexed):
        files = files.join(trigrams.candidates(f, grams), "file_id", "left_semi")
    test = (lambda c: c.rlike(small_regex(query))) if use_regex else (lambda c: F.contains(R.ascii_lower(c), F.lit(query.translate(R._LOWER))))
    rows = f.lines.join(files, "file_id")
    n = max(0, min(5, context))
    hits = R.page(rows.where(test(F.col("text"))).select("file_id", "path", "n", "text"), ["path", "n"], limit, offset)
    around = f.lines.select("file_id", F.col("n").alias("m"), F.col("text").alias("t"))
    near = hits.select("file_id", "path", "n", "text", F.explode(F.sequence(F.col("n") - n, F.col("n") + n)).alias("m")).join(around, ["file_id", "m"])
    cut = lambda c: F.when(F.octet_length(c) > 512, F.concat(F.substring(c, 1, 509), F.lit("…"))).otherwise(c)
    side = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("m", cut(F.col("t")).alias("t"))))), lambda x: x["t"])
    out = near.groupBy("path", "n", "text").agg(side(F.col("m") < F.col("n")).alias("before"), side(F.col("m") > F.col("n")).alias("after")).select("path", F.col("n").alias("line"), cut(F.col("text")).alias("text"), "before", "after")
    return (out if cut_off is None else out.crossJoin(F.broadcast(cut_off))).orderBy("path", "line")


def small_regex(pattern: str) -> str:
    """^ $ . * + as they are, all else as itself."""
    return "".join(c if c in "^$.*+" or c.isalnum() or c == " " else "\\" + c for c in pattern)


def document_links(f: Facts, path: str) -> DataFrame:
    """Require lines of a file and the workspace file that each names."""
    pattern = r"""^\s*require(?:_relative)?\s*\(?\s*["']([^"']+)["']"""
    said = f.lines.join(f.file(path), "file_id").select(F.col("n").alias("line"), F.regexp_extract("text", pattern, 1).alias("target")).where("target <> ''")
    leaf = lambda c: F.element_at(F.split(F.regexp_replace(c, r"\.rb$", ""), "/"), -1)
    files = f.workspace().select(F.col("path").alias("target_path"), leaf("path").alias("leaf"))
    clean = F.regexp_replace(F.regexp_replace("target", r"^(\.\./|\./)+", ""), r"\.rb$", "")
    hit = said.withColumn("clean", clean).withColumn("leaf", leaf("target")).join(files, "leaf").where(F.endswith(F.concat(F.lit("/"), F.regexp_replace("target_path", r"\.rb$", "")), F.concat(F.lit("/"), F.col("clean"))))
    return hit.groupBy("line", "target").agg(F.min_by("target_path", F.struct(F.char_length("target_path"), "target_path")).alias("target_path")).orderBy("line")
