"""Checks over the facts; each gives rows of the diagnostics table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.operators.hierarchy import reach
from symdex.schema import present

#: Methods that the runtime or a test framework calls (fixed values).
CALLED_FROM_OUTSIDE = (
    "initialize", "to_s", "inspect", "to_h", "to_a", "to_i", "to_f", "to_str",
    "to_proc", "to_ary", "to_hash", "to_int", "to_io", "to_path", "to_regexp",
    "method_missing", "respond_to_missing?", "inherited", "included",
    "extended", "prepended", "const_missing", "hash", "eql?", "<=>", "==",
    "coerce", "encode_with", "init_with", "marshal_dump", "marshal_load",
    "setup", "teardown", "before", "after",
)
#: Names that a call may have though the index doesn't define them; callers give their own list for other runtimes.
KNOWN_CALLS = (
    "puts", "print", "p", "raise", "require", "require_relative", "load", "loop", "lambda", "proc", "format", "rand", "sleep", "exit", "new", "class",
    "attr_accessor", "attr_reader", "attr_writer", "include", "extend", "prepend", "private", "public", "protected",
    "freeze", "dup", "tap", "send", "nil?", "is_a?", "respond_to?", "each", "map", "select", "reject", "find", "reduce",
    "first", "last", "size", "length", "count", "empty?", "any?", "all?", "include?", "join", "split", "sort", "min", "max", "sum", "keys", "values", "merge", "fetch",
    "has_many", "belongs_to", "has_one", "validates", "scope", "before_action", "after_action", "render", "redirect_to", "params",
)


def _finding(rows: DataFrame, code: str, severity: int, message: Column) -> DataFrame:
    return rows.select("file_id", "line", "col", message.alias("message"), F.lit(severity).alias("severity"), F.lit(code).alias("code"))


def unused_variables(f: Facts) -> DataFrame:
    own = f.local_vars.where(~F.substring("name", 1, 1).isin("_", "@", "$"))
    return _finding(R.without_match(own, f.refs, ["file_id", "name"]), "unused-variable", 2, F.format_string("unused variable %s", "name"))


def unused_parameters(f: Facts) -> DataFrame:
    p = f.params.select("symbol_id", F.col("name").alias("param")).where(~F.substring("param", 1, 1).isin("_"))
    own = p.join(f.symbols.where(F.col("kind") == "def").select(F.col("id").alias("symbol_id"), "file_id", "line", "col"), "symbol_id")
    own = R.without_match(own, f.refs, ["file_id", "param"], ["file_id", "name"])
    return _finding(R.without_match(own, f.local_vars, ["file_id", "param"], ["file_id", "name"]), "unused-parameter", 4, F.format_string("unused parameter %s", "param"))


def unused_methods(f: Facts) -> DataFrame:
    own = f.symbols.where((F.col("kind") == "def") & (F.col("visibility") == "public") & ~F.col("name").isin(*CALLED_FROM_OUTSIDE) & ~F.col("name").startswith("test_") & ~F.col("name").startswith("_"))
    return _finding(R.without_match(own.join(f.workspace(), "file_id"), f.refs, ["name"]), "unused-method", 4, F.format_string("nothing calls %s", "name"))


def duplicate_methods(f: Facts) -> DataFrame:
    """Methods that a file defines more than once for one owner; keys are counted, rows aren't paired."""
    own = f.symbols.where(F.col("kind") == "def").withColumn("owner", F.coalesce("parent_name", F.lit("")))
    twice = own.groupBy("file_id", "name", "owner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return _finding(own.join(twice, ["file_id", "name", "owner"], "left_semi"), "duplicate-method", 2, F.format_string("%s is defined more than once", "name"))


def nil_receivers(f: Facts) -> DataFrame:
    return _finding(f.refs.where(F.col("receiver_type") == "NilClass"), "nil-receiver", 2, F.format_string("%s is called on nil", "name"))


def wrong_arity(f: Facts) -> DataFrame:
    """Calls with more arguments than the one method they can mean takes, if that takes a fixed number."""
    defs = f.symbols.where(F.col("kind").isin("def", "classdef") & present("parent_name").isNotNull()).select("id", "name", F.col("parent_name").alias("receiver_type"))
    only = defs.groupBy("name", "receiver_type").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("symbol_id")).where("n = 1").drop("n")
    variadic = F.coalesce(F.col("kind").isin("rest", "keyword_rest", "block"), F.lit(False))
    arity = f.params.groupBy("symbol_id").agg(F.count_if(variadic).alias("variadic"), F.count_if(~variadic).alias("fixed")).where("variadic = 0 AND fixed > 0")
    calls = f.refs.where((F.col("arg_count") > 0) & present("receiver_type").isNotNull() & (F.col("receiver_type") != "NilClass"))
    hit = calls.join(only, ["name", "receiver_type"]).join(arity, "symbol_id").where("arg_count > fixed")
    return _finding(hit, "wrong-arity", 2, F.format_string("%s takes %d arguments, not %d", "name", "fixed", "arg_count"))


def undefined_methods(f: Facts, depth: int = 32, known: Iterable[str] = KNOWN_CALLS) -> DataFrame:
    """Calls inside a class whose name nothing defines though a method's name is the same but for one or two characters
    more at its ends, unless an ancestor of the class around them is outside the index.

    Around a call is the innermost class of its file whose lines hold it; calls outside classes are left alone. Names
    that begin with a capital or an underscore aren't looked at. Close names meet through their inner parts: each
    method name gives at most six, so no two sets of names are paired.
    """
    calls = f.refs.where(~F.col("name").isin(*known) & ~F.col("name").rlike("^[A-Z_]") & (F.col("name") != ""))
    calls = R.without_match(calls, f.symbols, ["name"])
    calls = R.without_match(calls, f.local_vars, ["file_id", "name"]).select("file_id", "name", "line", "col")
    names = f.symbols.where(F.col("kind").isin("def", "classdef") & F.col("name").rlike("^[a-z_]")).select(F.col("name").alias("other")).distinct()
    n = F.char_length("other")
    parts = [F.struct((n - cut).alias("length"), F.substring("other", F.lit(at + 1), n - cut).alias("part")) for cut in range(3) for at in range(cut + 1)]
    parts = names.select("other", F.inline(F.array(*parts))).where("length > 0").select("other", R.ascii_lower("part").alias("low")).distinct()
    word = calls.select("name").distinct().withColumn("low", R.ascii_lower("name"))
    d = R.edit_distance(F.col("name"), F.col("other"))
    near = word.join(parts, "low").withColumn("d", d).where((F.col("d") > 0) & (F.col("d") <= F.least(F.lit(2), F.floor(F.octet_length("name") / 2) + 1)))
    best = near.groupBy("name").agg(F.min_by("other", F.struct("d", "other")).alias("best"))
    calls = calls.join(best, "name")
    classes = f.symbols.where(F.col("kind").isin("class", "module")).select("file_id", F.col("name").alias("cls"), F.col("line").alias("lo"), F.coalesce("end_line", "line").alias("hi"))
    inside = R.stabbing(calls, classes, ["file_id"], "line", "lo", "hi").groupBy("file_id", "name", "line", "col", "best").agg(F.max_by("cls", F.struct("lo", -F.col("hi"), "cls")).alias("cls"))
    up = reach(f).where((F.col("via") == "all") & (F.col("depth") <= depth))
    there = f.symbols.where(F.col("kind").isin("class", "module")).select(F.col("name").alias("node")).distinct()
    unknown = up.join(there, "node", "left_anti").select(F.col("root").alias("cls")).distinct()
    bad = inside.join(unknown, "cls", "left_anti")
    return _finding(bad, "undefined-method", 2, F.format_string("undefined method %s, did you mean %s?", "name", "best"))


CHECKS = {
    "unused-variable": unused_variables, "unused-parameter": unused_parameters, "unused-method": unused_methods, "duplicate-method": duplicate_methods,
    "undefined-method": undefined_methods, "nil-receiver": nil_receivers, "wrong-arity": wrong_arity,
}


def run_checks(f: Facts, disabled: Iterable[str] = (), severity: int | None = None) -> DataFrame:
    """All findings but those of disabled codes; a severity replaces each check's own, which stays in own_severity."""
    off = set(disabled)
    out = reduce(DataFrame.unionByName, [check(f) for code, check in CHECKS.items() if code not in off] or [f.diagnostics.limit(0)])
    return out.withColumn("own_severity", F.col("severity")).withColumn("severity", F.lit(severity) if severity is not None else F.col("severity"))


def disabled_codes(text: str) -> list[str]:
    """Codes of a suppression list: one a line, comments and blank lines left out."""
    return [x for line in text.splitlines() if (x := line.split("#", 1)[0].strip())]


def with_diagnostics(f: Facts, **options) -> Facts:
    """The facts with the diagnostics table made from the checks."""
    return f.replaced(diagnostics=run_checks(f, **options))
