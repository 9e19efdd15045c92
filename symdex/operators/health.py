"""Counts, coverage and findings of a whole workspace, each in one pass where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.schema import present

METHOD_KINDS = ("def", "classdef")


def stats(f: Facts) -> DataFrame:
    """One row a table: files, symbols, refs, diagnostics."""
    parts = [getattr(f, t).agg(F.lit(t).alias("what"), F.count(F.lit(1)).alias("n")) for t in ("files", "symbols", "refs", "diagnostics")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kind_histogram(f: Facts) -> DataFrame:
    return f.symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def workspace_summary(f: Facts) -> DataFrame:
    """One row: workspace and package files, symbols, and the version of the schema."""
    gem = F.coalesce("is_gem", F.lit(False))
    files = f.files.agg(F.count_if(~gem).alias("files"), F.count_if(gem).alias("gem_files"))
    version = f.meta.where(F.col("key") == "schema_version").agg(F.max("value").alias("schema_version"))
    return files.join(F.broadcast(f.symbols.agg(F.count(F.lit(1)).alias("symbols")))).join(F.broadcast(version))


def workspace_health(f: Facts) -> DataFrame:
    """(what, n): files, symbols, methods, typed and all variables, unused public methods, findings by severity."""
    own, sym = f.workspace().select("file_id"), f.symbols
    public = sym.where((F.col("kind") == "def") & (F.coalesce("visibility", F.lit("public")) == "public"))
    one = lambda df, what, n=None: df.agg(F.lit(what).alias("what"), (n if n is not None else F.count(F.lit(1))).cast("double").alias("n"))
    typed = F.count(present("type_hint"))
    parts = [
        one(own, "files"), one(sym, "symbols"), one(sym, "methods", F.count_if(F.col("kind").isin(*METHOD_KINDS))),
        one(f.local_vars, "variables"), one(f.local_vars, "typed_variables", typed),
        one(f.local_vars, "typed_pct", F.coalesce(100.0 * typed / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))),
        one(R.without_match(public, f.refs, ["name"]), "unused_methods"),
        f.diagnostics.groupBy("severity").agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.format_string("severity_%d", "severity").alias("what"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_coverage(f: Facts, path: str | None = None, max_pct: float = 100.0) -> DataFrame:
    """Methods and typed methods of each file with any, up to a percentage; the row without path sums the files kept."""
    m = f.symbols.where(F.col("kind") == "def").join(f.workspace(), "file_id").where(R.optional("path", path))
    per = m.groupBy("path").agg(F.count(F.lit(1)).alias("total"), F.count(present("return_type")).alias("typed"))
    per = per.withColumn("pct", 100.0 * F.col("typed") / F.col("total")).where(F.col("pct") <= max_pct)
    total = per.agg(F.lit(None).cast("string").alias("path"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("typed"), F.lit(0)).alias("typed"))
    return per.unionByName(total.withColumn("pct", F.when(F.col("total") > 0, 100.0 * F.col("typed") / F.col("total"))))


def suggest_types(f: Facts, path: str, limit: int = 20) -> DataFrame:
    """Untyped methods of a file, each with the surest type of any variable of its name."""
    defs = f.symbols.where((F.col("kind") == "def") & present("return_type").isNull()).join(f.file(path), "file_id")
    defs = R.page(defs.select("name", "parent_name", "line", "id"), ["line", "id"], min(limit, 100))
    best = f.local_vars.where(present("type_hint").isNotNull()).join(defs.select("name"), "name", "left_semi").groupBy("name").agg(F.max_by("type_hint", F.struct("confidence", "type_hint")).alias("type"), F.max("confidence").alias("confidence"))
    return defs.join(best, "name", "left").select("name", "parent_name", "line", F.coalesce("type", F.lit("untyped")).alias("suggested"), "confidence").orderBy("line", "name")


def diagnostics(f: Facts, path: str | None = None, offset: int = 0) -> DataFrame:
    """Findings of a file, or of the workspace grouped by file."""
    if path is not None:
        rows = f.diagnostics.join(f.file(path), "file_id")
        return R.page(rows.select("path", "line", "col", "severity", "code", "message"), ["line", "col", "code", "message"], 1000, offset)
    rows = R.page(f.diagnostics.join(f.workspace(), "file_id"), ["path", "line", "col", "code", "message"], 2000, offset)
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "col", "severity", "code", "message"))).alias("findings")).orderBy("path")


def diagnostic_summary(f: Facts, path: str | None = None, severity: int | None = None, code: str | None = None, limit: int = 500) -> DataFrame:
    rows = f.diagnostics.join(f.paths(), "file_id").where(R.optional("path", path) & R.optional("severity", severity) & R.optional("code", code))
    return R.page(rows.select("path", "line", "col", "severity", "code", "message"), ["path", "line", "col", "code"], limit)


def dump_symbols(f: Facts) -> DataFrame:
    """One JSON text a workspace symbol, by path and line."""
    rows = f.symbols.join(f.workspace(), "file_id").orderBy("path", "line", "col", "id")
    return rows.select(F.to_json(F.struct("path", "name", "kind", "line", "col", present("parent_name").alias("parent_name"), present("return_type").alias("return_type"))).alias("value"))


def check(f: Facts) -> DataFrame:
    """(problem, n): rows that refer to nothing, and keys that occur twice."""
    from symdex.schema import KEYS

    ids = f.files.select(F.col("id").alias("file_id"))
    parts = [getattr(f, t).join(ids, "file_id", "left_anti").agg(F.lit(f"{t} without file").alias("problem"), F.count(F.lit(1)).alias("n")) for t in ("symbols", "refs", "local_vars", "diagnostics", "i18n_keys", "routes")]
    sym = f.symbols.select(F.col("id").alias("symbol_id"))
    parts.append(f.params.join(sym, "symbol_id", "left_anti").agg(F.lit("params without symbol").alias("problem"), F.count(F.lit(1)).alias("n")))
    parts += [getattr(f, t).groupBy(*k).count().where("count > 1").agg(F.lit(f"{t} with one key").alias("problem"), F.count(F.lit(1)).alias("n")) for t, k in KEYS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
