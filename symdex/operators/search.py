"""Search over symbol, key and route names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.facts import Facts
from symdex.functions import relational as R
from symdex.operators.lookup import signature_text, with_params
from symdex.schema import present

VARIABLE_SIGILS = ("@", "$")


def workspace_symbols(f: Facts, query: str, kind: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    """Symbols whose name contains the query, wildcards of LIKE included; ordered by name."""
    hit = f.symbols.where(R.like_ascii("name", f"%{query}%") & R.optional("kind", kind))
    out = hit.join(f.paths(), "file_id").select("name", "kind", "path", "line", "col", present("parent_name").alias("parent_name"), present("return_type").alias("return_type"))
    return R.page(out, ["name", "path", "line", "col"], limit, offset)


find_symbol = search_symbols = workspace_symbols


def ranked_symbols(f: Facts, query: str, kind: str | None = None, limit: int = 500, enough: int = 10) -> DataFrame:
    """Three tiers: names that begin with the query (exact ones first, short before long), then, with fewer than
    `enough` hits, names that contain it, then, with still fewer, names that have its letters in order.
    Queries for @ and $ look for variables instead. All tiers are one pass; counts gate them.
    """
    if query[:1] in VARIABLE_SIGILS:
        found = f.local_vars.join(f.workspace(), "file_id").where(R.ascii_lower("name").startswith(query.translate(R._LOWER))).select("name", F.lit("variable").alias("kind"), "path", "line", "col")
        return R.page(found.distinct(), ["name", "path", "line", "col"], min(limit, 100))
    q = F.lit(query.translate(R._LOWER))
    own = R.ascii_lower("name")
    rows = f.symbols.where(R.optional("kind", kind)).join(f.workspace(), "file_id")
    fuzzy = R.subsequence("name", query) if len(query) >= 2 else F.lit(False)
    tier = F.when(own.startswith(q), 0).when(F.contains(own, q), 1).when(fuzzy, 2)
    rows = rows.withColumn("tier", tier).where("tier IS NOT NULL").select("name", "kind", "path", "line", "col", "tier", F.when(own == q, 0).when(own.startswith(q), 1).otherwise(2).alias("rank"))
    counts = rows.agg(F.count_if(F.col("tier") == 0).alias("n0"), F.count_if(F.col("tier") <= 1).alias("n1"))
    open_tier = (F.col("tier") == 0) | ((F.col("tier") == 1) & (F.col("n0") < enough)) | ((F.col("tier") == 2) & (F.col("n1") < enough))
    out = rows.join(F.broadcast(counts)).where(open_tier).drop("n0", "n1")
    return R.page(out, ["tier", "rank", F.char_length("name"), "name", "path", "line", "col"], limit)


def list_by_kind(f: Facts, kind: str, prefix: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
    hit = f.symbols.where(F.col("kind") == kind)
    hit = hit.where(R.like_ascii("name", f"{prefix}%")) if prefix else hit
    return R.page(hit.join(f.workspace(), "file_id").select("name", "path", "line").distinct(), ["name", "path", "line"], limit, offset)


def find_similar(f: Facts, name: str, max_distance: int = 3, limit: int = 50) -> DataFrame:
    """Methods of the workspace by owner whose name is within an edit distance, or one inside the other where both have
    three bytes; the nearest first. A distance outside 1 to 10 counts as 3."""
    max_distance = max_distance if 0 < max_distance <= 10 else 3
    want = F.lit(name)
    own = f.symbols.join(f.workspace().select("file_id"), "file_id", "left_semi").where((F.col("kind") == "def") & (F.col("name") != want) & (F.col("name") != ""))
    names = own.select("name", present("parent_name").alias("class")).distinct()
    d = R.edit_distance(F.col("name"), want)
    inside = F.lit(len(name.encode()) >= 3) & (F.octet_length("name") >= 3) & (F.contains("name", want) | F.contains(want, F.col("name")))
    near = F.col("distance") <= max_distance
    out = names.withColumn("distance", d).where(near | inside).withColumn("match", F.when(near, "edit_distance").otherwise("substring"))
    return R.page(out, ["distance", "name", F.col("class").asc_nulls_first()], limit)


def i18n_lookup(f: Facts, query: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return R.page(f.i18n_keys.where(R.like_ascii("key", f"%{query}%")).join(f.paths(), "file_id").select("key", "value", "locale", "path"), ["key", "locale", "path"], limit, offset)


def i18n_values(f: Facts, key: str, limit: int = 10) -> DataFrame:
    """Translations of one key by locale."""
    return R.page(f.i18n_keys.where(F.col("key") == key).select("locale", "value"), ["locale", "value"], limit)


def list_routes(f: Facts, prefix: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    hit = f.routes.where(R.ascii_lower("helper_name").startswith(prefix.translate(R._LOWER))) if prefix else f.routes
    out = hit.join(f.paths(), "file_id").select("http_method", "path_pattern", "helper_name", "controller", "action", "path", "line")
    return R.page(out, ["path_pattern", "http_method", "path", "line"], limit, offset)


def route_map(f: Facts, prefix: str | None = None, offset: int = 0, limit: int = 200) -> DataFrame:
    return list_routes(f, prefix, offset, limit)


def complete_general(f: Facts, prefix: str, path: str | None = None, line: int | None = None, callee: str | None = None, limit: int = 200) -> DataFrame:
    """Completion by name: prefix before infix, short before long, each name once, with signature and doc.

    Locals of the file up to the line come first, then keyword parameters of the method that is being called.
    """
    q = F.lit(prefix.translate(R._LOWER))
    own = R.ascii_lower("name")
    none = F.lit(None).cast("string")
    hit = f.symbols.where(F.contains(own, q))
    # signatures are made for one symbol a name, after the page is cut
    rows = hit.select("name", "kind", "return_type", "doc", F.when(own.startswith(q), 2).otherwise(3).alias("rank"), F.col("id").alias("tie"))
    if path is not None:
        local = f.local_vars.join(f.file(path), "file_id").where(own.startswith(q) & (F.col("line") <= (line or 0)))
        rows = rows.unionByName(local.select("name", F.lit("variable").alias("kind"), F.col("type_hint").alias("return_type"), none.alias("doc"), F.lit(0).alias("rank"), F.col("line").cast("bigint").alias("tie")))
    if callee is not None:
        defs = f.symbols.where((F.col("name") == callee) & (F.col("kind") == "def")).select(F.col("id").alias("symbol_id"))
        keys = f.params.where(F.col("kind") == "keyword").join(defs, "symbol_id", "left_semi").where(own.startswith(q))
        rows = rows.unionByName(keys.select("name", F.lit("keyword").alias("kind"), F.col("type_hint").alias("return_type"), none.alias("doc"), F.lit(1).alias("rank"), F.col("position").cast("bigint").alias("tie")))
    out = R.page(R.first_wins(rows, ["name"], ["rank", "tie", "kind"]), ["rank", F.char_length("name"), "name"], limit)
    out = with_params(f, out.withColumn("id", F.when(F.col("rank") >= 2, F.col("tie"))))
    return out.select("name", "kind", present("return_type").alias("return_type"), present("doc").alias("doc"), "rank", signature_text().alias("signature"))


def complete_all(f: Facts, limit: int = 500) -> DataFrame:
    return R.page(f.symbols.select("name", "kind").distinct(), [F.char_length("name"), "name", "kind"], limit)


def complete_namespace(f: Facts, parent: str, limit: int = 100) -> DataFrame:
    """What may follow `Parent::`."""
    kinds = ("classdef", "constant", "def", "class", "module")
    return R.page(f.symbols.where((F.col("parent_name") == parent) & F.col("kind").isin(*kinds)).select("name", "kind", "id"), ["name", "kind", "id"], limit).drop("id")


def complete_arguments(f: Facts, path: str, line: int, prefix: str = "", locals_limit: int = 50, limit: int = 200) -> DataFrame:
    """Locals before the line, then symbols, short before long."""
    p = prefix.translate(R._LOWER)
    local = R.page(f.local_vars.join(f.file(path), "file_id").where((F.col("line") <= line) & R.ascii_lower("name").startswith(p)).select("name").distinct(), ["name"], locals_limit)
    kinds = ("def", "classdef", "class", "module", "constant")
    rest = R.page(f.symbols.where(R.ascii_lower("name").startswith(p) & F.col("kind").isin(*kinds)).select("name", "kind").distinct(), [F.char_length("name"), "name", "kind"], limit)
    return local.select(F.lit(0).alias("tier"), "name", F.lit("variable").alias("kind")).unionByName(rest.select(F.lit(1).alias("tier"), "name", "kind"))


def complete_instance_variables(f: Facts, path: str, line: int, prefix: str = "@") -> DataFrame:
    """Instance variables of the class around the line, or of no known class."""
    here = f.file(path)
    own = f.symbols.join(here, "file_id").where(F.col("kind").isin("class", "module") & (F.col("line") <= line)).agg(F.max_by("id", F.struct("line", "id")).alias("cls"))
    hit = f.local_vars.join(here, "file_id").join(F.broadcast(own)).where(R.ascii_lower("name").startswith(prefix.translate(R._LOWER)) & (F.col("class_id").isNull() | (F.col("class_id") == F.col("cls"))))
    return hit.select("name", present("type_hint").alias("type_hint")).distinct()


def complete_globals(f: Facts, prefix: str = "$", limit: int = 200) -> DataFrame:
    return R.page(f.local_vars.where(R.ascii_lower("name").startswith(prefix.translate(R._LOWER))).select("name").distinct(), ["name"], limit)


def complete_i18n(f: Facts, prefix: str, limit: int = 50) -> DataFrame:
    return R.page(f.i18n_keys.where(R.ascii_lower("key").startswith(prefix.translate(R._LOWER))).select("key", "value").distinct(), ["key", "value"], limit)


def complete_routes(f: Facts, prefix: str, limit: int = 50) -> DataFrame:
    return R.page(f.routes.where(R.ascii_lower("helper_name").startswith(prefix.translate(R._LOWER))).select("helper_name", "http_method", "path_pattern"), ["helper_name", "http_method", "path_pattern"], limit)


def complete_env(f: Facts) -> DataFrame:
    """Names read from ENV anywhere in the workspace."""
    names = F.concat(F.regexp_extract_all("text", F.lit(r"""ENV\[["']([A-Za-z0-9_]+)["']\]"""), 1), F.regexp_extract_all("text", F.lit(r"""ENV\.fetch\(\s*["']([A-Za-z0-9_]+)["']"""), 1))
    return f.lines.join(f.workspace(), "file_id").where(F.contains("text", F.lit("ENV"))).select(F.explode(names).alias("name")).distinct()


def complete_require(f: Facts, prefix: str, limit: int = 50) -> DataFrame:
    """Paths that a require may name."""
    stem = F.regexp_replace("path", r"^(.*/)?lib/|\.rb$", "")
    return R.page(f.workspace().select(stem.alias("name")).where(F.col("name").startswith(prefix)).distinct(), ["name"], limit)


def complete_detail(f: Facts, name: str) -> DataFrame:
    """Doc and return type of the first documented method of a name."""
    hit = f.symbols.where((F.col("name") == name) & (F.col("kind") == "def"))
    return R.page(hit, [present("doc").isNull(), "id"], 1).select("doc", "return_type")
