"""Facts of scanned files: each file is parsed by itself, and its rows get ids that any machine gives them.

The scan is stored once, so files are read once; one Arrow pass over it parses each file once and stores its rows by
table. Tables are then cut from what is stored, whatever is asked of them and however often.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex import schema as S
from symdex.facts import Facts
from symdex.functions.workdir import written
from symdex.operators import type_rounds
from symdex.operators.infer import schema_columns
from symdex.operators.tokens import encode
from symdex.sources import parsers
from symdex.sources.scan import file_rows, line_rows

#: Characters of parsed rows that a task holds before it gives them out.
OUT_CHARS = 1 << 22
PARSED = ("symbols", "params", "local_vars", "refs", "mixins", "i18n_keys", "routes", "tokens", "calls")
#: Fields of parsed rows that are no fact table.
OWN_FIELDS = {"tokens": [(f, "int") for f in ("line", "col", "len", "type", "mods")]}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def parse_file(path: str, text: str) -> dict[str, list[dict]]:
    """Rows by table, by the kind of file. What can't be parsed gives none."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith((".yml", ".yaml")):
        return {"i18n_keys": parsers.parse_locale(text)} if "locales" in path else {}
    if name.endswith(".rbs"):
        return parsers.parse_signatures(text)
    code = parsers.template_code(text) if name.endswith(".erb") else parsers.indented_template_code(text, name.endswith(".slim")) if name.endswith((".haml", ".slim")) else text
    out = parsers.parse_ruby(code)
    if name == "routes.rb" or "/routes/" in path:
        out["routes"] = parsers.parse_routes(text) or parsers.parse_routing_tree(text, name.removesuffix(".rb"))
    return out


def extract(scanned: DataFrame, is_gem: bool = False, parse: Callable[[str, str], dict[str, list[dict]]] = parse_file) -> Facts:
    """All facts of a scan (path, mtime_ms, content_hash, text), with the types that follow from them."""
    return type_rounds.typed(parsed(scanned, is_gem, parse))


def parsed(scanned: DataFrame, is_gem: bool = False, parse: Callable[[str, str], dict[str, list[dict]]] = parse_file) -> Facts:
    """What the texts of a scan say; types of calls are left open, since they depend on other files."""
    scanned = written(scanned.select("path", "mtime_ms", "content_hash", "text"), "scan")

    fields = {name: _fields(name) for name in PARSED}

    def run(batches):
        kinds = {name: pa.struct([(f, _ARROW[kind]) for f, kind in has]) for name, has in fields.items()}
        for batch in batches:
            rows, size = {name: [] for name in kinds}, 0
            for i, p, t in zip(*(batch.column(k) for k in range(3)), strict=True):
                for name, found in parse(p.as_py(), t.as_py() or "").items():
                    rows[name] += ((i.as_py(), n, r) for n, r in enumerate(found))
                    size += sum(64 + sum(len(x) for x in r.values() if isinstance(x, str)) for r in found)
                if size >= OUT_CHARS:
                    yield from _batches(rows, kinds)
                    rows, size = {name: [] for name in kinds}, 0
            yield from _batches(rows, kinds)

    structs = ", ".join(f"{name} struct<{', '.join(f'{f}: {kind}' for f, kind in has)}>" for name, has in fields.items())
    tagged = scanned.select(F.xxhash64("path").alias("file_id"), "path", "text").mapInArrow(run, f"file_id bigint, t string, n bigint, {structs}")
    tagged = written(tagged, "parsed", ["t"])
    symbol = lambda n: F.xxhash64("file_id", n)
    tables = {"files": file_rows(scanned, is_gem), "lines": line_rows(scanned)}
    for name in PARSED:
        mine = tagged.where(F.col("t") == name).select("file_id", "n", f"{name}.*")
        if name == "symbols":
            mine = mine.withColumn("id", symbol(F.col("n"))).unionByName(_columns(scanned), allowMissingColumns=True)
        elif name == "params":
            mine = mine.withColumn("symbol_id", symbol(F.col("symbol")))
        elif name in ("mixins", "local_vars"):
            mine = mine.withColumn("class_id", F.when(F.col("symbol").isNotNull(), symbol(F.col("symbol"))))
        elif name == "calls":
            mine = mine.withColumn("symbol_id", F.when(F.col("symbol").isNotNull(), symbol(F.col("symbol"))))
        if name == "tokens":
            tables["sem_tokens"] = encode(mine.select("file_id", "line", "col", "len", "type", "mods"))
        elif name in S.KEYS and "symbol_id" not in S.KEYS[name]:  # the first row of a place, whatever the order of arrival
            tables[name] = mine.groupBy(*S.KEYS[name]).agg(F.min_by(F.struct(*mine.columns), "n").alias("x")).select("x.*")
        else:
            tables[name] = mine
    return Facts(scanned.sparkSession, **tables)


def _fields(name: str) -> list[tuple[str, str]]:
    """(field, type) of parsed rows of a table."""
    own = OWN_FIELDS.get(name)
    own = own if own else [(f.name, f.dataType.simpleString()) for f in S.schema(name) if f.name not in ("id", "file_id", "symbol_id", "class_id")]
    return [*own, ("symbol", "bigint")]


def _batches(rows: dict[str, list[tuple]], kinds: dict[str, pa.DataType]):
    """The rows of each table as a batch, with nulls for what other tables have."""
    for name, own in rows.items():
        if own:
            of = {k: pa.array([r[2] for r in own], kind) if k == name else pa.nulls(len(own), kind) for k, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict({"file_id": pa.array([r[0] for r in own], pa.int64()), "t": pa.array([name] * len(own)), "n": pa.array([r[1] for r in own], pa.int64())} | of)


def _columns(scanned: DataFrame) -> DataFrame:
    """A method of its model for each column of a schema file, with the column's type."""
    lines = line_rows(scanned.where(F.col("path").rlike(r"(^|/)schema\.rb$")))
    return schema_columns(lines).select("file_id", F.xxhash64("file_id", "table", "column").alias("id"), F.col("column").alias("name"), F.lit("def").alias("kind"), "line", F.lit(4).alias("col"), F.col("line").alias("end_line"), F.col("type").alias("return_type"), F.col("model").alias("parent_name"), F.lit("public").alias("visibility"), F.lit("column").alias("doc"))
