"""Semantic tokens: delta encoding and decoding, ranges, and the difference of two token lists."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

FIELDS = ("dline", "dcol", "len", "type", "mods")


def encode(rows: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, tokens) of rows (by, line, col, len, type, mods): each place as its distance from the one before.

    Lines and columns are 0-based; a column is relative only on an unchanged line.
    """
    w = W.partitionBy(by).orderBy("line", "col", "len", "type", "mods")
    dline = F.col("line") - F.coalesce(F.lag("line").over(w), F.lit(0))
    dcol = F.when(F.col("line") == F.lag("line").over(w), F.col("col") - F.lag("col").over(w)).otherwise(F.col("col"))
    out = rows.select(by, F.row_number().over(w).alias("i"), F.struct(dline.cast("int").alias("dline"), dcol.cast("int").alias("dcol"), "len", "type", "mods").alias("t"))
    return out.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("tokens"))


def decode(df: DataFrame, by: str = "file_id", tokens: str = "tokens") -> DataFrame:
    """(by, line, col, len, type, mods) of each token, in absolute places."""
    exploded = df.select(by, F.posexplode(tokens).alias("i", "t")).select(by, "i", "t.*")
    w = W.partitionBy(by).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    with_line = exploded.withColumn("line", F.sum("dline").over(w).cast("int"))
    start = F.sum(F.when(F.col("dline") != 0, 1).otherwise(0)).over(w)
    runs = with_line.withColumn("run", start)
    col = F.sum("dcol").over(W.partitionBy(by, "run").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return runs.withColumn("col", col).select(by, "line", "col", "len", "type", "mods")


def in_range(df: DataFrame, first: int, last: int, by: str = "file_id") -> DataFrame:
    """The tokens of some lines, encoded anew."""
    return encode(decode(df, by).where(F.col("line").between(first, last)), by)


def splice(df: DataFrame, before: str = "prev_tokens", after: str = "tokens") -> DataFrame:
    """Adds start, delete_count and insert: the one edit between equal beginnings and equal ends, in tokens."""
    a, b = F.coalesce(before, F.array().cast(df.schema[after].dataType)), F.coalesce(after, F.array().cast(df.schema[after].dataType))
    shorter = F.least(F.size("__a"), F.size("__b"))
    other = lambda xs, ys: F.coalesce(F.nullif(F.array_position(F.transform(F.zip_with(F.slice(xs, 1, shorter), F.slice(ys, 1, shorter), lambda x, y: x == y), lambda e: ~e), True), F.lit(0)) - 1, shorter)
    out = df.withColumn("__a", a).withColumn("__b", b).withColumn("__p", other(F.col("__a"), F.col("__b")).cast("int"))
    rest_a, rest_b = F.reverse(F.slice("__a", F.col("__p") + 1, F.size("__a"))), F.reverse(F.slice("__b", F.col("__p") + 1, F.size("__b")))
    out = out.withColumn("__ra", rest_a).withColumn("__rb", rest_b)
    short = F.least(F.size("__ra"), F.size("__rb"))
    same = F.coalesce(F.nullif(F.array_position(F.transform(F.zip_with(F.slice("__ra", 1, short), F.slice("__rb", 1, short), lambda x, y: x == y), lambda e: ~e), True), F.lit(0)) - 1, short).cast("int")
    out = out.withColumn("__s", same)
    return out.withColumn("start", F.col("__p")).withColumn("delete_count", F.size("__ra") - F.col("__s")).withColumn("insert", F.slice("__b", F.col("__p") + 1, F.size("__rb") - F.col("__s"))).drop("__a", "__b", "__p", "__ra", "__rb", "__s")


def to_bytes(tokens: list) -> bytes:
    """Little-endian unsigned 32-bit integers, five to a token."""
    return b"".join(struct.pack("<5I", *t) for t in tokens)


def from_bytes(data: bytes) -> list[tuple[int, ...]]:
    return list(struct.iter_unpack("<5I", data))


def packed(df: DataFrame, column: str = "tokens") -> DataFrame:
    """The token arrays as binary, by built-in functions: hexadecimal words with their bytes turned round."""
    word = lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("bigint"), s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)])
    return df.withColumn(column, F.unhex(F.array_join(F.transform(column, lambda t: F.concat(*[word(t[x]) for x in FIELDS])), "")))


TOKEN_TYPE = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in FIELDS]))
