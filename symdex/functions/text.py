"""Columns, offsets, addresses and type names as client protocols write them, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _walk(line: Column, stop, give) -> Column:
    """Go through a line's characters, counting UTF-8 bytes (b) and UTF-16 units (u), until `stop` holds."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("u"))
    size = lambda c: F.octet_length(c)
    step = lambda a, c: F.when(stop(a), a).otherwise(F.struct((a["b"] + size(c)).alias("b"), (a["u"] + F.when(size(c) == 4, 2).otherwise(1)).alias("u")))
    return F.aggregate(F.filter(F.split(line, ""), lambda c: c != ""), start, step, give)


def utf16_column(line: str | Column, byte_column: str | Column) -> Column:
    """The column in UTF-16 units of a column in UTF-8 bytes; one inside a character counts that character."""
    n = _col(byte_column)
    return _walk(_col(line), lambda a: a["b"] >= n, lambda a: a["u"])


def utf8_column(line: str | Column, unit_column: str | Column) -> Column:
    """The column in UTF-8 bytes of a column in UTF-16 units; one inside a pair counts that character."""
    n = _col(unit_column)
    return _walk(_col(line), lambda a: a["u"] >= n, lambda a: a["b"])


def place_of_offset(text: str | Column, offset: str | Column) -> Column:
    """(line, col) from 1 and 0 of a byte offset in a text; offsets beyond the end are at the end."""
    n = _col(offset)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("col"))

    def step(a: Column, x: Column) -> Column:
        there = F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), (a["line"] + 1).alias("line"), F.least(n - a["at"], F.octet_length(x)).cast("int").alias("col"))
        return F.when((a["line"] > 0) & (n < a["at"]), a).otherwise(there)

    return F.aggregate(F.split(_col(text), "\n", -1), start, step, lambda a: F.struct(a["line"].alias("line"), a["col"].alias("col")))


def to_uri(path: str | Column) -> Column:
    """file:// and the path, all but its plain characters as percent codes."""
    return F.concat(F.lit("file://"), F.replace(F.replace(F.replace(F.url_encode(_col(path)), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))


def from_uri(uri: str | Column) -> Column:
    """The path of a file address; anything else is taken as it is."""
    c = _col(uri)
    return F.when(c.startswith("file://"), F.url_decode(F.replace(F.substring(c, F.lit(8), F.length(c)), F.lit("+"), F.lit("%2B")))).otherwise(c)


def generic_type(name: str | Column) -> Column:
    """(base, args) of a type name: Hash[K, V] is Hash of K and V, and [T] an Array of T; args may be one level deep themselves."""
    c = F.trim(_col(name))
    listed = F.when(c.startswith("["), F.concat(F.lit("Array"), c)).otherwise(c)
    base, inside = F.regexp_extract(listed, r"^([\w:]+)\[.*\]$", 1), F.regexp_extract(listed, r"^[\w:]+\[(.*)\]$", 1)
    return F.struct(F.when(base == "", c).otherwise(base).alias("base"), F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r",\s*(?![^\[]*\])")).alias("args"))
