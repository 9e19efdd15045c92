"""Relational building blocks that the named operators share. All take and return DataFrames; only `closure` runs jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symdex.functions.workdir import stored


def optional(column: str | Column, value) -> Column:
    """An equality that a missing argument switches off."""
    return F.lit(True) if value is None else (F.col(column) if isinstance(column, str) else column) == value


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order; Spark keeps limit + offset rows of each partition and sorts only those."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def without_match(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None) -> DataFrame:
    """Rows of left whose key right doesn't have; right is cut to its distinct keys first."""
    right_on = right_on or left_on
    keys = right.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(right_on)]).distinct()
    return left.join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(left_on)]), "left_anti")


def with_match(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None) -> DataFrame:
    right_on = right_on or left_on
    keys = right.select(*[F.col(r).alias(f"__{i}") for i, r in enumerate(right_on)])
    return left.join(keys, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(left_on)]), "left_semi")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group; the rank limit is applied before the shuffle as well."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def first_wins(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return top_k(df, by, order, 1)


def asof_last(probes: DataFrame, history: DataFrame, by: Sequence[str], at: str, value: Sequence[str], tie: str = "__side") -> DataFrame:
    """Each probe with the latest row of history in its group at or before it, by one window over both together.

    `at` is the ordering column of both sides; `value` columns come from history, null where nothing precedes.
    """
    keep = [c for c in probes.columns if c not in (*by, at)]
    left = probes.select(*by, at, F.struct(*[F.col(c) for c in keep]).alias("__p"), F.lit(None).alias("__h"), F.lit(1).alias(tie))
    right = history.select(*by, at, F.lit(None).alias("__p"), F.struct(*[F.col(c) for c in value]).alias("__h"), F.lit(0).alias(tie))
    both = left.select(*by, at, "__p", F.lit(None).cast(right.schema["__h"].dataType).alias("__h"), tie).unionByName(right.select(*by, at, F.lit(None).cast(left.schema["__p"].dataType).alias("__p"), "__h", tie))
    seen = F.last("__h", ignorenulls=True).over(W.partitionBy(*by).orderBy(at, tie, *[F.col(f"__h.{c}") for c in value]).rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("__seen", seen).where(F.col(tie) == 1)
    return out.select(*by, at, *[F.col(f"__p.{c}").alias(c) for c in keep], *[F.col(f"__seen.{c}").alias(c) for c in value])


def nearest(probes: DataFrame, values: DataFrame, by: Sequence[str], probe: str, value: str, tie: Sequence[str]) -> DataFrame:
    """Each probe with the row of its group whose value is nearest, of equally near ones the least by `tie`.

    The nearest value is the last at or below the probe or the first above it. Both are found by one sort of probes and
    values together, so a group of n values and m probes takes n + m rows, never n * m. Values that are alike are cut
    to their least row by `tie` first, which columns of `tie` must be.
    """
    keep, names = list(probes.columns), [c for c in values.columns if c not in by]
    some = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min_by(F.struct(*names), F.struct(*tie)).alias("__v"))
    left = probes.select(*by, F.col(probe).cast("double").alias("__at"), F.struct(*keep).alias("__p"))
    right = some.select(*by, F.col(value).cast("double").alias("__at"), "__v")
    both = left.unionByName(right, allowMissingColumns=True)
    # a probe stands after the values equal to it going up, and before them going down
    order = W.partitionBy(*by).orderBy("__at", F.col("__p").isNotNull())
    below = F.last("__v", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    above = F.first("__v", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    found = both.withColumn("__below", below).withColumn("__above", above).where("__p IS NOT NULL")
    near = lambda c: F.struct(F.abs(F.col(f"{c}.{value}") - F.col("__at")).alias("d"), *[F.col(f"{c}.{t}") for t in tie], F.col(c).alias("v"))
    one = F.least(*[F.when(F.col(c).isNotNull(), near(c)) for c in ("__below", "__above")])
    return found.withColumn("__n", one).where("__n IS NOT NULL").select(*[F.col(f"__p.{c}").alias(c) for c in keep], *[F.col(f"__n.v.{c}").alias(c) for c in names])


def stabbing(points: DataFrame, ranges: DataFrame, by: Sequence[str], point: str, low: str, high: str, width: int = 64) -> DataFrame:
    """Pairs of a point and a range that holds it, both in one group.

    Ranges are dealt to buckets of `width`, so that a join on group and bucket replaces one on the group alone.
    """
    cut = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(F.col(low), F.col(high)) / width))))
    return points.withColumn("__b", F.floor(F.col(point) / width)).join(cut, [*by, "__b"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")


def confidence_merge(df: DataFrame, by: Sequence[str], confidence: str, arrival: str, value: Sequence[str]) -> DataFrame:
    """The most confident row of each key; of equals the first to arrive. Partial results are merged before the shuffle."""
    best = F.max_by(F.struct(*value), F.struct(F.col(confidence), -F.col(arrival)))
    return df.groupBy(*by).agg(best.alias("__v"), F.max(confidence).alias(confidence)).select(*by, confidence, *[F.col(f"__v.{c}").alias(c) for c in value])


def listed(column: str | Column, order: Sequence[str], sep: str = ", ") -> Column:
    """Aggregate: texts joined in a given order. Nulls are left out."""
    c = F.col(column) if isinstance(column, str) else column
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], c.alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def closure(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth): nodes within max_depth edges of each root, with their least depth; roots have depth 0.

    `edges` is (child, parent), `roots` (node). A frontier only holds nodes that no earlier level reached, so cycles
    end and diamonds count once. Each level is one job whose rows are stored in the shared folder: the plan of a level
    doesn't hold the levels before, and the search ends with the first level that finds nothing new.
    """
    edges = stored(edges.select(F.col("child").alias("__c"), F.col("parent").alias("__p")).where("__c IS NOT NULL AND __p IS NOT NULL").distinct())
    seen = frontier = stored(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["__c"]).select("root", F.col("__p").alias("node")).distinct()
        frontier = stored(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def lines_of(df: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, n, line): 1-based lines of each text."""
    return df.select(*key, F.posexplode(F.split(text, "\n")).alias("__n", "line")).select(*key, (F.col("__n") + 1).alias("n"), "line")


def grep(df: DataFrame, key: Sequence[str], text: str, pattern: Column | None = None, literal: str | None = None, context: int = 1, width: int = 512) -> DataFrame:
    """(key, n, line, before, after): lines that match, with `context` lines around each.

    A literal is matched with ASCII letters in either case; `pattern` is a function of a line's column. Context comes
    from the array of lines, so nothing is shuffled.
    """
    test = pattern or (lambda c: F.contains(ascii_lower(c), F.lit(literal.translate(_LOWER))))
    at = F.filter(F.sequence(F.lit(1), F.size("__l")), lambda i: test(F.get("__l", i - 1)))
    hits = df.select(*key, F.split(text, "\n").alias("__l")).select(*key, "__l", F.explode(at).alias("n"))
    cut = lambda c: F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width), F.lit("…"))).otherwise(c)
    first = F.greatest(F.lit(1), F.col("n") - context)
    return hits.select(
        *key, "n", cut(F.get("__l", F.col("n") - 1)).alias("line"),
        F.transform(F.slice("__l", first, F.col("n") - first), cut).alias("before"),
        F.transform(F.slice("__l", F.col("n") + 1, F.lit(context)), cut).alias("after"),
    )


_LOWER = {c: c + 32 for c in range(65, 91)}
_UPPER_TEXT, _LOWER_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: str | Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c if isinstance(c, Column) else F.col(c), _UPPER_TEXT, _LOWER_TEXT)


def like_ascii(c: str | Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE with ASCII letters in either case."""
    own = ascii_lower(c)
    return own.like(pattern.translate(_LOWER)) if escape is None else F.like(own, F.lit(pattern.translate(_LOWER)), F.lit(escape))


def subsequence(c: str | Column, letters: str) -> Column:
    """Whether the letters occur in order, ASCII letters in either case."""
    pattern = "".join(".*" + ("\\" + x if not x.isalnum() else x) for x in letters.translate(_LOWER))
    return ascii_lower(c).rlike("(?s)^" + pattern)


def edit_distance(a: Column, b: Column, longest: int = 64) -> Column:
    """Levenshtein distance in bytes; 99 where either side has more than `longest`."""
    return F.when((F.octet_length(a) > longest) | (F.octet_length(b) > longest), F.lit(99)).otherwise(F.levenshtein(as_bytes(a), as_bytes(b)))


def as_bytes(c: Column) -> Column:
    """A text with one character for each byte of another, so that functions of characters count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def near_texts(words: DataFrame, others: DataFrame, within: int = 2, longest: int = 64) -> DataFrame:
    """(word, other, d): texts of at most `longest` bytes that differ in 1 to `within` edits of bytes, of (word) and (other).

    Two texts within k edits have a text in common that up to k bytes left out of each give. These deletion
    neighbourhoods meet in one equi-join, so no two texts are paired that aren't near in that way; the distance itself
    is then counted in a band.
    """
    left = _neighbourhood(words.select("word").distinct(), "word", within, longest)
    right = _neighbourhood(others.select("other").distinct(), "other", within, longest)
    pairs = left.join(right, "part").where("word <> other").select("word", "other").distinct()
    d = F.levenshtein(as_bytes(F.col("word")), as_bytes(F.col("other")), within)
    return pairs.withColumn("d", d).where(F.col("d") > 0)


def _neighbourhood(texts: DataFrame, name: str, within: int, longest: int) -> DataFrame:
    """(name, part): each text with what is left of its bytes, up to `within` left out."""
    rows = texts.where(F.octet_length(name) <= longest).select(name, as_bytes(F.col(name)).alias("part"), F.lit(1).alias("at"))
    out = rows
    for _ in range(within):  # bytes go from left to right, so that each choice of them is made once
        n = F.char_length("part")
        at = F.explode(F.sequence(F.col("at"), n))
        rows = rows.where(F.col("at") <= n).select(name, "part", at.alias("at"))
        rows = rows.select(name, F.concat(F.substring("part", F.lit(1), F.col("at") - 1), F.substring("part", F.col("at") + 1, F.lit(longest))).alias("part"), "at")
        out = out.unionByName(rows)
    return out.select(name, F.xxhash64("part").alias("part")).distinct()
