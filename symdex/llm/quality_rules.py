"""Operator 1: quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Every rule is a condition on features of the whole text. A bounded sample of rows tells how many characters and words
a text has, which gives the work of each feature (WORK), and which rules reject which rows together. Rules are then
ordered greedily: next comes the rule that rejects most of the rows still left for the work it adds, so that a row
leaves at the first rule that rejects it and dear features are only made for rows that cheap rules kept. Features that
are returned for every row add no work. The estimate is one job over the sample and has no clock in it, so the same
sample gives the same order. The order changes what is computed, never the verdict.

The sample is dealt over up to SAMPLE_FILES files of the table; only there texts of more than SAMPLE_BYTES are left out.

Null text has no words, so it fails the base rules, as empty text does. Repeated rows give repeated results, an
empty table gives an empty one; columns besides the key and the text are not looked at. Words are
[^\x20\x09-\x0D]+; a text's three-word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex.llm.shared import table

#: Rows that work and selectivities are estimated on, files they are taken from, and bytes of the longest of them.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_BYTES = 400, 16, 1 << 20

_LET = "element_at(transform(array({value}), {name} -> {body}), 1)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once a row, however often the body names it."""
    return _LET.format(name=name, value=value, body=body)


_COVERED = "aggregate(sort_array(transform(hits, x -> x.i)), struct(0 AS e, 0 AS n), (a, i) -> struct(i + 3 AS e, a.n + least(3, i + 3 - a.e) AS n), a -> a.n)"
_HITS = "filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h))"
_REPEATED = _let("s", "sort_array(transform(g, (h, i) -> struct(h AS h, i AS i)))", _let("hits", _HITS, _COVERED))

#: Features by name: SQL over `t` (the text, null as empty), `w` (its words) and features above it.
FEATURES = {
    "n_words": "size(w)",
    "word_chars": r"char_length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ''))",
    "n_symbols": "char_length(regexp_replace(t, '[^#*$%&|<>]+', ''))",
    "n_lines": r"size(filter(split(t, '\\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]'))",
    "n_dup_lines": _let("l", r"filter(split(t, '\\n', -1), l -> l RLIKE '[^\\x20\\x09-\\x0D]')", "size(l) - size(array_distinct(l))"),
    "n_repeat_words": f"CASE WHEN size(w) < 4 THEN 0 ELSE {_let('g', 'transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))', f'CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE {_REPEATED} END')} END",
    "n_upper": r"char_length(regexp_replace(t, '[^\\p{Lu}]+', ''))",
    "n_letters": r"char_length(regexp_replace(t, '[^\\p{L}]+', ''))",
}


#: Work of a feature for each character and each word, in steps of a pattern that finds nothing (measured once).
WORK = {"n_words": (0, 1), "word_chars": (10, 0), "n_symbols": (1, 0), "n_lines": (6, 0), "n_dup_lines": (8, 0), "n_repeat_words": (0, 400), "n_upper": (1, 0), "n_letters": (10, 0)}


@dataclass(frozen=True)
class Rule:
    """Rejects where `when` holds; base rules are the contract's own."""

    name: str
    when: str
    base: bool = False


RULES = (
    Rule("few_words", "{n_words} < 50", base=True),
    Rule("repeated_windows", "100 * {n_repeat_words} > 50 * {n_words}", base=True),
    Rule("symbols", "100 * {n_symbols} > 30 * {n_words}"),
    Rule("repeated_lines", "100 * {n_dup_lines} > 40 * {n_lines}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 20 * {n_words}"),
    Rule("shouting", "2 * {n_upper} > {n_letters}"),
    Rule("few_letters", "2 * {n_letters} < {word_chars}"),
)

#: Features that the contract returns for every row.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    d = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("t"))
    return d.withColumn("w", F.expr(r"regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+', 0)"))


def _condition(rule: Rule, columns: tuple[str, ...] = ()) -> str:
    """The rule over features that are columns already, or else their SQL in place."""
    return rule.when.format(**{k: k if k in columns else f"CAST({v} AS BIGINT)" for k, v in FEATURES.items()})


def spread_sample(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """(text): the first rows of each of some files that lie evenly over a Parquet table, or of any other DataFrame as it comes."""
    spark, paths = df.sparkSession, sorted(map(unquote, df.inputFiles()))
    if len(paths) > 1:
        chosen = [paths[i * len(paths) // min(files, len(paths))] for i in range(min(files, len(paths)))]
        parts = [spark.read.schema(df.schema).parquet(p) for p in chosen]
    else:
        parts = [df]
    short = [p.select(text).where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES).limit(-(-rows // len(parts))) for p in parts]
    return reduce(DataFrame.unionAll, short)


def estimate(sample: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, work a row, share it rejects of the rows that earlier rules left) in the order of the cascade."""
    mask = " + ".join(f"CASE WHEN {_condition(rule)} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rules)) or "0"
    rows = _prepared(sample, text, text).select(F.expr(mask).alias("mask"), F.char_length("t").alias("chars"), F.size("w").alias("words"))
    found = rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).collect()
    total = sum(r["n"] for r in found)
    chars, words = (sum(r[c] for r in found) / max(total, 1) for c in ("chars", "words"))
    left, todo, order = {r["mask"]: r["n"] for r in found}, list(range(len(rules))), []
    while todo:
        work = {i: 1 + sum(chars * WORK[k][0] + words * WORK[k][1] for k in FEATURES if k not in RETURNED and "{" + k + "}" in rules[i].when) for i in todo}
        hits = {i: sum(n for m, n in left.items() if m >> i & 1) for i in todo}
        best = max(todo, key=lambda i: ((hits[i] + 1e-6) / work[i], -i))
        order.append((rules[best], work[best], hits[best] / max(1, sum(left.values()))))
        left = {m: n for m, n in left.items() if not m >> best & 1}
        todo.remove(best)
    return order


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample: DataFrame | None = None) -> DataFrame:
    """(key, the returned features, base_failed, kept) of each whole text; work is estimated on a sample of `df`, or on one that is given."""
    order = [rule for rule, _, _ in estimate(spread_sample(df, text) if sample is None else sample, rules, text)]
    made = _prepared(df, key, text).select("key", "t", "w", *[F.expr(FEATURES[k]).cast("bigint").alias(k) for k in RETURNED])
    base = " OR ".join(f"({_condition(r, RETURNED)})" for r in rules if r.base) or "false"
    cascade = "CASE " + " ".join(f"WHEN {_condition(r, RETURNED)} THEN false" for r in order) + " ELSE true END"
    return made.select(F.col("key").alias(key), *RETURNED, F.expr(base).alias("base_failed"), F.expr(cascade).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
reps AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams), unnest([i, i + 1, i + 2]) AS u(p) WHERE c > 1 GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN lines ON d.r = lines.r LEFT JOIN reps ON d.r = reps.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_upper > n_letters OR 2 * n_letters < word_chars) AS kept
FROM b
"""
