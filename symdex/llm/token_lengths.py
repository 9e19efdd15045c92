"""Operator 5: token counts by an exact histogram of encoded lengths, and suffix sums over it.

Each whole text is encoded with a public byte-level BPE; documents are counted by length before anything is
shuffled, so what moves is one row per distinct length and task; the histogram is stored once. Suffix sums then answer, for every context
limit, how many documents reach it, how many tokens they hold and how many are left after truncation.

Null text counts as empty, an empty text has length 0 and is counted; repeated rows count each time; an empty
table gives an empty histogram; other columns are not looked at. The vocabulary's path and pattern are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symdex.llm.shared import Workspace, keyed, map_texts, table, texts_of

#: Distinct lengths to a block of the two-level suffix sums.
BLOCK = 4096
_made: dict = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _made:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path, pattern] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _made[path, pattern]


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens) of each whole text."""
    known = default_tokenizer()
    path, pattern = path or known[0], pattern or known[1]

    def make():
        encode = _encoding(path, pattern).encode_ordinary

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in texts_of(batch, "text")], pa.int64())], ["key", "n_tokens"])

        return each

    return map_texts(df.select(df[key].alias("key"), df[text].alias("text")), "text", make, keyed(df, key, "n_tokens bigint")).withColumnRenamed("key", key)


def histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) by exact length."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def stored_histogram(counts: DataFrame) -> DataFrame:
    """The histogram as a table in the shared folder: texts are encoded once, whatever is asked of it, and a lost executor loses nothing."""
    return Workspace(counts.sparkSession, "lengths").write(histogram(counts), "histogram")


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length: documents and tokens at or beyond it, below it, and the total if all were cut to it.

    Within a block of lengths by a window; across blocks by a window over one row a block. The histogram is read
    twice, so a caller hands over one that is stored (`stored_histogram`).
    """
    h = hist.withColumn("b", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = W.partitionBy("b").orderBy(F.desc("n_tokens"))
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after, every = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("b", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    s = h.join(blocks, "b").withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("ad")).withColumn("tokens_at_least", F.sum("tokens").over(inside) + F.col("at"))
    below = F.col("all_tokens") - F.col("tokens_at_least")
    return s.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (below + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        F.col("all_docs"), F.col("all_tokens"),
    )


def for_limits(sums: DataFrame, limits: Iterable[int]) -> DataFrame:
    """(context_limit, n_docs, n_longer, total_tokens, truncated_total) for any limits, from the suffix sums.

    The first length beyond a limit holds all that is needed; one pass whatever the number of limits.
    """
    limits = sorted(set(limits))
    first = [F.min(F.when(F.col("n_tokens") > c, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"f{i}") for i, c in enumerate(limits)]
    one = sums.agg(F.max("all_docs").alias("n_docs"), F.max("all_tokens").alias("total_tokens"), *first)
    rows = [F.struct(F.lit(c).cast("bigint").alias("context_limit"), F.coalesce(F.col(f"f{i}.docs_at_least"), F.lit(0)).alias("n_longer"), F.coalesce(F.col(f"f{i}.tokens_at_least"), F.lit(0)).alias("over")) for i, c in enumerate(limits)]
    return one.select("n_docs", "total_tokens", F.inline(F.array(*rows))).select("context_limit", "n_docs", "n_longer", "total_tokens", (F.col("total_tokens") - F.col("over") + F.col("n_longer") * F.col("context_limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: Iterable[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents doesn't exceed."""
    shares = list(shares)
    one = sums.agg(*[F.min(F.when(F.col("docs_at_most") >= F.lit(q) * F.col("all_docs"), F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)])))


def op5_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(stored_histogram(count_tokens(table(spark, sf_dir, "documents"))))
