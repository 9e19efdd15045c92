"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again by the next.

Each function takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents. Rows with a null doc_id go through like others. Null and empty texts have no
language and leave at the first stage. Empty tables pass through as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from symdex.llm import decontaminate, language_id, near_duplicates, secret_scan, token_codec
from symdex.llm.shared import Workspace, table


def _free(docs: DataFrame, *wanted: str) -> list[str]:
    """Column names that docs don't have."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name in have:
            name += "_"
        out.append(name)
    return out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 3 gives a language, however low its score; the machines learn from the labelled ones among them."""
    lang, score = _free(docs, "__lang", "__score")
    found = language_id.label_rows(docs, language_id.train(docs), name=lang, score=score)
    return found.where(F.col(lang) != "und").drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; a null id counts as larger than all.

    Rows with the same doc_id and other texts are documents of their own. Of rows that are alike in doc_id and text the
    least by all columns is kept.
    """
    work, low = Workspace(spark, "near-rows"), F.lit((1 << 61) - 1)
    own, hashed, first, last, node, n = _free(docs, "__own", "__hash", "__first", "__last", "__id", "__n")
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text").bitwiseAND(low) + F.lit(1 << 61))).withColumn(hashed, F.xxhash64("text"))
    several = rows.groupBy(own).agg(F.min(hashed).alias(first), F.max(hashed).alias(last)).where(F.col(first) != F.col(last))
    several = work.write(several.select(own, first), "several")  # texts are shuffled to it only if it is large
    other = F.xxhash64(own, "text").bitwiseAND(low) + F.lit(1 << 62)
    rows = rows.join(several, own, "left").withColumn(node, F.when(F.col(hashed) != F.col(first), other).otherwise(F.col(own)))
    rows = rows.select(*docs.columns, own, node)
    others = work.write(rows.where(F.col(node) != F.col(own)).select(node, own).distinct(), "others")
    found = near_duplicates.near_duplicates(spark, rows.select(node, "text"), node).join(others, node, "left")
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.coalesce(own, node), node)).alias("least")).select(F.col("least")[node].alias(node))
    order = W.partitionBy(node).orderBy(*docs.columns)
    return rows.join(kept, node, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the contamination rule of operator 4."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by a mark; n_chars follows the text."""
    out = secret_scan.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of all documents."""
    return token_codec.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("token_codec", encode),
]

#: SuperMinHash, the support vector machines and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, work.write(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return docs
