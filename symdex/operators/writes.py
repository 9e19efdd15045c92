"""Changes to fact tables as new DataFrames: upserts, replacement by file, merges and clean-up.

Plain Parquet has no MERGE, so each change is a join with what is there; a caller writes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdex import schema as S
from symdex.facts import Facts
from symdex.functions import relational as R

#: Tables whose rows belong to a file.
OF_FILE = ("symbols", "refs", "local_vars", "sem_tokens", "diagnostics", "i18n_keys", "routes", "lines", "calls")


def file_id(path: str | Column = "path") -> Column:
    """A file's id, the same on every machine."""
    return F.xxhash64(path)


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a path; of several the one changed last."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return R.first_wins(both, ["path"], [F.desc("__new"), F.desc("mtime_ms"), F.desc("content_hash")]).drop("__new")


def replace_files(f: Facts, new: Facts) -> Facts:
    """Rows of the files that `new` has are replaced, with the parameters of their symbols; others stay."""
    changed = new.files.select(F.col("id").alias("file_id"))
    gone = f.symbols.join(changed, "file_id", "left_semi").select(F.col("id").alias("symbol_id"))
    tables = {t: getattr(f, t).join(changed, "file_id", "left_anti").unionByName(getattr(new, t)) for t in OF_FILE}
    tables["params"] = f.params.join(gone, "symbol_id", "left_anti").unionByName(new.params)
    tables["mixins"] = f.mixins.join(gone.withColumnRenamed("symbol_id", "class_id"), "class_id", "left_anti").unionByName(new.mixins)
    tables["files"] = upsert_files(f.files, new.files)
    return f.replaced(**tables)


def insert_or_ignore(table: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose key isn't there yet; of several new ones one."""
    key = S.KEYS[table]
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def merge_variables(rows: DataFrame) -> DataFrame:
    """Variables by place: the most confident type, the first of equals; the latest class that is known.

    `rows` has the columns of local_vars and `arrival`.
    """
    key = S.KEYS["local_vars"]
    best = F.max_by(F.struct("type_hint", "scope_id", "is_block_param"), F.struct("confidence", -F.col("arrival")))
    cls = F.max_by("class_id", F.when(F.col("class_id").isNotNull(), F.col("arrival")))
    out = rows.groupBy(*key).agg(best.alias("b"), F.max("confidence").alias("confidence"), cls.alias("class_id"))
    return out.select(*key, "b.type_hint", "confidence", "b.scope_id", "class_id", "b.is_block_param")


def remove_files(f: Facts, ids: DataFrame) -> Facts:
    """All rows of some files (file_id) go."""
    gone = f.symbols.join(ids, "file_id", "left_semi").select(F.col("id").alias("symbol_id"))
    tables = {t: getattr(f, t).join(ids, "file_id", "left_anti") for t in OF_FILE}
    tables["params"] = f.params.join(gone, "symbol_id", "left_anti")
    tables["mixins"] = f.mixins.join(gone.withColumnRenamed("symbol_id", "class_id"), "class_id", "left_anti")
    tables["files"] = f.files.join(ids.withColumnRenamed("file_id", "id"), "id", "left_anti")
    return f.replaced(**tables)


def remove_stale(f: Facts, there: DataFrame, prefix: str = "") -> Facts:
    """Workspace files under a prefix that a scan (path) no longer finds go."""
    own = f.workspace().where(F.col("path").startswith(prefix))
    return remove_files(f, own.join(there.select("path"), "path", "left_anti").select("file_id"))


def rename_file(f: Facts, old: str, new: str) -> Facts:
    return f.replaced(files=f.files.withColumn("path", F.when(F.col("path") == old, F.lit(new)).otherwise(F.col("path"))))


def remove_prefix(f: Facts, prefix: str) -> Facts:
    return remove_files(f, f.paths().where(F.col("path").startswith(prefix)).select("file_id"))


def changed_files(f: Facts, scan: DataFrame) -> DataFrame:
    """Rows of a scan (path, mtime_ms, content_hash) to index: new, or changed in time and in content."""
    old = f.files.select("path", F.col("mtime_ms").alias("old_mtime"), F.col("content_hash").alias("old_hash"))
    both = scan.join(old, "path", "left")
    same_time = (F.col("mtime_ms") == F.col("old_mtime")) & (F.col("old_hash") != 0)
    return both.where(~F.coalesce(same_time | (F.col("content_hash") == F.col("old_hash")), F.lit(False))).drop("old_mtime", "old_hash")
