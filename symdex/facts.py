"""The fact tables of a code base as one object of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdex import schema as S


class Facts:
    """`facts.symbols` and so on; a table that wasn't given is empty."""

    def __init__(self, spark: SparkSession, **tables: DataFrame):
        self.spark, self._tables = spark, {}
        for name, df in tables.items():
            want = S.schema(name)
            have = {c.lower() for c in df.columns}
            self._tables[name] = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in S.names() and name not in S.SOURCES:
            raise AttributeError(name)
        if name in S.SOURCES and name not in self._tables:
            raise AttributeError(f"{name} was not made")
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], S.schema(name))
        return self._tables[name]

    def replaced(self, **tables: DataFrame) -> Facts:
        """The facts with other tables; what is derived from one of them goes, unless it is given too."""
        stay = {n: df for n, df in self._tables.items() if not set(tables) & set(S.SOURCES.get(n, ()))}
        return Facts(self.spark, **stay | tables)

    def has(self, name: str) -> bool:
        return name in self._tables

    def derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, made once and kept with the facts."""
        if name not in self._tables:
            self._tables[name] = make()
        return self._tables[name]

    @classmethod
    def from_rows(cls, spark: SparkSession, **tables: Iterable[dict]) -> Facts:
        """From rows as dicts; columns that a row leaves out are null."""
        out = {}
        for name, rows in tables.items():
            fields = S.schema(name).names
            out[name] = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], S.schema(name))
        return cls(spark, **out)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Facts:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        listed = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(there)
        derived = {x.getPath().getName() for x in listed} & set(S.SOURCES)
        return cls(spark, **{n: spark.read.schema(S.schema(n)).parquet(f"{path}/{n}") for n in [*S.names(), *sorted(derived)]})

    def save(self, path: str, mode: str = "overwrite") -> None:
        """One Parquet folder a table; the name-keyed tables are sorted by name so that row groups can be skipped."""
        for n in [*S.names(), *(n for n in S.SOURCES if self.has(n))]:
            df = getattr(self, n)
            key = "name" if "name" in df.columns else df.columns[0]
            df.sortWithinPartitions(key).write.mode(mode).parquet(f"{path}/{n}")

    # Views that many operators start from.

    def workspace(self) -> DataFrame:
        """(file_id, path) of files that aren't from installed packages."""
        return self.files.where(~F.coalesce("is_gem", F.lit(False))).select(F.col("id").alias("file_id"), "path")

    def paths(self) -> DataFrame:
        return self.files.select(F.col("id").alias("file_id"), "path")

    def file(self, path: str, suffix: bool = False) -> DataFrame:
        """(file_id, path) of one file, by its path or, on request, by a path's end."""
        same = F.col("path") == path
        return self.paths().where(same | F.col("path").endswith("/" + path) if suffix else same)
