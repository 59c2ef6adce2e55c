"""Measuring only what is new: results kept by key, the commits still to do, and what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlake.operators.lines import running_sum


class KeyedCache:
    """Rows of finished work in a Parquet folder, found again by ``key`` columns: a commit's hash, or a blob and its path.

    ``version`` is part of the folder, so rows of another layout are never read. Each put appends files that only a
    finished job commits; a key that is held already is left as it is.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, version: int = 1) -> None:
        self.spark, self.key, self.schema, self.path = spark, key, schema, f"{path.rstrip('/')}/v{version}"

    def rows(self) -> DataFrame:
        """All rows held; none where nothing was put yet."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def get(self, wanted: DataFrame) -> DataFrame:
        """The rows of the ``wanted`` keys."""
        return self.rows().join(wanted.select(*self.key).distinct(), self.key, "left_semi")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` rows whose key is not held; a key with a NULL is never held."""
        return wanted.join(self.rows().select(*self.key).distinct(), self.key, "left_anti")

    def put(self, rows: DataFrame) -> None:
        """Add the rows of keys that are not held."""
        self.missing(rows.select(*(c.split()[0] for c in self.schema.split(", ")))).write.mode("append").option("compression", "zstd").parquet(self.path)


def plan_measuring(commits: DataFrame, held: DataFrame, cap: int | None = None) -> DataFrame:
    """pos, plan of every commit: merge (never measured), held, todo, or pending beyond the first ``cap`` in history order.

    ``commits``: pos, is_merge; ``held``: pos of those whose rows are cached.
    """
    known = commits.select("pos", "is_merge").join(held.select("pos", F.lit(True).alias("m_held")).distinct(), "pos", "left")
    plan = F.when(F.col("is_merge"), "merge").when(F.col("m_held"), "held").otherwise("todo")
    planned = known.select("pos", plan.alias("plan"))
    if cap is None:
        return planned
    counted = running_sum(planned.withColumn("m_all", F.lit(0)), ["m_all"], "pos", {"m_n": (F.col("plan") == "todo").cast("int")})
    return counted.select("pos", F.when((F.col("plan") == "todo") & (F.col("m_n") > cap), "pending").otherwise(F.col("plan")).alias("plan"))


def commit_status(commits: DataFrame, measured: DataFrame, failed: DataFrame) -> DataFrame:
    """pos, status: merge, else ok (measured), failed, or pending; a commit in both is ok."""
    marks = lambda df, name: df.select("pos", F.lit(True).alias(name)).distinct()
    joined = commits.select("pos", "is_merge").join(marks(measured, "m_ok"), "pos", "left").join(marks(failed, "m_failed"), "pos", "left")
    return joined.select("pos", F.when(F.col("is_merge"), "merge").when(F.col("m_ok"), "ok").when(F.col("m_failed"), "failed").otherwise("pending").alias("status"))
