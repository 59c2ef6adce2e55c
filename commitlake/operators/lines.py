"""Lines per language and kind at every commit, snapshots and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.operators.classify import UNCOUNTED, TestRules, with_language

TYPES = ["code", "comment", "blank"]
VECTOR = [f"{t}_{s}" for t in TYPES for s in ("added", "removed")]


def commit_lang(file_rows: DataFrame, table: DataFrame, rules: TestRules | None = None) -> DataFrame:
    """pos, language and the six counters of all files and (``test_``) of test files; rows of zeros are left out.

    ``file_rows``: pos, section (added or removed; others are left out), path, code, comment, blank (NULL is 0). One
    shuffle by commit and language after a map-side sum.
    """
    known = with_language(file_rows.where(F.col("section").isin("added", "removed")), "path", table).where(F.col("language") != UNCOUNTED)
    test = (rules or TestRules()).is_test(F.col("path"))
    sums = []
    for prefix, only in (("", F.lit(True)), ("test_", test)):
        sums += [F.sum(F.when((F.col("section") == s) & only, F.coalesce(t, F.lit(0))).otherwise(0)).cast("bigint").alias(f"{prefix}{t}_{s}") for t in TYPES for s in ("added", "removed")]
    return known.groupBy("pos", "language").agg(*sums).where(F.greatest(*VECTOR) != 0)


def churn(matrix: DataFrame) -> DataFrame:
    """pos, churn: all lines added and removed by a commit."""
    return matrix.groupBy("pos").agg(F.sum(sum((F.col(c) for c in VECTOR[1:]), F.col(VECTOR[0]))).cast("bigint").alias("churn"))


def snapshot_by_language(files: DataFrame) -> DataFrame:
    """language, code, comment, blank, n_files of the files (path, language, code, comment, blank) of a snapshot."""
    return files.groupBy("language").agg(*(F.sum(F.coalesce(t, F.lit(0))).cast("bigint").alias(t) for t in TYPES), F.count("*").alias("n_files"))


def snapshot_by_table(files: DataFrame, table: DataFrame, rules: TestRules | None = None) -> DataFrame:
    """language, counts of all and of test files by the table's language."""
    known = with_language(files.drop("language"), "path", table).where(F.col("language") != UNCOUNTED)
    test = (rules or TestRules()).is_test(F.col("path"))
    all_files = [F.sum(F.coalesce(t, F.lit(0))).cast("bigint").alias(t) for t in TYPES]
    return known.groupBy("language").agg(*all_files, *(F.sum(F.when(test, F.coalesce(t, F.lit(0))).otherwise(0)).cast("bigint").alias(f"test_{t}") for t in TYPES))


def running_sum(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], block: int = 4096) -> DataFrame:
    """``df`` with the running sum of each value in ``keys`` by ``order`` (unique in keys, a whole number).

    A key may hold any share of the rows: sums run inside blocks of the order, and every block starts from the sum of
    the blocks before it, which is computed from one row a block.
    """
    values = {k: F.coalesce(v, F.lit(0)) for k, v in values.items()}
    cut = df.withColumn("r_block", F.floor(F.col(order) / block))
    before = cut.groupBy(*keys, "r_block").agg(*(F.sum(v).alias(f"r_{k}") for k, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("r_block").rowsBetween(Window.unboundedPreceding, -1)
    start = before.select(*keys, "r_block", *(F.coalesce(F.sum(f"r_{k}").over(earlier), F.lit(0)).alias(f"r_{k}") for k in values))
    here = Window.partitionBy(*keys, "r_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(start, [*keys, "r_block"])
    return joined.select(*df.columns, *((F.sum(v).over(here) + F.col(f"r_{k}")).cast("bigint").alias(k) for k, v in values.items()))


def running_totals(matrix: DataFrame) -> DataFrame:
    """pos, language and the running code, comment, blank of each language after every commit that touches it."""
    net = {f"{t}_total": F.col(f"{t}_added") - F.col(f"{t}_removed") for t in TYPES}
    return running_sum(matrix, ["language"], "pos", net).select("pos", "language", *net)


def reconciliation(matrix: DataFrame, by_language: DataFrame, by_table: DataFrame) -> DataFrame:
    """language, and for each type drift (history less snapshot) and mapping (table's view less the counter's)."""
    ends = matrix.groupBy("language").agg(*(F.sum(F.col(f"{t}_added") - F.col(f"{t}_removed")).alias(f"run_{t}") for t in TYPES))
    seen = by_language.select("language", *(F.col(t).alias(f"own_{t}") for t in TYPES))
    mapped = by_table.select("language", *(F.col(t).alias(f"map_{t}") for t in TYPES))
    both = ends.join(seen, "language", "full").join(mapped, "language", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("language", *((z(f"run_{t}") - z(f"own_{t}")).cast("bigint").alias(f"drift_{t}") for t in TYPES), *((z(f"map_{t}") - z(f"own_{t}")).cast("bigint").alias(f"mapping_{t}") for t in TYPES))


def language_order(matrix: DataFrame, snapshot: DataFrame) -> DataFrame:
    """language, place: languages of the snapshot by code (most first, ties by name), then the others by name.

    As many rows as languages, so one ordered window takes them all.
    """
    seen = matrix.select("language").distinct().join(snapshot.select("language", F.col("code").alias("head_code")), "language", "full")
    return seen.select("language", F.row_number().over(Window.orderBy(F.col("head_code").isNull(), F.desc("head_code"), "language")).alias("place"))
