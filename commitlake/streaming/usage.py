"""The usage archive kept up by a stream of calls.

Merging is idempotent and never shrinks a record, so a batch that is delivered again changes nothing. The archive is a
folder of versions; each batch writes the next one whole and readers take the last that is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from commitlake.operators.archive import by_day_model, merge_larger
from commitlake.session import remove_path

ARCHIVE = "source string, day string, model string, input bigint, output bigint, cache_read bigint, cache_write bigint, turns bigint"


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath() for s in files.listStatus(root) if str(s.getPath().getName()).startswith("v-")]
    return sorted(int(str(p.getName())[2:]) for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version; an empty table where there is none."""
    versions = _versions(spark, path)
    reader = spark.read.schema(ARCHIVE)
    return reader.parquet(f"{path}/v-{versions[-1]}") if versions else spark.createDataFrame([], ARCHIVE)


def keep_larger(batch: DataFrame, number: int, path: str, keep: int = 2) -> None:
    """Merge the calls of one batch into the archive at ``path`` as version ``number``; older ones than ``keep`` go."""
    spark = batch.sparkSession
    merged = merge_larger(read_archive(spark, path), by_day_model(batch))
    merged.write.mode("overwrite").parquet(f"{path}/v-{number}")
    for old in _versions(spark, path)[:-keep]:
        remove_path(spark, f"{path}/v-{old}")


def run_archive(calls: DataFrame, path: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Start the archive on a stream of whole scans of a day (source, day, model, counters, turns).

    With ``late`` (for example "2 days") calls have a call_key and a timestamp ``at``, and repeated keys within that
    time are dropped before they are counted.
    """
    if late:
        calls = calls.withWatermark("at", late).dropDuplicatesWithinWatermark(["call_key"])
    return calls.writeStream.foreachBatch(lambda batch, number: keep_larger(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
