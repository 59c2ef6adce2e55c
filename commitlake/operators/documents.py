"""Usage archives as JSON documents, and the windows in which a path belonged to a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlake.functions.jsonx import json_object
from commitlake.functions.usage import COUNTERS

#: Source of the first version's records, which name none (fixed value).
LEGACY_SOURCE = "claude-code"
_MODELS = "models:map<string,struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint>>"


def archive_days(archive: DataFrame) -> DataFrame:
    """day, document: each day of an archive (source, day, model, counters, turns) as JSON
    ``{source: {turns, models: {model: counters}}}``, sources and models in order."""
    counts = F.struct(*(F.col(c) for c in COUNTERS))
    models = archive.groupBy("source", "day").agg(F.sum("turns").cast("bigint").alias("turns"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", counts)))).alias("models"))
    days = models.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.struct("turns", F.map_entries("models").alias("m")))))).alias("sources"))
    ready = F.transform_values("sources", lambda _, x: F.struct(x["turns"].alias("turns"), F.map_from_entries(x["m"]).alias("models")))
    return days.select("day", F.to_json(ready).alias("document"))


def read_archives(texts: DataFrame, text: str) -> DataFrame:
    """source, day, model, counters, turns (of the whole source and day) of archive documents of versions 1 and 2.

    Version 1 has one source a day, LEGACY_SOURCE. Another version, or a text that is no JSON object, fails the query:
    an archive read as empty would be written back as empty.
    """
    head = texts.select(F.col(text).alias("t"), json_object(F.col(text), "version bigint, days map<string,string>").alias("a"))
    known = F.coalesce(F.col("a.version").isin(1, 2), F.lit(False))
    checked = head.where(known | F.raise_error(F.lit("not a token archive of version 1 or 2")).cast("boolean"))
    days = checked.select("a.version", F.explode("a.days").alias("day", "record"))
    old = F.from_json(F.col("record"), f"struct<turns:bigint,{_MODELS}>")
    new = F.from_json(F.col("record"), f"map<string,struct<turns:bigint,{_MODELS}>>")
    entries = days.select("day", F.explode(F.when(F.col("version") == 1, F.create_map(F.lit(LEGACY_SOURCE), old)).otherwise(new)).alias("source", "e"))
    return entries.select("source", "day", F.col("e.turns").alias("turns"), F.explode("e.models").alias("model", "c")).select("source", "day", "model", "c.*", "turns")


def session_windows(stored: DataFrame, live: DataFrame, today: str) -> DataFrame:
    """path, since, until after a run: ``stored`` windows (path, since, until) brought up to the ``live`` paths (path, since).

    A live path that is new gets a window from its since; one that was closed is opened again from it; one that is open
    stays. A stored path that is no longer live is closed today. Relative paths and bounds that are no days are dropped.
    """
    day = lambda c: F.coalesce(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(True))
    valid = stored.where(F.col("path").startswith("/") & day("since") & day("until"))
    once = live.where(F.col("path").isNotNull()).groupBy("path").agg(F.min("since").alias("live_since"), F.lit(True).alias("is_live"))
    both = valid.withColumn("known", F.lit(True)).join(once, "path", "full")
    renewed = F.col("is_live").isNotNull() & (F.col("known").isNull() | F.col("until").isNotNull())
    closed = F.when(F.col("is_live").isNull() & F.col("until").isNull(), F.lit(today)).otherwise(F.col("until"))
    return both.select("path", F.when(renewed, F.col("live_since")).otherwise(F.col("since")).alias("since"), F.when(F.col("is_live").isNotNull(), F.lit(None).cast("string")).otherwise(closed).alias("until"))


def in_windows(df: DataFrame, path: str, day: str, windows: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``day`` lies in a window of their ``path``, both ends included."""
    w = windows.select(F.col("path").alias("w_path"), F.col("since").alias("w_since"), F.col("until").alias("w_until"))
    inside = (F.col(path) == F.col("w_path")) & (F.col("w_since").isNull() | (F.col(day) >= F.col("w_since"))) & (F.col("w_until").isNull() | (F.col(day) <= F.col("w_until")))
    return df.join(w, inside, "left_semi")
