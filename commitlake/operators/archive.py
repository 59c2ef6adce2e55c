"""Usage by day, source and model: reduction of calls, the archive, cumulative snapshots, series and shares."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.functions.usage import COUNTERS
from commitlake.operators.attribution import is_ai, source_for
from commitlake.session import materialise


def by_day_model(calls: DataFrame) -> DataFrame:
    """source, day, model, the four counters and turns of ``calls`` (source, day, model, counters, turns).

    Calls without a day or with only zeros are left out; a missing or empty model is ``unknown``.
    """
    used = calls.where((F.col("day") != "") & (F.greatest(*COUNTERS) > 0))
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model")
    return used.groupBy("source", "day", model).agg(*(F.sum(c).cast("bigint").alias(c) for c in [*COUNTERS, "turns"]))


def first_of_key(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``calls`` with one row for each ``key``, the first by ``order``; rows without a key are all kept.

    The first is found by a minimum, which is combined before the shuffle, and joined back on the order columns.
    """
    keyed = calls.where(F.col(key) != "")
    first = keyed.groupBy(key).agg(F.min(F.struct(*order)).alias("k_first")).select("k_first.*")
    return keyed.join(first, order, "left_semi").unionByName(calls.where(F.coalesce(F.col(key), F.lit("")) == ""))


def totals(archive: DataFrame) -> DataFrame:
    """source, day, tokens, turns of the archive; records without tokens are left out."""
    tokens = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    return archive.groupBy("source", "day").agg(F.sum(tokens).cast("bigint").alias("tokens"), F.sum("turns").cast("bigint").alias("turns")).where("tokens > 0")


def merge_larger(archive: DataFrame, scanned: DataFrame) -> DataFrame:
    """Archive of both: of each (source, day) the record with more tokens, whole; the archived one on a tie."""
    tokens = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    both = archive.withColumn("m_old", F.lit(1)).unionByName(scanned.withColumn("m_old", F.lit(0)))
    sums = both.groupBy("source", "day", "m_old").agg(F.sum(tokens).alias("m_tokens"))
    best = sums.groupBy("source", "day").agg(F.max(F.struct("m_tokens", "m_old")).alias("m")).select("source", "day", F.col("m.m_old").alias("m_old"))
    return both.join(best, ["source", "day", "m_old"], "left_semi").drop("m_old")


def top_model(archive: DataFrame) -> DataFrame:
    """source, model with the most tokens; ties by name."""
    tokens = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    sums = archive.groupBy("source", "model").agg(F.sum(tokens).alias("t"))
    return sums.groupBy("source").agg(F.min_by("model", F.struct((-F.col("t")).alias("t"), "model")).alias("model"))


_ADDED = "source string, session string, model string, day string, input bigint, output bigint, cache_read bigint, cache_write bigint, turns bigint, state string"


def cumulative_increase(snapshots: DataFrame) -> DataFrame:
    """What every cumulative snapshot adds: source, session, model, day, counters, turns, state.

    ``snapshots``: source, session, model, at (the order, of any type that has one), day, the four counters, calls (NULL where not
    reported), valid (false: contradicts itself). State is added; stale (nothing grew, nothing is added); broken (some
    grew, others fell), undated or invalid, which leave what was seen unchanged. A chain of one (session, model) is
    folded in a streaming pass over its sorted rows: the state is one snapshot, so a chain may be of any length.
    """

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain: tuple | None = None
        seen, calls_seen = (0, 0, 0, 0), 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.source, r.session, r.model) != chain:
                    chain, seen, calls_seen = (r.source, r.session, r.model), (0, 0, 0, 0), 0
                now = (int(r.input), int(r.output), int(r.cache_read), int(r.cache_write))
                calls = None if pd.isna(r.calls) else int(r.calls)
                add, turns = (0, 0, 0, 0), 0
                if not r.valid:
                    state = "invalid"
                elif not r.day:
                    state = "undated"
                elif all(a <= b for a, b in zip(now, seen, strict=True)):
                    state = "stale"
                elif any(a < b for a, b in zip(now, seen, strict=True)):
                    state = "broken"
                else:
                    state, add = "added", tuple(a - b for a, b in zip(now, seen, strict=True))
                    turns = 1 if calls is None else max(0, calls - calls_seen)
                    seen, calls_seen = now, calls_seen if calls is None else calls
                out.append((*chain, r.day, *add, turns, state))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ADDED.split(", ")])

    keys = ["source", "session", "model"]
    ready = snapshots.select(*keys, "at", F.coalesce("day", F.lit("")).alias("day"), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS), "calls", "valid")
    return ready.repartition(*keys).sortWithinPartitions(*keys, "at").drop("at").mapInPandas(fold, _ADDED)


def source_series(totals_: DataFrame, commits: DataFrame) -> DataFrame:
    """source, day, tokens, kind: measured days (m) and days estimated (e) at the source's tokens per changed line.

    ``commits``: pos, agent, utc_day (text), churn. A day with a record is measured; a day without one, on which the
    source's agents changed lines, is estimated, rounded half to even; others are left out.
    """
    mine = commits.where(is_ai(F.col("agent"))).withColumn("source", source_for(F.col("agent"))).where(F.col("source").isNotNull() & (F.col("utc_day") != ""))
    lines = mine.groupBy("source", F.col("utc_day").alias("day")).agg(F.sum("churn").alias("churn"))
    present = totals_.select("source").distinct()
    both = totals_.select("source", "day", "tokens").join(lines.join(present, "source", "left_semi"), ["source", "day"], "full")
    covered = both.where("tokens IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("s_tokens"), F.sum("churn").alias("s_churn"))
    rated = both.join(covered, "source").withColumn("ratio", F.when(F.col("s_churn") > 0, F.col("s_tokens") / F.col("s_churn")).otherwise(0.0))
    kept = rated.where((F.col("tokens").isNotNull()) | ((F.col("churn") > 0) & (F.col("ratio") > 0)))
    guess = F.rint(F.col("ratio") * F.col("churn")).cast("bigint")
    return kept.select("source", "day", F.coalesce("tokens", guess).alias("tokens"), F.when(F.col("tokens").isNull(), "e").otherwise("m").alias("kind"))


def combined_series(series: DataFrame) -> DataFrame:
    """day, tokens, kind over all sources; measured only where every source of the day is."""
    return series.groupBy("day").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.max(F.when(F.col("kind") == "e", 1).otherwise(0)).alias("e")).select("day", "tokens", F.when(F.col("e") == 1, "e").otherwise("m").alias("kind"))


def commit_shares(series: DataFrame, commits: DataFrame) -> DataFrame:
    """pos, source, tokens, kind: each source's day shared over its agents' commits of that day by their churn."""
    mine = commits.where(is_ai(F.col("agent")) & (F.col("churn") > 0)).withColumn("source", source_for(F.col("agent"))).withColumnRenamed("utc_day", "day")
    whole = mine.groupBy("source", "day").agg(F.sum("churn").alias("day_churn"))  # combined before the shuffle: a busy day is no hot group
    day = series.join(whole, ["source", "day"]).select("source", "day", "kind", F.col("tokens").alias("day_tokens"), "day_churn")
    share = F.rint(F.col("day_tokens") * F.col("churn") / F.col("day_churn")).cast("bigint")
    return mine.join(day, ["source", "day"]).select("pos", "source", share.alias("tokens"), "kind")


def source_summary(series: DataFrame, archive: DataFrame, commits: DataFrame) -> DataFrame:
    """source, measured_total, measured_days, estimated_total, covered_churn, coverage_start, top_model."""
    sums = series.groupBy("source").agg(
        F.sum(F.when(F.col("kind") == "m", F.col("tokens")).otherwise(0)).cast("bigint").alias("measured_total"),
        F.count(F.when(F.col("kind") == "m", 1)).alias("measured_days"),
        F.sum(F.when(F.col("kind") == "e", F.col("tokens")).otherwise(0)).cast("bigint").alias("estimated_total"),
        F.min(F.when(F.col("kind") == "m", F.col("day"))).alias("coverage_start"),
    )
    mine = commits.where(is_ai(F.col("agent"))).select(source_for(F.col("agent")).alias("source"), F.col("utc_day").alias("day"), "churn")
    covered = mine.join(series.where("kind = 'm'").select("source", "day"), ["source", "day"], "left_semi").groupBy("source").agg(F.sum("churn").cast("bigint").alias("covered_churn"))
    joined = sums.join(covered, "source", "left").join(top_model(archive).withColumnRenamed("model", "top_model"), "source", "left")
    return joined.select("source", "measured_total", "measured_days", "estimated_total", F.coalesce("covered_churn", F.lit(0)).alias("covered_churn"), "coverage_start", "top_model")


def carry_forward(df: DataFrame, keys: list[str], order: str, tie: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``df`` with the last ``value`` that is not NULL up to each row, in ``keys`` by ``order`` (a whole number) and ``tie``.

    Works block by block of the order; every block starts from the last value of the blocks before it, computed from
    one row a block, so a key with a third of all rows is spread over many tasks.
    """
    cut = df.withColumn("c_block", F.floor(F.coalesce(F.col(order), F.lit(0)) / block))
    last = cut.groupBy(*keys, "c_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order, tie))).alias("c_last"))
    earlier = Window.partitionBy(*keys).orderBy("c_block").rowsBetween(Window.unboundedPreceding, -1)
    start = last.select(*(F.col(k).alias(f"c_{i}") for i, k in enumerate(keys)), F.col("c_block").alias("c_of"), F.last("c_last", ignorenulls=True).over(earlier).alias("c_start"))
    same = F.col("c_block") == F.col("c_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"c_{i}"))
    here = Window.partitionBy(*keys, "c_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(start, same, "left").drop("c_of", *(f"c_{i}" for i in range(len(keys))))
    return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(here), F.col("c_start"))).drop("c_block", "c_start")


def as_of(df: DataFrame, at: str, table: DataFrame, since: str, value: str, name: str, limit: int = 10_000) -> DataFrame:
    """``df`` with the ``value`` of the last ``table`` row whose ``since`` is not after ``at``; NULL before the first.

    A table of at most ``limit`` rows, a release list, is read to the driver and becomes an array in the plan that each
    row searches. A larger one is merged with the distinct ``at`` in sorted ranges: the last value of each range goes on
    to the next, and the answers are joined back. Of equal ``since`` the greatest value counts; a NULL ``at`` gives NULL.
    """
    starts = table.where(F.col(since).isNotNull()).groupBy(F.col(since).alias("s")).agg(F.max(value).alias("v"))
    rows = starts.orderBy("s").limit(limit + 1).collect()
    if not rows:
        return df.withColumn(name, F.lit(None).cast(table.schema[value].dataType))
    if len(rows) <= limit:
        cell = F.array(*(F.struct(F.lit(r[0]).cast(table.schema[since].dataType).alias("s"), F.lit(r[1]).cast(table.schema[value].dataType).alias("v")) for r in rows))
        return df.withColumn(name, F.try_element_at(F.filter(cell, lambda x: x["s"] <= F.col(at)), F.lit(-1))["v"])
    asked = df.where(F.col(at).isNotNull()).select(F.col(at).alias("s")).distinct().withColumns({"v": F.lit(None), "k": F.lit(1)})
    both = starts.select("s", F.struct("v").alias("v"), F.lit(0).alias("k")).unionByName(asked.withColumn("v", F.lit(None).cast(f"struct<v:{table.schema[value].dataType.simpleString()}>")))
    ranges = materialise(both.repartitionByRange("s").withColumn("r", F.spark_partition_id()), "as-of")
    ends = ranges.where("k = 0").groupBy("r").agg(F.max_by("v", "s").alias("end"))
    every = ranges.select("r").distinct().join(ends, "r", "left")  # one row a range
    into = every.select("r", F.last("end", ignorenulls=True).over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("in"))
    here = Window.partitionBy("r").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, 0)
    found = ranges.join(into, "r").withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(here), F.col("in"))).where("k = 1").select(F.col("s").alias(at), F.col("v.v").alias(name))
    return df.join(found, at, "left").select(*df.columns, name)
