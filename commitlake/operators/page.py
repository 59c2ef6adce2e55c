"""Dashboard selections over commits (pos, local_date, agent, message, is_merge) and their line matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.operators.attribution import is_ai, pr_number
from commitlake.operators.lines import TYPES, running_sum


def selection(matrix: DataFrame, commits: DataFrame, language: str = "All", kind: str = "total", tests_only: bool = False) -> DataFrame:
    """pos, local_date, agent, message, is_merge, added, removed, net of every commit for one language and line type."""
    prefix = "test_" if tests_only else ""
    kinds = TYPES if kind == "total" else [kind]
    chosen = matrix if language == "All" else matrix.where(F.col("language") == language)
    sums = [F.sum(sum((F.col(f"{prefix}{t}_{s}") for t in kinds[1:]), F.col(f"{prefix}{kinds[0]}_{s}"))).alias(s) for s in ("added", "removed")]
    per = commits.join(chosen.groupBy("pos").agg(*sums), "pos", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return per.select("pos", "local_date", "agent", "message", "is_merge", z("added").alias("added"), z("removed").alias("removed"), (z("added") - z("removed")).alias("net"))


def cumulative(selected: DataFrame) -> DataFrame:
    """The selection with the running net in history order."""
    return running_sum(selected.withColumn("p_all", F.lit(0)), ["p_all"], "pos", {"cumulative": F.col("net")}).drop("p_all")


def shown_agent(agent: Column) -> Column:
    """Agent as shown: Human where none is credited."""
    return F.coalesce(F.nullif(agent, F.lit("")), F.lit("Human"))


def by_agent(selected: DataFrame) -> DataFrame:
    """agent, n_commits, added, net."""
    return selected.groupBy(shown_agent(F.col("agent")).alias("agent")).agg(F.count("*").alias("n_commits"), F.sum("added").cast("bigint").alias("added"), F.sum("net").cast("bigint").alias("net"))


def daily(selected: DataFrame) -> DataFrame:
    """local_date, net, cumulative; one row a date, of which there are few."""
    days = selected.groupBy("local_date").agg(F.sum("net").cast("bigint").alias("net"))
    return days.withColumn("cumulative", F.sum("net").over(Window.orderBy("local_date").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def extremes(selected: DataFrame, gains: bool, k: int) -> DataFrame:
    """pos, net of the ``k`` commits (no merges) with the largest or the smallest net; ties by history order."""
    rows = selected.where(~F.col("is_merge"))
    return rows.orderBy(F.desc("net") if gains else F.asc("net"), "pos").limit(k).select("pos", "net")


def peak(selected: DataFrame) -> DataFrame:
    """One row: pos, local_date, cumulative of the first commit with the highest running net."""
    best = cumulative(selected).agg(F.max(F.struct("cumulative", (-F.col("pos")).alias("p"), "local_date")).alias("b")).where("b IS NOT NULL")
    return best.select((-F.col("b.p")).cast("bigint").alias("pos"), F.col("b.local_date").alias("local_date"), F.col("b.cumulative").alias("cumulative"))


def monthly_activity(commits: DataFrame) -> DataFrame:
    """month, n_commits, n_prs, is_full of every month from the first to the last date, empty ones included.

    A pull request counts in its first month. The first month is full if its first date is the 1st, the last if its
    last date ends it.
    """
    dated = commits.where(F.col("local_date").isNotNull()).select("local_date", "message", F.trunc("local_date", "month").alias("month"))
    span = dated.agg(F.min("local_date").alias("a"), F.max("local_date").alias("b")).where("a IS NOT NULL")
    months = span.select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("month"))
    counts = dated.groupBy("month").agg(F.count("*").alias("n_commits"))
    prs = dated.withColumn("pr", pr_number(F.col("message"))).where("pr IS NOT NULL").groupBy("pr").agg(F.min("month").alias("month")).groupBy("month").agg(F.count("*").alias("n_prs"))
    full = (F.col("month") >= F.col("a")) & (F.last_day("month") <= F.col("b"))
    joined = months.join(counts, "month", "left").join(prs, "month", "left")
    return joined.select("month", F.coalesce("n_commits", F.lit(0)).alias("n_commits"), F.coalesce("n_prs", F.lit(0)).alias("n_prs"), full.alias("is_full"))


def activity_summary(months: DataFrame) -> DataFrame:
    """One row: the busiest month of all, the least busy and the average of the full ones (of all if none is full); ties
    to the earlier month."""
    any_full = F.max("is_full").over(Window.partitionBy())  # one row a month
    used = months.withColumn("any_full", any_full).withColumn("used", F.col("is_full") | ~F.col("any_full"))
    return used.agg(
        F.min_by("month", F.struct((-F.col("n_commits")).alias("n"), "month")).alias("most_month"),
        F.max("n_commits").alias("most"),
        F.min_by("month", F.when(F.col("used"), F.struct("n_commits", "month"))).alias("fewest_month"),
        F.min(F.when(F.col("used"), F.col("n_commits"))).alias("fewest"),
        F.avg(F.when(F.col("used"), F.col("n_commits"))).alias("average"),
    )


def hero_monthly(selected: DataFrame) -> DataFrame:
    """month, commits and lines added without merges, all and by agents."""
    rows = selected.where(~F.col("is_merge") & F.col("local_date").isNotNull()).withColumn("ai", is_ai(F.col("agent")))
    return rows.groupBy(F.trunc("local_date", "month").alias("month")).agg(
        F.count("*").alias("n_commits"),
        F.count(F.when(F.col("ai"), 1)).alias("n_ai_commits"),
        F.sum("added").cast("bigint").alias("added"),
        F.sum(F.when(F.col("ai"), F.col("added")).otherwise(0)).cast("bigint").alias("ai_added"),
    )


def language_pivot(matrix: DataFrame, languages: list[str], kind: str = "code") -> DataFrame:
    """pos and the net lines of each of ``languages`` in a column of its own (``net_<language>``, letters only)."""
    net = F.col(f"{kind}_added") - F.col(f"{kind}_removed")
    name = lambda lang: "net_" + "".join(c if c.isalnum() else "_" for c in lang).lower()
    return matrix.groupBy("pos").agg(*(F.sum(F.when(F.col("language") == lang, net).otherwise(0)).cast("bigint").alias(name(lang)) for lang in languages))


#: What the table of commits is sorted by, most first (texts: first first); ties by the newest.
SORTS = {"date": "local_date", "churn": "churn", "net": "net", "added": "added", "removed": "removed", "message": "message", "agent": "agent"}


def search(selected: DataFrame, text: str, agents: list[str], k: int = 500, sort: str = "date") -> DataFrame:
    """The first ``k`` commits by ``sort`` whose message, or hash if ``selected`` has one, contains ``text`` in any case
    and whose agent is shown as one of ``agents``."""
    names = [c for c in ("message", "hash") if c in selected.columns]
    found = F.lit(False)
    for name in names:
        found = found | F.coalesce(F.lower(name).contains(text.lower()), F.lit(False))
    hit = selected.where(found & shown_agent(F.col("agent")).isin(*agents))
    by = {"churn": F.col("added") + F.col("removed"), "agent": shown_agent(F.col("agent")), "message": F.lower("message")}.get(sort, F.col(SORTS[sort]))
    return hit.orderBy(by.asc() if sort in ("message", "agent") else by.desc(), F.desc("pos")).limit(k)


def test_cumulative(matrix: DataFrame, commits: DataFrame, language: str = "All", kind: str = "total") -> DataFrame:
    """pos and the running net of test lines in history order."""
    return cumulative(selection(matrix, commits, language, kind, tests_only=True)).select("pos", "cumulative")


def page_rows(selected: DataFrame, matrix: DataFrame, order: DataFrame) -> DataFrame:
    """pos and the commit as a JSON tuple for the page: position, date, message, agent, merge, [[language place, six counters]].

    Languages are numbered from 0 in their order; commits without lines have an empty list.
    """
    cells = matrix.join(order, "language").groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct((F.col("place") - 1).alias("l"), F.array("code_added", "code_removed", "comment_added", "comment_removed", "blank_added", "blank_removed").alias("r")))).alias("cells")
    )
    rows = selected.join(cells, "pos", "left")
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.regexp_replace(quoted(c), r"^\[|\]$", "")
    pairs = F.transform(F.coalesce("cells", F.array().cast("array<struct<l:int,r:array<bigint>>>")), lambda x: F.concat(F.lit("["), x["l"].cast("string"), F.lit(","), F.to_json(x["r"]), F.lit("]")))
    blob = F.concat(F.lit("["), F.concat_ws(",", F.col("pos").cast("string"), inner(F.col("local_date").cast("string")), inner(F.col("message")), inner(F.coalesce("agent", F.lit(""))), F.col("is_merge").cast("string"), F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]"))), F.lit("]"))
    return rows.select("pos", blob.alias("blob"))
