"""The commit graph: which merge of the main line brought a commit in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlake.operators.attribution import pr_number
from commitlake.session import materialise


def main_line(commits: DataFrame, tip: DataFrame | None = None) -> DataFrame:
    """pos of the commits on the first-parent chain from the tip, by pointer doubling.

    ``commits``: pos, parents (array of pos). ``tip``: one row with the tip's pos; without it the last pos is the tip. Parents outside of the history are dropped before the first is taken.
    Jumps double in each round, and with them the part of the chain that has been reached, so a chain of n commits
    takes log2(n) rounds and no row holds more than one commit.
    """
    first = _links(commits).groupBy("pos").agg(F.min(F.struct("place", "parent")).alias("p")).select("pos", F.col("p.parent").alias("parent"))
    jumps = materialise(first, "jumps")
    reached = (commits.agg(F.max("pos").alias("pos")) if tip is None else tip).select(F.col("pos").cast("bigint").alias("pos")).where("pos IS NOT NULL")
    while not jumps.isEmpty():
        reached = materialise(reached.unionByName(reached.join(jumps, "pos").select(F.col("parent").alias("pos"))), "reached")
        onward = jumps.select(F.col("pos").alias("parent"), F.col("parent").alias("further"))
        jumps = materialise(jumps.join(onward, "parent").select("pos", F.col("further").alias("parent")), "jumps")
    return reached


def _links(commits: DataFrame) -> DataFrame:
    """pos, place, parent of every recorded parent that is in the history."""
    rows = commits.select("pos", F.posexplode("parents").alias("place", "parent"))
    return rows.join(commits.select(F.col("pos").alias("parent")), "parent", "left_semi").select("pos", "place", F.col("parent").cast("bigint").alias("parent"))


def owners(commits: DataFrame, tip: DataFrame | None = None) -> DataFrame:
    """pos, owner: the earliest commit of the main line that reaches a commit; main-line commits own themselves.

    A commit off the line is owned by the least of the owners of its children. Commits with one child off the line jump
    down, 1, 2, 4, 8 … generations, and take over the owner met there, so a side branch of n commits takes log2(n)
    rounds; those with several ask all of these in every round, so only forks within side branches cost rounds.
    """
    links = materialise(_links(commits), "links")
    chain = materialise(main_line(commits, tip), "main-line")
    off = links.join(chain.select(F.col("pos").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("pos"), F.col("pos").alias("child"))
    below = materialise(off.join(chain.select(F.col("pos").alias("child"), F.lit(True).alias("on_line")), "child", "left"), "below")
    downs = below.where("on_line IS NULL").groupBy("pos").agg(F.count("*").alias("n"), F.min("child").alias("child"))
    known = materialise(below.where("on_line").groupBy("pos").agg(F.min("child").alias("owner")), "owners")
    forks = materialise(below.where("on_line IS NULL").join(downs.where("n > 1").select("pos"), "pos", "left_semi").select("pos", "child"), "forks")
    jumps = materialise(downs.where("n = 1").select("pos", "child"), "jumps")
    forked, longest = not forks.isEmpty(), jumps
    while True:
        ways = jumps.unionByName(forks) if forked else longest
        reach = ways.join(known.select(F.col("pos").alias("child"), "owner"), "child").select("pos", "owner")
        now = materialise(known.unionByName(reach).groupBy("pos").agg(F.min("owner").alias("owner")), "owners")
        rest = now.join(known.withColumnRenamed("owner", "had"), "pos", "left").where("had IS NULL OR owner < had")
        onward = longest.select(F.col("pos").alias("child"), F.col("child").alias("further"))
        longer = materialise(longest.join(onward, "child").select("pos", F.col("further").alias("child")), "jumps")
        if longer.isEmpty() and rest.isEmpty():
            return chain.select("pos", F.col("pos").alias("owner")).unionByName(now)
        known = now
        if not longer.isEmpty():
            longest = longer
            jumps = jumps.unionByName(longer) if forked else longer


def pr_members(commits: DataFrame, tip: DataFrame | None = None) -> DataFrame:
    """merge_pos, pos: the commits that each merge of the main line brought in."""
    merges = _links(commits).groupBy("pos").count().where("count > 1").select(F.col("pos").alias("merge_pos"))
    mine = owners(commits, tip).where("owner <> pos").select(F.col("owner").alias("merge_pos"), "pos")
    return mine.join(merges, "merge_pos", "left_semi")


def assign_prs(commits: DataFrame, tip: DataFrame | None = None) -> DataFrame:
    """pos, pr: the number in the own subject, else that of the merge that brought the commit in.

    ``commits``: pos, parents, message.
    """
    own = commits.select("pos", pr_number(F.col("message")).alias("own"))
    brought = pr_members(commits, tip).join(own.select(F.col("pos").alias("merge_pos"), F.col("own").alias("merged")), "merge_pos").select("pos", "merged")
    return own.join(brought, "pos", "left").select("pos", F.coalesce("own", "merged").alias("pr"))


def blame_by_agent(blame: DataFrame, commits: DataFrame) -> DataFrame:
    """agent, lines of blamed lines (pos, lines): human where no agent is credited, unattributed outside of the history."""
    known = commits.select("pos", F.coalesce(F.nullif("agent", F.lit("")), F.lit("human")).alias("agent"))
    return blame.join(known, "pos", "left").groupBy(F.coalesce("agent", F.lit("unattributed")).alias("agent")).agg(F.sum("lines").cast("bigint").alias("lines"))


def parse_porcelain(texts: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, hash, lines: lines of each commit in the porcelain output of a blame."""
    line = texts.select(*keep, F.explode(F.split(F.col(text), "\n")).alias("line"))
    head = r"^([0-9a-f]{40}) \d+ \d+(?: \d+)?$"
    return line.where(F.col("line").rlike(head)).groupBy(*keep, F.regexp_extract("line", head, 1).alias("hash")).agg(F.count("*").alias("lines"))
