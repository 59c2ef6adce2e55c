"""Histories, file rows and calls as deterministic projections of the star-schema tables.

The projections are plain SQL that Spark and DuckDB read alike, so operators and their checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlake.sources.tables import table

SQL = {
    "commits": """
        SELECT o_orderkey AS pos, CAST(o_orderdate AS DATE) AS local_date,
            CAST(DATE '2024-01-01' + CAST(o_orderkey % 45 AS INT) AS STRING) AS utc_day,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'Claude Opus 4.6' WHEN '2-HIGH' THEN 'Codex' WHEN '3-MEDIUM' THEN 'Copilot'
                WHEN '4-NOT SPECIFIED' THEN NULL ELSE CASE WHEN o_custkey % 3 = 0 THEN 'Devin' ELSE 'Misc' END END AS agent,
            CASE WHEN o_orderkey % 41 = 0 THEN 'Merge pull request #' || CAST(o_orderkey AS STRING) || ' from fork'
                WHEN o_orderkey % 7 = 0 THEN 'Round the shares (#' || CAST(o_orderkey % 997 AS STRING) || ')'
                ELSE 'Change ' || o_orderstatus || ' for ' || CAST(o_custkey AS STRING) END AS message,
            o_orderkey % 41 = 0 AS is_merge
        FROM orders""",
    "file_rows": """
        SELECT l_orderkey AS pos, CASE l_linestatus WHEN 'O' THEN 'added' ELSE CASE WHEN l_partkey % 50 = 0 THEN 'modified' ELSE 'removed' END END AS section,
            CASE l_partkey % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/core/' WHEN 2 THEN 'AppTests/' WHEN 3 THEN 'spec/' ELSE '' END
                || CASE WHEN l_partkey % 11 = 0 THEN 'test_' ELSE '' END || 'm' || CAST(l_partkey % 200 AS STRING)
                || CASE l_suppkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rb' WHEN 3 THEN '.MD' WHEN 4 THEN '.xyz' WHEN 5 THEN '_test.go' ELSE '' END AS path,
            CAST(l_quantity AS BIGINT) AS code, CAST(l_linenumber AS BIGINT) AS comment, l_partkey % 3 AS blank
        FROM lineitem""",
    "languages": """
        SELECT * FROM (VALUES ('py', 'Python'), ('go', 'Go'), ('rb', 'Ruby'), ('md', 'Markdown'), ('/m6', 'Make'), ('/src/core/m6', ''), ('/m7.py', 'Go')) AS t(key, language)""",
    "snapshot_files": """
        SELECT path, CASE WHEN pn % 13 = 0 THEN 'Perl' WHEN path LIKE '%.py' THEN 'Python' WHEN path LIKE '%.go' THEN 'Go' WHEN path LIKE '%.rb' THEN 'Ruby'
            WHEN path LIKE '%.MD' THEN 'Markdown' WHEN path LIKE '%.xyz' THEN 'Odd' ELSE 'Shell' END AS language, code, comment, blank
        FROM (SELECT 'lib/f' || CAST(p_partkey AS STRING) || CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rb' WHEN 3 THEN '.MD' WHEN 4 THEN '.xyz' ELSE '' END AS path,
            p_partkey AS pn, CAST(floor(p_retailprice) AS BIGINT) AS code, CAST(p_size AS BIGINT) AS comment, p_partkey % 4 AS blank FROM part) x""",
    "calls": """
        SELECT CASE event_type WHEN 'click' THEN 'claude-code' WHEN 'view' THEN 'codex' WHEN 'purchase' THEN 'copilot' WHEN 'signup' THEN 'gemini' ELSE 'future-agent' END AS source,
            CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'k' || CAST(event_id % 4000 AS STRING) END AS call_key, CAST(user_id AS STRING) AS session,
            CASE WHEN event_id % 101 = 0 THEN '' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS day,
            CASE event_id % 4 WHEN 0 THEN 'quill' WHEN 1 THEN 'ember' WHEN 2 THEN '' ELSE NULL END AS model,
            CAST(floor(value * 100) AS BIGINT) AS input, event_id % 50 AS output, event_id % 7 AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(1 AS BIGINT) AS turns, event_id AS seq
        FROM events""",
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the projections over the tables of ``folder``."""
    text = SQL[name]
    if name == "languages":
        return spark.sql(text)
    base = {"commits": "orders", "file_rows": "lineitem", "snapshot_files": "part", "calls": "events"}[name]
    return spark.sql(text.replace(f"FROM {base}", "FROM {source}"), source=table(spark, folder, base))


def dag(spark: SparkSession, folder: str) -> DataFrame:
    """commits with ``parents``: the commit before, and for every merge the head of a side branch of up to 20 commits.

    Keys are dense, so pos - 1 is the commit before. Commits 5 to 24 after a multiple of 41 branch off instead of
    following the main line.
    """
    place = F.col("pos") % 41
    off = place.between(21, 40)
    parent = F.when(place == 21, F.col("pos") - 11).when(place == 0, F.col("pos") - 21).otherwise(F.col("pos") - 1)
    commits = view(spark, folder, "commits").where("pos > 0")
    both = F.when((place == 0), F.array(F.col("pos") - 21, F.col("pos") - 1)).otherwise(F.array(parent))
    return commits.withColumn("off_line", off).withColumn("parents", F.filter(both, lambda p: p > 0))


def with_views(*names: str) -> str:
    """``WITH`` clause of the projections for an SQL check."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
