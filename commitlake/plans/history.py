"""Queries over histories, usage and the page, on the projections of ``views`` and the log tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlake.functions import paths as P
from commitlake.functions import usage as U
from commitlake.functions.jsonx import json_object
from commitlake.functions.protobuf import field_bytes, field_number, proto_fields
from commitlake.operators import archive, attribution, classify, documents, graph, lines, measuring, membership, page
from commitlake.plans.problems import normal_stamps
from commitlake.plans.views import dag, view, with_views
from commitlake.session import materialise, utc
from commitlake.sources import agents
from commitlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Agents of the test documents' trailers, as a workspace's own rules.
OWN_AGENTS = [("ember", "Ember"), ("osprey", "Osprey"), ("tidal", "Tidal"), ("heron", "Heron"), ("quill", "Quill")]


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(function)
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            with utc(spark):
                return function(spark, folder)

        QUERIES[function.__name__] = in_utc
        if sql:
            ORACLES[function.__name__] = sql
        return in_utc

    return add


# Fragments of SQL shared by the checks.
_EXT = "CASE WHEN regexp_extract(path, '[^/]*$') NOT LIKE '%.%' OR regexp_matches(regexp_extract(path, '[^/]*$'), '^\\.[^.]*$') THEN NULL ELSE lower(regexp_extract(path, '[^.]*$')) END"
_LANG = f"(SELECT f.*, coalesce(p.language, e.language, 'Other') AS lang FROM file_rows f LEFT JOIN languages p ON p.key = '/' || f.path LEFT JOIN languages e ON e.key = {_EXT.replace('path', 'f.path')})"
_TEST = """(regexp_matches(path, '(?i)(^|/)(test|tests|__tests__|testdata)/') OR regexp_matches(path, '(^|/)\\w+Tests?/')
    OR (regexp_matches(path, '(?i)\\.(rb|js|jsx|ts|tsx|mjs|cjs|coffee)$') AND regexp_matches(path, '(?i)(^|/)(spec|specs)/'))
    OR regexp_matches(path, '(_test\\.go|(^|/)test_[^/]*\\.py|_test\\.py|(^|/)conftest\\.py|_(spec|test)\\.rb|_test\\.dart|_test\\.exs)$'))"""
_SUMS = ", ".join(
    f"CAST(sum(CASE WHEN section = '{s}'{' AND ' + _TEST if p else ''} THEN {t} ELSE 0 END) AS BIGINT) AS {p}{t}_{s}" for p in ("", "test_") for t in ("code", "comment", "blank") for s in ("added", "removed")
)
_MATRIX = f"matrix AS (SELECT * FROM (SELECT pos, lang AS language, {_SUMS} FROM {_LANG} WHERE section IN ('added', 'removed') AND lang <> '' GROUP BY 1, 2) WHERE greatest({', '.join(lines.VECTOR)}) <> 0)"
_CHURN = f"churn AS (SELECT pos, CAST(sum({' + '.join(lines.VECTOR)}) AS BIGINT) AS churn FROM matrix GROUP BY 1)"
_SOURCE = "CASE WHEN agent LIKE 'Claude%' THEN 'claude-code' WHEN agent = 'Codex' THEN 'codex' WHEN agent = 'Copilot' THEN 'copilot' END"


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return lines.commit_lang(view(spark, folder, "file_rows"), view(spark, folder, "languages"))


@query(f"{with_views('file_rows', 'languages')}, {_MATRIX} SELECT * FROM matrix")
def commit_lang_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by commit, language and kind, all and of tests."""
    return _matrix(spark, folder)


@query(f"{with_views('file_rows', 'languages')}, {_MATRIX}, {_CHURN} SELECT * FROM churn")
def churn_per_commit(spark: SparkSession, folder: str) -> DataFrame:
    return lines.churn(_matrix(spark, folder))


@query(f"{with_views('file_rows', 'languages')} SELECT lang AS language, count(*) AS n_rows, CAST(sum(code) AS BIGINT) AS code FROM {_LANG} GROUP BY 1")
def language_for(spark: SparkSession, folder: str) -> DataFrame:
    known = classify.with_language(view(spark, folder, "file_rows"), "path", view(spark, folder, "languages"))
    return known.groupBy("language").agg(F.count("*").alias("n_rows"), F.sum("code").cast("bigint").alias("code"))


@query(f"{with_views('file_rows')} SELECT DISTINCT path, {_EXT} AS extension, '/' || path AS path_key FROM file_rows")
def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "file_rows").select("path", P.extension(F.col("path")).alias("extension"), P.path_key(F.col("path")).alias("path_key")).distinct()


@query(f"{with_views('file_rows')} SELECT path, {_TEST} AS is_test FROM (SELECT DISTINCT path FROM file_rows)")
def is_test_path(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "file_rows").select("path").distinct().withColumn("is_test", classify.TestRules().is_test(F.col("path")))


@query(f"{with_views('file_rows')} SELECT path, CASE WHEN path LIKE 'tests/%' THEN false WHEN regexp_matches(path, '^(.*/)?m1[^/]\\.[^/]*$') THEN true ELSE false END AS is_test FROM (SELECT DISTINCT path FROM file_rows)")
def glob_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = classify.TestRules(include=["**/m1?.*"], exclude=["tests/**"], replace=True)
    return view(spark, folder, "file_rows").select("path").distinct().withColumn("is_test", rules.is_test(F.col("path")))


_LEARN = f"""known AS (SELECT *, {_EXT} AS key FROM snapshot_files),
    counted AS (SELECT k.key, k.language, count(*) AS n, max(CASE WHEN l.language = k.language THEN 1 ELSE 0 END) AS is_base FROM known k LEFT JOIN languages l ON l.key = k.key WHERE k.key IS NOT NULL GROUP BY 1, 2),
    usual AS (SELECT key, language FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY is_base DESC, n DESC, language) AS r FROM counted) WHERE r = 1),
    learned AS (SELECT key, language FROM usual UNION ALL SELECT '/' || k.path, k.language FROM known k LEFT JOIN usual u ON u.key = k.key WHERE u.key IS NULL OR k.language <> u.language),
    merged AS (SELECT coalesce(a.key, b.key) AS key, coalesce(b.language, a.language) AS language FROM languages a FULL JOIN learned b ON a.key = b.key)"""


@query(f"{with_views('snapshot_files', 'languages')}, {_LEARN} SELECT key, language FROM learned")
def learn_extensions(spark: SparkSession, folder: str) -> DataFrame:
    return classify.learn_language_table(view(spark, folder, "snapshot_files"), view(spark, folder, "languages"))


@query(f"{with_views('snapshot_files', 'languages')}, {_LEARN} SELECT key, language FROM merged")
def merge_language_tables(spark: SparkSession, folder: str) -> DataFrame:
    return classify.merge_language_tables(view(spark, folder, "languages"), learn_extensions(spark, folder))


@query(f"{with_views('snapshot_files')} SELECT language, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank, count(*) AS n_files FROM snapshot_files GROUP BY 1")
def snapshot_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return lines.snapshot_by_language(view(spark, folder, "snapshot_files"))


_BY_TABLE = f"by_table AS (SELECT language, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank FROM (SELECT s.path, s.code, s.comment, s.blank, coalesce(p.language, e.language, 'Other') AS language FROM snapshot_files s LEFT JOIN merged p ON p.key = '/' || s.path LEFT JOIN merged e ON e.key = {_EXT.replace('path', 's.path')}) WHERE language <> '' GROUP BY 1)"


@query(f"{with_views('snapshot_files', 'languages')}, {_LEARN}, {_BY_TABLE} SELECT *, CAST(0 AS BIGINT) AS test_code, CAST(0 AS BIGINT) AS test_comment, CAST(0 AS BIGINT) AS test_blank FROM by_table")
def snapshot_by_table(spark: SparkSession, folder: str) -> DataFrame:
    return lines.snapshot_by_table(view(spark, folder, "snapshot_files"), merge_language_tables(spark, folder))


_RUN = ", ".join(f"CAST(sum({t}_added - {t}_removed) OVER w AS BIGINT) AS {t}_total" for t in lines.TYPES)


@query(f"{with_views('file_rows', 'languages')}, {_MATRIX} SELECT pos, language, {_RUN} FROM matrix WINDOW w AS (PARTITION BY language ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    return lines.running_totals(_matrix(spark, folder))


_DRIFT = ", ".join(f"CAST(coalesce(r.{t}, 0) - coalesce(o.{t}, 0) AS BIGINT) AS drift_{t}, CAST(coalesce(m.{t}, 0) - coalesce(o.{t}, 0) AS BIGINT) AS mapping_{t}" for t in lines.TYPES)


@query(
    f"{with_views('file_rows', 'snapshot_files', 'languages')}, {_MATRIX}, {_LEARN}, {_BY_TABLE}, ends AS (SELECT language, {', '.join(f'sum({t}_added - {t}_removed) AS {t}' for t in lines.TYPES)} FROM matrix GROUP BY 1), "
    f"own AS (SELECT language, {', '.join(f'sum({t}) AS {t}' for t in lines.TYPES)} FROM snapshot_files GROUP BY 1) SELECT coalesce(r.language, o.language, m.language) AS language, {_DRIFT} "
    "FROM ends r FULL JOIN own o ON o.language = r.language FULL JOIN by_table m ON m.language = coalesce(r.language, o.language)"
)
def reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    return lines.reconciliation(_matrix(spark, folder), snapshot_by_language(spark, folder), snapshot_by_table(spark, folder))


_ORDER = "placed AS (SELECT coalesce(m.language, s.language) AS language, CAST(row_number() OVER (ORDER BY s.code IS NULL, s.code DESC, coalesce(m.language, s.language)) AS INT) AS place FROM (SELECT DISTINCT language FROM matrix) m FULL JOIN (SELECT language, sum(code) AS code FROM snapshot_files GROUP BY 1) s ON s.language = m.language)"


@query(f"{with_views('file_rows', 'snapshot_files', 'languages')}, {_MATRIX}, {_ORDER} SELECT * FROM placed")
def language_order(spark: SparkSession, folder: str) -> DataFrame:
    return lines.language_order(_matrix(spark, folder), snapshot_by_language(spark, folder))


_RENAMES = "renames AS (SELECT s_suppkey AS seq, 'm' || CAST(s_suppkey % 40 AS STRING) AS old, 'n' || CAST(s_suppkey % 30 AS STRING) || CASE WHEN s_suppkey % 4 = 0 THEN '.py' ELSE '' END AS new, CASE s_suppkey % 3 WHEN 0 THEN 'Perl' WHEN 1 THEN NULL ELSE 'Shell' END AS old_language, CASE s_suppkey % 5 WHEN 0 THEN 'Python' WHEN 1 THEN NULL ELSE 'Shell' END AS new_language FROM supplier)"


def _renames(spark: SparkSession, folder: str) -> DataFrame:
    text = _RENAMES[len("renames AS (") : -1].replace("FROM supplier", "FROM {source}")
    return spark.sql(text, source=table(spark, folder, "supplier"))


_PLAN = f"""sides AS (SELECT seq * 2 AS ord, old AS path, old_language AS seen FROM renames UNION ALL SELECT seq * 2 + 1, new, new_language FROM renames),
    free AS (SELECT s.*, coalesce(e.language, 'Other') AS given FROM sides s LEFT JOIN languages e ON e.key = {_EXT.replace('path', 's.path')} WHERE '/' || s.path NOT IN (SELECT key FROM languages) AND s.path NOT IN (SELECT path FROM present)),
    learned AS (SELECT '/' || path AS key, arg_min(seen, ord) AS language FROM free WHERE seen <> '' AND seen <> given GROUP BY 1)"""


@query(f"{with_views('languages')}, {_RENAMES}, present AS (SELECT 'm' || CAST(s_suppkey % 40 AS STRING) AS path FROM supplier WHERE s_suppkey % 20 = 3), {_PLAN} SELECT key, language FROM learned")
def rename_learned(spark: SparkSession, folder: str) -> DataFrame:
    present = table(spark, folder, "supplier").where("s_suppkey % 20 = 3").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string")).alias("path"))
    return classify.rename_plan(_renames(spark, folder), view(spark, folder, "languages"), present)[0]


@query(
    f"{with_views('languages')}, {_RENAMES}, present AS (SELECT 'm' || CAST(s_suppkey % 40 AS STRING) AS path FROM supplier WHERE s_suppkey % 20 = 3), {_PLAN}, after AS (SELECT * FROM languages UNION ALL SELECT * FROM learned), "
    f"given AS (SELECT s.ord, coalesce(p.language, e.language, 'Other') AS g FROM sides s LEFT JOIN after p ON p.key = '/' || s.path LEFT JOIN after e ON e.key = {_EXT.replace('path', 's.path')}) "
    "SELECT r.seq FROM renames r JOIN given a ON a.ord = r.seq * 2 JOIN given b ON b.ord = r.seq * 2 + 1 WHERE coalesce(old_language, new_language) IS NOT NULL AND (old_language IS DISTINCT FROM new_language OR a.g <> b.g)"
)
def rename_changed(spark: SparkSession, folder: str) -> DataFrame:
    present = table(spark, folder, "supplier").where("s_suppkey % 20 = 3").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string")).alias("path"))
    return classify.rename_plan(_renames(spark, folder), view(spark, folder, "languages"), present)[1]


@query(
    f"{with_views('file_rows')}, drops AS (SELECT DISTINCT pos, path FROM file_rows WHERE pos % 10 = 0 AND path LIKE '%.py'), added AS (SELECT pos, 'added' AS section, path || 'x' AS path, code, comment, blank FROM file_rows WHERE pos % 10 = 0 AND path LIKE '%.py' AND section = 'added'), "
    "kept AS (SELECT f.* FROM file_rows f WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.pos = f.pos AND d.path = f.path) UNION ALL SELECT * FROM added) SELECT pos, section, path, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank FROM kept GROUP BY 1, 2, 3"
)
def rename_adjust(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "file_rows")
    hit = rows.where((F.col("pos") % 10 == 0) & F.col("path").endswith(".py"))
    added = hit.where("section = 'added'").withColumn("path", F.concat("path", F.lit("x")))
    return classify.adjust_rows(rows, hit.select("pos", "path"), added)


# Attribution


@query("SELECT doc_id, len(t) AS n_trailers, t[1] AS first_trailer FROM (SELECT doc_id, coalesce(regexp_extract_all(replace(text, chr(13), chr(10)), '(?im)^[ \\t]*Co-Authored-By:[ \\t]*(.+)$', 1), []) AS t FROM documents) WHERE len(t) > 0")
def trailer_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", attribution.trailers(F.col("text")).alias("t")).where(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("bigint").alias("n_trailers"), F.col("t")[0].alias("first_trailer"))


@query(
    "SELECT doc_id, name, local, domain FROM (SELECT doc_id, unnest(coalesce(regexp_extract_all(replace(text, chr(13), chr(10)), '(?im)^[ \\t]*Co-Authored-By:[ \\t]*(.+)$', 1), [])) AS t FROM documents) s, "
    "LATERAL (SELECT trim(regexp_replace(lower(t), '<[^<>]*>', ' ')) AS name, regexp_extract(lower(t), '<([^<>@]*)@', 1) AS local, regexp_extract(lower(t), '@([^<>@]*)>', 1) AS domain)"
)
def trailer_parts(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", F.explode(attribution.trailers(F.col("text"))).alias("t")).withColumn("p", attribution.trailer_parts(F.col("t")))
    return found.select("doc_id", "p.name", "p.local", F.col("p.domains")[0].alias("domain"))


@query(
    "SELECT doc_id, agent FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(t), '(^|[^0-9a-z]){n}([^0-9a-z]|$)') THEN '{a}'" for n, a in OWN_AGENTS) + " END AS agent FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(13), chr(10)), "
    "'(?im)^[ \\t]*Co-Authored-By:[ \\t]*(.+)$', 1)) AS t, generate_subscripts(regexp_extract_all(replace(text, chr(13), chr(10)), '(?im)^[ \\t]*Co-Authored-By:[ \\t]*(.+)$', 1), 1) AS n FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY agent IS NULL, n) = 1) WHERE agent IS NOT NULL"
)
def agent_detect(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.with_agent(table(spark, folder, "documents"), "text", OWN_AGENTS).where("agent IS NOT NULL").select("doc_id", "agent")


@query(f"{with_views('commits')} SELECT agent, {_SOURCE} AS source, count(*) AS n_commits, coalesce(agent <> '' AND agent <> 'Misc', false) AS is_ai FROM commits GROUP BY 1, 2, 4")
def agents_and_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = view(spark, folder, "commits").select("agent", attribution.source_for(F.col("agent")).alias("source"), attribution.is_ai(F.col("agent")).alias("is_ai"))
    return rows.groupBy("agent", "source", "is_ai").agg(F.count("*").alias("n_commits"))


@query(f"{with_views('commits')} SELECT agent, min(pos) AS first_pos, arg_min(local_date, pos) AS first_date FROM commits WHERE agent <> '' GROUP BY 1")
def first_appearances(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.first_appearances(view(spark, folder, "commits"))


@query(f"{with_views('commits')} SELECT first_date, string_agg(agent, ' + ' ORDER BY first_pos) AS label FROM (SELECT agent, min(pos) AS first_pos, arg_min(local_date, pos) AS first_date FROM commits WHERE agent <> '' GROUP BY 1) GROUP BY 1")
def annotations(spark: SparkSession, folder: str) -> DataFrame:
    return attribution.annotations(first_appearances(spark, folder))


@query(
    f"{with_views('commits')}, x AS (SELECT *, {_SOURCE} AS source FROM commits WHERE agent <> '' AND agent <> 'Misc') SELECT count(*) AS n_commits, array_to_string(list_sort(list_distinct(list(CASE WHEN source = 'copilot' THEN 'Copilot CLI' ELSE agent END))), ',') AS agents FROM x WHERE source IS NULL OR source NOT IN ('claude-code', 'codex')"
)
def unmeasured_agents(spark: SparkSession, folder: str) -> DataFrame:
    rated = spark.createDataFrame([("claude-code",), ("codex",)], "source string")
    return attribution.unmeasured_agents(view(spark, folder, "commits"), rated).withColumn("agents", F.array_join("agents", ","))


# Graph

_PR = "coalesce(TRY_CAST(nullif(regexp_extract(message, '^Merge pull request #(\\d+)\\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(message, '\\(#(\\d+)\\)\\s*$', 1), '') AS INT))"


@query(f"{with_views('commits')} SELECT pos, {_PR} AS pr FROM commits")
def pr_number(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "commits").select("pos", attribution.pr_number(F.col("message")).alias("pr"))


_MEMBERS = "tip AS (SELECT max(pos) AS t FROM commits), members AS (SELECT pos + 41 - pos % 41 AS merge_pos, pos FROM commits, tip WHERE pos > 0 AND pos % 41 BETWEEN 21 AND 40 AND pos + 41 - pos % 41 <= t)"


@query(f"{with_views('commits')}, {_MEMBERS} SELECT CAST(merge_pos AS BIGINT) AS merge_pos, pos FROM members")
def pr_members(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pr_members(dag(spark, folder), _tip(spark, folder))


def _tip(spark: SparkSession, folder: str) -> DataFrame:
    """The tip of the branch looked at: the last commit of the main line. Commits behind it are on branches not merged."""
    return dag(spark, folder).where("NOT off_line").agg(F.max("pos").alias("pos"))


@query(f"{with_views('commits')}, {_MEMBERS}, own AS (SELECT pos, {_PR} AS pr FROM commits WHERE pos > 0) SELECT o.pos, coalesce(o.pr, m.pr) AS pr FROM own o LEFT JOIN members b ON b.pos = o.pos LEFT JOIN own m ON m.pos = b.merge_pos")
def assign_prs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.assign_prs(dag(spark, folder), _tip(spark, folder))


@query(f"{with_views('commits')} SELECT coalesce(c.agent, CASE WHEN c.pos IS NULL THEN 'unattributed' ELSE 'human' END) AS agent, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem l LEFT JOIN commits c ON c.pos = l.l_orderkey + 7 GROUP BY 1")
def blame_by_agent(spark: SparkSession, folder: str) -> DataFrame:
    blame = table(spark, folder, "lineitem").select((F.col("l_orderkey") + 7).alias("pos"), F.col("l_linenumber").alias("lines"))
    return graph.blame_by_agent(blame, view(spark, folder, "commits"))


# Usage

_COUNT = "input, output, cache_read, cache_write"
_DAYS = f"days AS (SELECT source, day, coalesce(nullif(model, ''), 'unknown') AS model, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in [*U.COUNTERS, 'turns'])} FROM calls WHERE day <> '' AND greatest({_COUNT}) > 0 GROUP BY 1, 2, 3)"


@query(f"{with_views('calls')}, {_DAYS} SELECT * FROM days")
def archive_by_day_model(spark: SparkSession, folder: str) -> DataFrame:
    return archive.by_day_model(view(spark, folder, "calls"))


@query(f"{with_views('calls')} SELECT * FROM calls WHERE call_key IS NULL UNION ALL SELECT * FROM calls WHERE call_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY seq) = 1")
def dedup_calls(spark: SparkSession, folder: str) -> DataFrame:
    return archive.first_of_key(view(spark, folder, "calls"), "call_key", ["seq"])


_TOTALS = "totals AS (SELECT source, day, CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS tokens, CAST(sum(turns) AS BIGINT) AS turns FROM days GROUP BY 1, 2 HAVING sum(input + output + cache_read + cache_write) > 0)"


@query(f"{with_views('calls')}, {_DAYS}, {_TOTALS} SELECT * FROM totals")
def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    return archive.totals(archive_by_day_model(spark, folder))


@query(
    f"{with_views('calls')}, {_DAYS}, old AS (SELECT source, day, model, input * (CAST(right(day, 2) AS BIGINT) % 3) AS input, output, cache_read, cache_write, turns, 1 AS old FROM days), both_ AS (SELECT *, 0 AS old FROM days UNION ALL SELECT * FROM old), "
    "sums AS (SELECT source, day, old, sum(input + output + cache_read + cache_write) AS t FROM both_ GROUP BY 1, 2, 3), best AS (SELECT source, day, old FROM sums QUALIFY row_number() OVER (PARTITION BY source, day ORDER BY t DESC, old DESC) = 1) "
    "SELECT b.source, b.day, model, input, output, cache_read, cache_write, turns FROM both_ b JOIN best USING (source, day, old)"
)
def archive_merge(spark: SparkSession, folder: str) -> DataFrame:
    scanned = archive_by_day_model(spark, folder)
    return archive.merge_larger(scanned.withColumn("input", F.col("input") * (F.substring("day", 9, 2).cast("bigint") % 3)), scanned)


@query(f"{with_views('calls')}, {_DAYS} SELECT source, model FROM (SELECT source, model, sum(input + output + cache_read + cache_write) AS t FROM days GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY t DESC, model) = 1")
def top_model(spark: SparkSession, folder: str) -> DataFrame:
    return archive.top_model(archive_by_day_model(spark, folder))


_SERIES = f"""held AS (SELECT * FROM totals),
    mine AS (SELECT c.pos, {_SOURCE} AS source, utc_day AS day, h.churn FROM commits c JOIN churn h ON h.pos = c.pos WHERE agent <> '' AND agent <> 'Misc'),
    worked AS (SELECT source, day, sum(churn) AS churn FROM mine WHERE source IN (SELECT source FROM held) GROUP BY 1, 2),
    both_ AS (SELECT coalesce(t.source, w.source) AS source, coalesce(t.day, w.day) AS day, t.tokens, w.churn FROM held t FULL JOIN worked w ON w.source = t.source AND w.day = t.day),
    rate AS (SELECT source, CASE WHEN sum(churn) > 0 THEN CAST(sum(tokens) AS DOUBLE) / sum(churn) ELSE 0.0 END AS ratio FROM both_ WHERE tokens IS NOT NULL GROUP BY 1),
    series AS (SELECT source, day, coalesce(tokens, CAST(round_even(ratio * churn, 0) AS BIGINT)) AS tokens, CASE WHEN tokens IS NULL THEN 'e' ELSE 'm' END AS kind FROM both_ JOIN rate USING (source) WHERE tokens IS NOT NULL OR (churn > 0 AND ratio > 0))"""
_ALL = f"{with_views('calls', 'commits', 'file_rows', 'languages')}, {_DAYS}, {_TOTALS}, {_MATRIX}, {_CHURN}, {_SERIES}"


def _worked(spark: SparkSession, folder: str) -> DataFrame:
    """Commits with their churn; written once because several operators read it."""
    return materialise(view(spark, folder, "commits").join(churn_per_commit(spark, folder), "pos"), "worked")


@query(f"{_ALL} SELECT * FROM series")
def source_series(spark: SparkSession, folder: str) -> DataFrame:
    return archive.source_series(source_totals(spark, folder), _worked(spark, folder))


@query(f"{_ALL} SELECT day, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN max(kind = 'e') THEN 'e' ELSE 'm' END AS kind FROM series GROUP BY 1".replace("max(kind = 'e')", "bool_or(kind = 'e')"))
def token_per_day_combined(spark: SparkSession, folder: str) -> DataFrame:
    return archive.combined_series(source_series(spark, folder))


_SHARES = "shares AS (SELECT m.pos, m.source, CAST(round_even(CAST(s.tokens * m.churn AS DOUBLE) / sum(m.churn) OVER (PARTITION BY m.source, m.day), 0) AS BIGINT) AS tokens, s.kind FROM mine m JOIN series s ON s.source = m.source AND s.day = m.day WHERE m.churn > 0)"


@query(f"{_ALL}, {_SHARES} SELECT * FROM shares")
def commit_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each AI commit, measured or estimated."""
    worked = _worked(spark, folder)
    return archive.commit_shares(archive.source_series(source_totals(spark, folder), worked), worked)


@query(f"{_ALL}, {_SHARES} SELECT pos, CAST(sum(tokens) AS BIGINT) AS tokens, max(kind) AS kind FROM shares GROUP BY 1")
def tokens_by_commit(spark: SparkSession, folder: str) -> DataFrame:
    return commit_shares(spark, folder).groupBy("pos").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.max("kind").alias("kind"))


@query(
    f"{_ALL}, sums AS (SELECT source, CAST(coalesce(sum(tokens) FILTER (kind = 'm'), 0) AS BIGINT) AS measured_total, count(*) FILTER (kind = 'm') AS measured_days, CAST(coalesce(sum(tokens) FILTER (kind = 'e'), 0) AS BIGINT) AS estimated_total, min(day) FILTER (kind = 'm') AS coverage_start FROM series GROUP BY 1), "
    "covered AS (SELECT m.source, CAST(sum(churn) AS BIGINT) AS covered_churn FROM mine m JOIN series s ON s.source = m.source AND s.day = m.day AND s.kind = 'm' GROUP BY 1), top AS (SELECT source, model FROM (SELECT source, model, sum(input + output + cache_read + cache_write) AS t FROM days GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY t DESC, model) = 1) "
    "SELECT s.*, coalesce(covered_churn, 0) AS covered_churn, model AS top_model FROM sums s LEFT JOIN covered c USING (source) LEFT JOIN top USING (source)"
)
def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    worked = _worked(spark, folder)
    return archive.source_summary(archive.source_series(source_totals(spark, folder), worked), archive_by_day_model(spark, folder), worked)


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS model FROM events")
def carry_forward_model(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "events").withColumns({"m": F.when(F.col("event_id") % 5 == 0, F.col("event_type")), "tie": F.lit(0)})
    return archive.carry_forward(named, ["user_id"], "event_id", "tie", "m", "model").select("event_id", "model")


@query("SELECT l.l_orderkey, l.l_linenumber, r.upstream FROM (SELECT *, [CAST(l_partkey % 5 AS INT), CAST(l_suppkey % 7 AS INT), CAST(l_linenumber AS INT)] AS v FROM lineitem) l ASOF LEFT JOIN (SELECT [CAST(n_nationkey % 5 AS INT), CAST(n_regionkey AS INT), 0] AS since, max(n_name) AS upstream FROM nation GROUP BY 1) r ON l.v >= r.since")
def asof_release(spark: SparkSession, folder: str) -> DataFrame:
    number = lambda *c: F.array(*(x.cast("int") for x in c))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", number(F.col("l_partkey") % 5, F.col("l_suppkey") % 7, F.col("l_linenumber")).alias("v"))
    releases = table(spark, folder, "nation").select(number(F.col("n_nationkey") % 5, F.col("n_regionkey"), F.lit(0)).alias("since"), "n_name")
    return archive.as_of(rows, "v", releases, "since", "n_name", "upstream").drop("v")


@query("SELECT row_id, strftime(make_timestamp(CAST(time_updated AS BIGINT) * 1000), '%Y-%m-%d') AS day FROM message WHERE time_updated > 0 UNION ALL SELECT row_id, '' FROM message WHERE NOT coalesce(time_updated > 0, false)")
def day_ms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "message").select("row_id", U.day_ms(F.col("time_updated")).alias("day"))


def _day_sql(c: str) -> str:
    """UTC day of a stamp: with a numeric offset moved by it, else its first ten characters; '' for no ISO date."""
    offset = f"(CASE WHEN regexp_extract({c}, '([+-])\\d{{2}}(:?\\d{{2}})?$', 1) = '-' THEN -1 ELSE 1 END * (CAST(regexp_extract({c}, '[+-](\\d{{2}})(:?\\d{{2}})?$', 1) AS INT) * 60 + coalesce(TRY_CAST(regexp_extract({c}, '[+-]\\d{{2}}:?(\\d{{2}})$', 1) AS INT), 0)))"
    moved = f"strftime(TRY_CAST(replace(left({c}, 16), 'T', ' ') || ':00' AS TIMESTAMP) - to_minutes({offset}), '%Y-%m-%d')"
    return (
        f"CASE WHEN {c} IS NULL OR NOT regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN '' "
        f"WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)? ?[+-]\\d{{2}}(:?\\d{{2}})?$') THEN coalesce({moved}, left({c}, 10)) ELSE left({c}, 10) END"
    )


@query(f"SELECT row_id, {_day_sql('created_at')} AS day FROM assistant_usage_events")
def utc_day(spark: SparkSession, folder: str) -> DataFrame:
    """UTC day of every usage event."""
    return table(spark, folder, "assistant_usage_events").select("row_id", U.utc_day(F.coalesce("created_at", F.lit(""))).alias("day"))


_ID = "regexp_extract(id, '^[a-zA-Z]+_([0-9a-fA-F]{12})', 1)"
_RAW = f"CAST('0x' || {_ID} AS BIGINT)"


@query(
    f"WITH t AS (SELECT row_id, time_updated AS c, {_RAW} >> 12 AS a, (281474976710655 - {_RAW}) >> 12 AS b FROM message WHERE {_ID} <> ''), g AS (SELECT row_id, c, ((a - c) % 68719476736 + 68719476736) % 68719476736 AS x, ((b - c) % 68719476736 + 68719476736) % 68719476736 AS y FROM t) "
    "SELECT row_id, coalesce(c > 0 AND least(x, 68719476736 - x) > 60000 AND least(y, 68719476736 - y) > 60000, false) AS is_copy FROM g"
)
def fork_copy_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "message").where(F.size(U.minted_ms(F.col("id"))) > 0)
    return rows.select("row_id", U.fork_copy(F.col("id"), F.col("time_updated")).alias("is_copy"))


@query(
    "WITH k AS (SELECT * FROM assistant_usage_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1), d AS (SELECT *, coalesce(input_tokens, 0) - coalesce(cache_read_tokens, 0) - coalesce(cache_write_tokens, 0) AS fresh, "
    "TRY_CAST(list_filter(CAST(CASE WHEN json_valid(token_details_json) THEN token_details_json END AS JSON[]), lambda x: json_extract_string(x, '$.tokenType') = 'input')[-1]->>'$.tokenCount' AS BIGINT) AS own FROM k) "
    "SELECT CAST(id AS VARCHAR) AS call_key, greatest(0, fresh) AS input, greatest(0, coalesce(output_tokens, 0)) AS output, greatest(0, coalesce(cache_read_tokens, 0)) AS cache_read, greatest(0, coalesce(cache_write_tokens, 0)) AS cache_write FROM d WHERE own IS NULL OR own = fresh"
)
def copilot_store_usage(spark: SparkSession, folder: str) -> DataFrame:
    return agents.copilot_store_calls(table(spark, folder, "assistant_usage_events")).select("call_key", *U.COUNTERS)


def _whole_sql(j: str, path: str) -> str:
    return f"CASE WHEN json_type({j}, '$.{path}') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string({j}, '$.{path}') AS BIGINT) END"


_SEEN = ("input", "output", "cache_read", "cache_write")
_GROWN = " OR ".join(f"s.{c} > f.seen_{c}" for c in _SEEN)
_FELL = " OR ".join(f"s.{c} < f.seen_{c}" for c in _SEEN)
_STATE = f"CASE WHEN NOT s.valid THEN 'invalid' WHEN s.day = '' THEN 'undated' WHEN NOT ({_GROWN}) THEN 'stale' WHEN {_FELL} THEN 'broken' ELSE 'added' END"
_SNAPSHOTS = f"""WITH RECURSIVE cl AS (SELECT file_path, line_no, file_seq, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM copilot_lines QUALIFY row_number() OVER (PARTITION BY file_path, line_no ORDER BY row_id) = 1),
    cx AS (SELECT file_path, line_no, coalesce(file_seq, 0) AS file_seq, CASE WHEN file_seq IS NULL THEN file_path END AS alone, regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS folder, json_extract_string(j, '$.type') AS kind, nullif(json_extract_string(j, '$.data.sessionId'), '') AS sid,
        nullif(json_extract_string(j, '$.data.copilotVersion'), '') AS version, coalesce(json_extract_string(j, '$.timestamp'), '') AS stamp, CASE WHEN json_type(j, '$.data.modelMetrics') = 'OBJECT' THEN json_extract(j, '$.data.modelMetrics') END AS metrics FROM cl WHERE j IS NOT NULL),
    cn AS (SELECT *, count(*) FILTER (kind = 'session.start' AND sid IS NULL) OVER (PARTITION BY file_path ORDER BY line_no) AS unnamed FROM cx),
    co AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'session.start' THEN coalesce(sid, folder || CASE WHEN unnamed > 1 THEN '#' || (unnamed - 1) ELSE '' END) END IGNORE NULLS) OVER w,
        last_value(CASE WHEN kind = 'session.resume' THEN folder END IGNORE NULLS) OVER w) AS session FROM cn WINDOW w AS (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    ck AS (SELECT *, unnest(json_keys(metrics)) AS model FROM co WHERE kind = 'session.shutdown' AND session IS NOT NULL),
    cm AS (SELECT *, json_extract(metrics, '$."' || model || '"') AS m FROM ck),
    ci AS (SELECT session, model, file_seq, alone, line_no, {_day_sql('stamp')} AS day, coalesce({_whole_sql('m', 'usage.inputTokens')}, 0) AS i, coalesce({_whole_sql('m', 'usage.outputTokens')}, 0) AS o, coalesce({_whole_sql('m', 'usage.cacheReadTokens')}, 0) AS r,
        coalesce({_whole_sql('m', 'usage.cacheWriteTokens')}, 0) AS w, greatest(0, {_whole_sql('m', 'requests.count')}) AS n_calls, {_whole_sql('m', 'requests.count')} IS NULL AS no_calls, {_whole_sql('m', 'tokenDetails.input.tokenCount')} AS own FROM cm WHERE json_type(m) = 'OBJECT'),
    cs AS (SELECT session, model, day, greatest(0, i - r - w) AS input, greatest(0, o) AS output, greatest(0, r) AS cache_read, greatest(0, w) AS cache_write, CASE WHEN NOT no_calls THEN n_calls END AS calls, coalesce(own = i - r - w, true) AS valid,
        row_number() OVER (PARTITION BY session, model ORDER BY file_seq, alone, line_no) AS n FROM ci),
    fold AS (SELECT DISTINCT session, model, CAST(0 AS BIGINT) AS n, '' AS day, '' AS state, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in (*_SEEN, 'turns', *(f'seen_{c}' for c in _SEEN), 'seen_calls'))} FROM cs
        UNION ALL SELECT session, model, n, day, state, {', '.join(f"CASE WHEN state = 'added' THEN {c} - seen_{c} ELSE 0 END" for c in _SEEN)}, CASE WHEN state <> 'added' THEN 0 WHEN calls IS NULL THEN 1 ELSE greatest(0, calls - seen_calls) END,
        {', '.join(f"CASE WHEN state = 'added' THEN {c} ELSE seen_{c} END" for c in _SEEN)}, CASE WHEN state = 'added' THEN coalesce(calls, seen_calls) ELSE seen_calls END
        FROM (SELECT s.*, {', '.join(f'f.seen_{c}' for c in (*_SEEN, 'calls'))}, {_STATE} AS state FROM fold f JOIN cs s ON s.session = f.session AND s.model = f.model AND s.n = f.n + 1)),
    added AS (SELECT session, model, day, state, input, output, cache_read, cache_write, turns FROM fold WHERE n > 0)"""
_BY_DAY = f"day, coalesce(nullif(model, ''), 'unknown') AS model, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in (*_SEEN, 'turns'))}"


@query(f"{_SNAPSHOTS} SELECT 'copilot' AS source, {_BY_DAY} FROM added WHERE state = 'added' AND day <> '' AND greatest(input, output, cache_read, cache_write) > 0 GROUP BY 2, 3")
def copilot_log_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage that the cumulative snapshots of the logs add, by day and model."""
    return archive.by_day_model(agents.copilot_log_calls(table(spark, folder, "copilot_lines")))


@query(f"{_SNAPSHOTS} SELECT state, count(*) AS n_snapshots, CAST(sum(turns) AS BIGINT) AS turns FROM added GROUP BY 1")
def cumulative_states(spark: SparkSession, folder: str) -> DataFrame:
    """How many snapshots added something, were stale, broken, undated or invalid."""
    states = archive.cumulative_increase(agents.copilot_snapshots(table(spark, folder, "copilot_lines")))
    return states.groupBy("state").agg(F.count("*").alias("n_snapshots"), F.sum("turns").cast("bigint").alias("turns"))


_SIDES = f"""{_SNAPSHOTS},
    rk AS (SELECT * FROM assistant_usage_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1 OR id IS NULL),
    rd AS (SELECT *, coalesce(input_tokens, 0) - coalesce(cache_read_tokens, 0) - coalesce(cache_write_tokens, 0) AS fresh,
        TRY_CAST(list_filter(CAST(CASE WHEN json_valid(token_details_json) THEN token_details_json END AS JSON[]), lambda x: json_extract_string(x, '$.tokenType') = 'input')[-1]->>'$.tokenCount' AS BIGINT) AS own FROM rk),
    stored AS (SELECT session_id AS session, {_day_sql('created_at')} AS day, model, greatest(0, fresh) AS input, greatest(0, coalesce(output_tokens, 0)) AS output, greatest(0, coalesce(cache_read_tokens, 0)) AS cache_read, greatest(0, coalesce(cache_write_tokens, 0)) AS cache_write, 1 AS turns
        FROM rd WHERE own IS NULL OR own = fresh),
    both_ AS (SELECT 'logs' AS side, split_part(session, '#', 1) AS base, day, model, input, output, cache_read, cache_write, turns FROM added WHERE state = 'added' UNION ALL SELECT 'rows', session, day, model, input, output, cache_read, cache_write, turns FROM stored),
    sizes AS (SELECT base, coalesce(sum(input + output + cache_read + cache_write) FILTER (side = 'logs'), 0) AS in_logs, coalesce(sum(input + output + cache_read + cache_write) FILTER (side = 'rows'), 0) AS in_rows FROM both_ WHERE day <> '' GROUP BY 1),
    vers AS (SELECT coalesce(sid, folder) AS base, arg_min(version, (file_path, line_no)) AS version FROM cx WHERE kind = 'session.start' AND version IS NOT NULL GROUP BY 1),
    sides AS (SELECT s.base, CASE WHEN list_transform(regexp_extract_all(split_part(coalesce(v.version, ''), '-', 1), '\\d+'), lambda x: CAST(x AS INT))[1:3] >= [1, 0, 69] THEN CASE WHEN h.base IS NOT NULL THEN 'rows' ELSE 'held' END
        WHEN h.base IS NULL THEN 'logs' WHEN in_rows >= in_logs THEN 'rows' ELSE 'logs' END AS side FROM sizes s LEFT JOIN vers v USING (base) LEFT JOIN (SELECT DISTINCT session_id AS base FROM assistant_usage_events WHERE session_id IS NOT NULL) h ON h.base = s.base)"""


@query(f"{_SIDES} SELECT 'copilot' AS source, {_BY_DAY} FROM both_ b WHERE (side = 'rows' AND base IS NULL OR EXISTS (SELECT 1 FROM sides s WHERE s.base = b.base AND s.side = b.side)) AND day <> '' AND greatest(input, output, cache_read, cache_write) > 0 GROUP BY 2, 3")
def copilot_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage of the logs and of the usage table by day and model, each session from one of the two."""
    calls, _ = agents.copilot_calls(table(spark, folder, "copilot_lines"), table(spark, folder, "assistant_usage_events"))
    return archive.by_day_model(calls)


def _host_path_sql(c: str) -> str:
    """host/path of a remote in any spelling, in lower case; NULL for what is no remote."""
    host = f"CASE WHEN regexp_matches({c}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)', 1) ELSE regexp_extract({c}, '^(?:[^@/:]+@)?([^/:@]+):', 1) END"
    path = f"regexp_replace(regexp_replace(CASE WHEN regexp_matches({c}, '://') THEN regexp_extract({c}, '://[^/]*/(.*)$', 1) ELSE regexp_extract({c}, '^[^:]*:(.*)$', 1) END, '\\.git/*$', ''), '/+$', '')"
    return f"lower({host} || '/' || {path})"


def _repos(spark: SparkSession, folder: str) -> DataFrame:
    remote = P.parse_remote(F.col("remote"))
    return table(spark, folder, "projects").select(F.col("project").alias("repo"), "root_dir", F.concat_ws("/", remote["host"], remote["path"]).alias("remote"), "project_hash", F.array(P.remote_project_id(F.concat_ws("/", remote["host"], remote["path"]))).alias("ids"))


_REPOS = f"repos AS (SELECT project AS repo, root_dir, {_host_path_sql('remote')} AS own, project_hash FROM projects)"
_INSIDE = "(path = root_dir OR starts_with(path, root_dir || '/'))"


@query(
    f"WITH {_REPOS}, v AS (SELECT CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM codex_lines), s AS (SELECT DISTINCT json_extract_string(j, '$.payload.id') AS session, json_extract_string(j, '$.payload.cwd') AS path, {_host_path_sql("json_extract_string(j, '$.payload.git.repository_url')")} AS url "
    f"FROM v WHERE json_extract_string(j, '$.payload.id') <> '' AND json_extract_string(j, '$.payload.cwd') IS NOT NULL) SELECT DISTINCT session, repo FROM s JOIN repos ON url = own OR ((url IS NULL OR own IS NULL) AND {_INSIDE})"
)
def codex_membership(spark: SparkSession, folder: str) -> DataFrame:
    """The repositories each rollout session ran on."""
    rec = json_object(F.col("raw"), "payload struct<id:string,cwd:string,git:struct<repository_url:string,commit_hash:string>>")["payload"]
    url = P.parse_remote(F.col("p.git.repository_url"))
    sessions = table(spark, folder, "codex_lines").select(rec.alias("p")).where("p.id <> '' AND p.cwd IS NOT NULL").select(F.col("p.id").alias("session"), F.col("p.cwd").alias("cwd"), F.concat_ws("/", url["host"], url["path"]).alias("url"), F.col("p.git.commit_hash").alias("sha")).distinct()
    return membership.belonging(sessions, _repos(spark, folder), key="session", paths=["cwd"], remote="url", commits=["sha"])


@query(f"WITH {_REPOS} SELECT DISTINCT file_path, repo FROM gemini_lines JOIN repos ON json_extract_string(CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END, '$.projectHash') = sha256(root_dir)")
def gemini_membership(spark: SparkSession, folder: str) -> DataFrame:
    """The repositories of each chat session, by the hash of the folder it ran in."""
    sessions = table(spark, folder, "gemini_lines").select("file_path", json_object(F.col("raw"), "projectHash string")["projectHash"].alias("hash")).where("hash IS NOT NULL").distinct()
    return membership.belonging_by_hash(sessions, _repos(spark, folder).select("repo", F.col("root_dir").alias("path")), key="file_path", hash_="hash")


# Transcripts and telemetry: lines as their clients write them, made of the events.

_TRANSCRIPTS = "tr AS (SELECT event_id, '/h/-w-' || (user_id % 40) || '/s' || user_id || CASE WHEN event_id % 5 = 0 THEN '/subagents/agent-1.jsonl' ELSE '.jsonl' END AS file_path, '/h/-w-' || (user_id % 40) AS folder, CASE WHEN event_id % 9 <> 0 THEN 'k' || (event_id % 4000) END AS id, CASE WHEN event_id % 101 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS day, event_type AS model, CAST(floor(value * 100) AS BIGINT) AS input, event_id % 50 AS output FROM events)"


def _transcripts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    path = F.concat(F.lit("/h/-w-"), (F.col("user_id") % 40).cast("string"), F.lit("/s"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "/subagents/agent-1.jsonl").otherwise(".jsonl"))
    usage = F.struct(F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"))
    message = F.struct(F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("k"), (F.col("event_id") % 4000).cast("string"))).alias("id"), F.col("event_type").alias("model"), usage.alias("usage"))
    stamp = F.when(F.col("event_id") % 101 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return e.select(path.alias("file_path"), F.col("event_id").alias("line_no"), F.col("event_id").alias("row_id"), F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), message.alias("message"))).alias("raw"))


@query(
    f"WITH {_TRANSCRIPTS}, w AS (SELECT '/h/-w-' || n_nationkey AS folder, '2024-01-0' || (1 + n_nationkey % 9) AS since, CASE WHEN n_nationkey % 3 = 0 THEN '2024-01-20' END AS until FROM nation), "
    "i AS (SELECT * FROM tr WHERE day <> '' AND EXISTS (SELECT 1 FROM w WHERE w.folder = tr.folder AND day >= since AND (until IS NULL OR day <= until))) "
    "SELECT id AS call_key, file_path AS session, day, model, input, output FROM i WHERE id IS NULL UNION ALL (SELECT id, file_path, day, model, input, output FROM i WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_path, event_id) = 1)"
)
def transcript_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of transcripts in the windows of their folders, sub-agents under the folder of their session."""
    n = F.col("n_nationkey")
    windows = table(spark, folder, "nation").select(F.concat(F.lit("/h/-w-"), n.cast("string")).alias("folder"), F.concat(F.lit("2024-01-0"), (1 + n % 9).cast("string")).alias("since"), F.when(n % 3 == 0, "2024-01-20").alias("until"))
    return agents.transcript_calls(_transcripts(spark, folder), windows).select("call_key", "session", "day", "model", "input", "output")


@query(
    "WITH t AS (SELECT event_id, coalesce(CASE WHEN event_id % 9 <> 0 THEN 'u' || (event_id % 3000) END, '/c/' || user_id || '.jsonl:' || event_id) AS key, '/c/' || user_id || '.jsonl' AS file_path, strftime(ts, '%Y-%m-%d') AS day, event_id % 70 AS i, event_id % 50 AS o, event_id % 13 AS c, event_id % 11 AS th, "
    "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN event_id % 70 + event_id % 50 END AS total, CASE WHEN event_id % 2 = 0 THEN 'openai' ELSE 'other' END AS auth FROM events), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_path DESC, event_id DESC) = 1), "
    "f AS (SELECT *, CASE WHEN coalesce(total, 0) = 0 AND auth = 'openai' THEN i + o ELSE total END AS sum FROM l) SELECT key AS call_key, day, greatest(0, i - c) AS input, o + CASE WHEN coalesce(sum = i + o, false) THEN 0 ELSE th END AS output, c AS cache_read FROM f"
)
def telemetry_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of telemetry chats: the last write of each id, totals that are missing or 0 taken from the login type."""
    n = F.col("event_id")
    event = F.struct(F.lit(agents.EVENT).alias("event.name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event.timestamp"), F.col("event_type").alias("model"), F.when(n % 2 == 0, "openai").otherwise("other").alias("auth_type"), (n % 70).alias("input_token_count"), (n % 50).alias("output_token_count"), (n % 13).alias("cached_content_token_count"), (n % 11).alias("thoughts_token_count"), F.when(n % 4 == 0, 0).when(n % 4 == 1, n % 70 + n % 50).alias("total_token_count"))
    uuid = F.when(n % 9 != 0, F.concat(F.lit("u"), (n % 3000).cast("string")))
    raw = F.to_json(F.struct(uuid.alias("uuid"), F.struct(event.alias("uiEvent")).alias("systemPayload")))
    lines_ = table(spark, folder, "events").select(F.concat(F.lit("/c/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file_path"), n.alias("line_no"), n.alias("row_id"), raw.alias("raw"))
    return agents.telemetry_calls(lines_).select("call_key", "day", "input", "output", "cache_read")


# Measuring


@query(f"{with_views('commits')}, d AS (SELECT *, CASE WHEN is_merge THEN 'merge' WHEN pos % 7 = 0 THEN 'held' ELSE 'todo' END AS plan FROM commits) SELECT pos, CASE WHEN plan = 'todo' AND count(*) FILTER (plan = 'todo') OVER (ORDER BY pos) > 5000 THEN 'pending' ELSE plan END AS plan FROM d")
def plan_measuring(spark: SparkSession, folder: str) -> DataFrame:
    """What a run does with each commit when it may measure 5,000; every seventh is in the cache."""
    commits = view(spark, folder, "commits")
    return measuring.plan_measuring(commits, commits.where("pos % 7 = 0").select("pos"), 5000)


@query(f"{with_views('commits', 'file_rows')} SELECT pos, CASE WHEN is_merge THEN 'merge' WHEN EXISTS (SELECT 1 FROM file_rows f WHERE f.pos = c.pos AND section = 'added') THEN 'ok' WHEN pos % 11 = 0 THEN 'failed' ELSE 'pending' END AS status FROM commits c")
def commit_status(spark: SparkSession, folder: str) -> DataFrame:
    commits = view(spark, folder, "commits")
    return measuring.commit_status(commits, view(spark, folder, "file_rows").where("section = 'added'").select("pos"), commits.where("pos % 11 = 0").select("pos"))


_KEPT = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens", "cache_write_input_tokens")


def _tally_sql(path: str) -> str:
    """A struct of counters as one text; NULL where none is an integer."""
    cells = ", ".join(f"coalesce(CAST({_whole_sql('j', f'{path}.{c}')} AS VARCHAR), '-')" for c in _KEPT)
    return f"nullif(concat_ws('|', {cells}), '{'|'.join('-' * len(_KEPT))}')"


_USED = ", ".join(f"coalesce({_whole_sql('j', f'payload.usage.{c}')}, {_whole_sql('j', f'payload.info.last_token_usage.{c}')}, 0) AS {n}" for c, n in zip(("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens"), "iorw", strict=True))
_UUID7 = "'^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'"
_CODEX_CALLS = f"""WITH l AS (SELECT file_path, line_no, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM codex_lines QUALIFY row_number() OVER (PARTITION BY file_path, line_no ORDER BY row_id) = 1),
    x AS (SELECT file_path, line_no, json_extract_string(j, '$.type') AS kind, coalesce(json_extract_string(j, '$.timestamp'), '') AS stamp, nullif(json_extract_string(j, '$.payload.id'), '') AS id, nullif(json_extract_string(j, '$.payload.forked_from_id'), '') AS parent,
        json_extract_string(j, '$.payload.type') AS ptype, nullif(json_extract_string(j, '$.payload.response_id'), '') AS call_key, nullif(json_extract_string(j, '$.payload.turn_id'), '') AS turn, nullif(json_extract_string(j, '$.payload.model'), '') AS named,
        {_tally_sql('payload.info.total_token_usage')} AS total, {_tally_sql('payload.info.last_token_usage')} AS last, {_USED} FROM l),
    h AS (SELECT * FROM (SELECT file_path, kind, id AS session, parent AS forked_from FROM x QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY line_no) = 1) WHERE kind = 'session_meta'),
    m AS (SELECT x.*, session, forked_from, x.kind = 'token_usage_record' AS is_record, coalesce(x.kind = 'event_msg' AND ptype = 'token_count' AND total IS NOT NULL AND last IS NOT NULL, false) AS is_event FROM x JOIN h USING (file_path)),
    w AS (SELECT *, last_value(CASE WHEN kind = 'turn_context' THEN named END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS last_model,
        last_value(CASE WHEN is_event THEN total END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        max(CASE WHEN kind = 'turn_context' AND regexp_matches(turn, {_UUID7}) THEN turn END) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest,
        min(CASE WHEN is_record THEN line_no END) OVER (PARTITION BY file_path) AS first_record FROM m),
    t AS (SELECT file_path, turn, named AS of_turn FROM m WHERE kind = 'turn_context' AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path, turn ORDER BY line_no DESC) = 1),
    c AS (SELECT w.*, CASE WHEN is_record THEN coalesce(of_turn, last_model) ELSE last_model END AS model, total || ' ' || last AS pair,
        coalesce(forked_from IS NOT NULL AND regexp_matches(session, {_UUID7}) AND NOT coalesce(latest > session, false), false) AS inherited
        FROM w LEFT JOIN t ON is_record AND t.file_path = w.file_path AND t.turn = w.turn WHERE is_record OR (is_event AND total IS DISTINCT FROM before)),
    best AS (SELECT file_path, session FROM (SELECT h.file_path, session, count(c.file_path) AS n FROM h LEFT JOIN (SELECT file_path FROM c) c ON c.file_path = h.file_path GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY coalesce(session, file_path) ORDER BY n DESC, file_path) = 1),
    mine AS (SELECT * FROM c WHERE file_path IN (SELECT file_path FROM best)),
    e AS (SELECT *, CASE WHEN forked_from IN (SELECT session FROM best WHERE session IS NOT NULL) THEN (forked_from, pair) IN (SELECT (session, pair) FROM mine WHERE is_event AND session IS NOT NULL) ELSE inherited END AS copied FROM mine WHERE is_event),
    kept AS (SELECT *, min(CASE WHEN NOT coalesce(copied, false) THEN line_no END) OVER (PARTITION BY file_path) AS first_own FROM e),
    counted AS (SELECT call_key, file_path, session, stamp, model, i, o, r, w FROM mine WHERE is_record AND call_key IS NULL
        UNION ALL (SELECT call_key, file_path, session, stamp, model, i, o, r, w FROM mine WHERE is_record AND call_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY call_key ORDER BY file_path, line_no) = 1)
        UNION ALL SELECT NULL, file_path, session, stamp, model, i, o, r, w FROM kept WHERE line_no >= first_own AND (first_record IS NULL OR line_no < first_record)),
    calls AS (SELECT call_key, coalesce(session, file_path) AS session, {_day_sql('stamp')} AS day, model, greatest(0, i - r - w) AS input, greatest(0, o) AS output, greatest(0, r) AS cache_read, greatest(0, w) AS cache_write FROM counted)"""


@query(f"{_CODEX_CALLS} SELECT * FROM calls")
def codex_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of the rollouts: usage records, once by response id, and the events before them."""
    return agents.codex_calls(table(spark, folder, "codex_lines")).select("call_key", "session", "day", "model", *U.COUNTERS)


@query(f"{_CODEX_CALLS} SELECT 'codex' AS source, day, coalesce(nullif(model, ''), 'unknown') AS model, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in U.COUNTERS)}, count(*) AS turns FROM calls WHERE day <> '' AND greatest(input, output, cache_read, cache_write) > 0 GROUP BY 2, 3")
def codex_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage of the rollouts by day and model, records and the events before them."""
    return archive.by_day_model(agents.codex_calls(table(spark, folder, "codex_lines")))


_CHAT_WRITES = (
    "WITH g AS (SELECT file_path, line_no, row_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM gemini_lines), w AS (SELECT file_path, line_no, 0 AS part, -1 AS pos, row_id, CAST(j AS JSON) AS m FROM g UNION ALL "
    "SELECT file_path, line_no, 1, k, row_id, j->('$.\"$set\".messages[' || k || ']') FROM (SELECT *, unnest(range(coalesce(json_array_length(j, '$.\"$set\".messages'), 0)::BIGINT)) AS k FROM g) UNION ALL "
    "SELECT file_path, line_no, 2, k, row_id, j->('$.messages[' || k || ']') FROM (SELECT *, unnest(range(coalesce(json_array_length(j, '$.messages'), 0)::BIGINT)) AS k FROM g)), "
    "l AS (SELECT * FROM w WHERE m->>'$.type' = 'gemini' AND m->>'$.id' <> '' AND json_type(m, '$.tokens') = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY m->>'$.id' ORDER BY file_path DESC, line_no DESC, part DESC, pos DESC, row_id DESC) = 1), "
    "n AS (SELECT m->>'$.id' AS k, " + ", ".join(f"greatest(0, coalesce(CAST(m->'$.tokens.{c}' AS BIGINT), 0)) AS {c[0]}{c[1]}" for c in ("input", "output", "cached", "thoughts", "tool")) + ", CAST(m->'$.tokens.total' AS BIGINT) AS total FROM l) "
)


@query(_CHAT_WRITES + "SELECT k AS call_key, greatest(0, inp - ca) + too AS input, ou + CASE WHEN coalesce(total IN (inp + ou, inp + ou + too), false) THEN 0 ELSE th END AS output, ca AS cache_read, CAST(0 AS BIGINT) AS cache_write FROM (SELECT k, \"in\" AS inp, ou, ca, th, \"to\" AS too, total FROM n)")
def latest_write_per_id(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of each chat message by its last write that has tokens."""
    return agents.chat_calls(table(spark, folder, "gemini_lines")).select("call_key", *U.COUNTERS)


@query()
def opencode_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage of the message store by day and model, under the rules of each session's release.

    The ids of these tables hold their time in another way than the stores' own, so none is taken for a fork's copy.
    Days are those of the instants of p1_found; calls whose stamp names none are under the day ``undated``.
    """
    instants = normal_stamps(spark, folder, "message").select("row_id", "utc_us")
    messages = table(spark, folder, "message").join(instants, "row_id", "left")
    calls = agents.store_calls(messages, table(spark, folder, "opencode_session"), drop_forks=False)
    return archive.by_day_model(calls.withColumn("day", F.when(F.col("day") == "", "undated").otherwise(F.col("day"))))


# Paths


@query(
    "WITH x AS (SELECT project, remote, CASE WHEN regexp_matches(remote, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(regexp_extract(remote, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)', 1)) ELSE lower(regexp_extract(remote, '^(?:[^@/:]+@)?([^/:@]+):', 1)) END AS host, "
    "CASE WHEN regexp_matches(remote, '://') THEN regexp_extract(remote, '://[^/]*/(.*)$', 1) ELSE regexp_extract(remote, '^[^:]*:(.*)$', 1) END AS p FROM projects WHERE remote IS NOT NULL) SELECT project, host, regexp_replace(regexp_replace(p, '\\.git/*$', ''), '/+$', '') AS path, sha1('git-remote:' || host || '/' || regexp_replace(regexp_replace(p, '\\.git/*$', ''), '/+$', '')) AS project_id FROM x"
)
def parse_remote(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "projects").where("remote IS NOT NULL").select("project", P.parse_remote(F.col("remote")).alias("r")).select("project", "r.*")
    return rows.withColumn("project_id", P.remote_project_id(F.concat_ws("/", "host", "path")))


@query("SELECT project, sha256(root_dir) AS own_hash, sha256(root_dir) = project_hash AS same, regexp_replace(root_dir, '[^a-zA-Z0-9]', '-', 'g') AS log_dir, regexp_extract(root_dir, '[^/]*$') || '-' || left(sha256(root_dir), 12) AS cache_key FROM projects")
def project_ids(spark: SparkSession, folder: str) -> DataFrame:
    root = F.col("root_dir")
    return table(spark, folder, "projects").select("project", F.sha2(root, 256).alias("own_hash"), (F.sha2(root, 256) == F.col("project_hash")).alias("same"), P.project_dir(root).alias("log_dir"), P.cache_key(root).alias("cache_key"))


# Page

_SEL = f"{with_views('commits', 'file_rows', 'languages')}, {_MATRIX}, sel AS (SELECT c.pos, c.local_date, c.agent, c.message, c.is_merge, CAST(coalesce(a, 0) AS BIGINT) AS added, CAST(coalesce(r, 0) AS BIGINT) AS removed, CAST(coalesce(a, 0) - coalesce(r, 0) AS BIGINT) AS net FROM commits c LEFT JOIN (SELECT pos, sum(code_added + comment_added + blank_added) AS a, sum(code_removed + comment_removed + blank_removed) AS r FROM matrix GROUP BY 1) m ON m.pos = c.pos)"
_CUM = "cum AS (SELECT *, CAST(sum(net) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM sel)"


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    return page.selection(_matrix(spark, folder), view(spark, folder, "commits"))


@query(f"{_SEL}, {_CUM} SELECT pos, added, removed, net, cumulative FROM cum")
def selection_stats(spark: SparkSession, folder: str) -> DataFrame:
    return page.cumulative(_selected(spark, folder)).select("pos", "added", "removed", "net", "cumulative")


@query(f"{with_views('commits', 'file_rows', 'languages')}, {_MATRIX} SELECT c.pos, CAST(coalesce(test_code_added, 0) AS BIGINT) AS added, CAST(coalesce(test_code_removed, 0) AS BIGINT) AS removed FROM commits c LEFT JOIN matrix m ON m.pos = c.pos AND m.language = 'Go'")
def selection_tests(spark: SparkSession, folder: str) -> DataFrame:
    chosen = page.selection(_matrix(spark, folder), view(spark, folder, "commits"), "Go", "code", tests_only=True)
    return chosen.select("pos", "added", "removed")


@query(f"{_SEL} SELECT coalesce(nullif(agent, ''), 'Human') AS agent, count(*) AS n_commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(net) AS BIGINT) AS net FROM sel GROUP BY 1")
def by_agent(spark: SparkSession, folder: str) -> DataFrame:
    return page.by_agent(_selected(spark, folder))


@query(f"{_SEL} SELECT local_date, CAST(sum(net) AS BIGINT) AS net, CAST(sum(sum(net)) OVER (ORDER BY local_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM sel GROUP BY 1")
def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    return page.daily(_selected(spark, folder))


@query(f"{_SEL} SELECT pos, net FROM sel WHERE NOT is_merge ORDER BY net DESC, pos LIMIT 25")
def top_gains(spark: SparkSession, folder: str) -> DataFrame:
    return page.extremes(_selected(spark, folder), True, 25)


@query(f"{_SEL} SELECT pos, net FROM sel WHERE NOT is_merge ORDER BY net, pos LIMIT 15")
def top_drops(spark: SparkSession, folder: str) -> DataFrame:
    return page.extremes(_selected(spark, folder), False, 15)


@query(f"{_SEL}, {_CUM} SELECT pos, local_date, cumulative FROM cum ORDER BY cumulative DESC, pos LIMIT 1")
def peak(spark: SparkSession, folder: str) -> DataFrame:
    return page.peak(_selected(spark, folder))


_MONTHS = f"{with_views('commits')}, d AS (SELECT *, CAST(date_trunc('month', local_date) AS DATE) AS month, {_PR} AS pr FROM commits WHERE local_date IS NOT NULL), span AS (SELECT min(local_date) AS a, max(local_date) AS b FROM d), months AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(date_trunc('month', b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month, a, b FROM span), act AS (SELECT m.month, coalesce(n, 0) AS n_commits, coalesce(p, 0) AS n_prs, m.month >= a AND last_day(m.month) <= b AS is_full FROM months m LEFT JOIN (SELECT month, count(*) AS n FROM d GROUP BY 1) c USING (month) LEFT JOIN (SELECT month, count(*) AS p FROM (SELECT pr, min(month) AS month FROM d WHERE pr IS NOT NULL GROUP BY 1) GROUP BY 1) q USING (month))"


@query(f"{_MONTHS} SELECT * FROM act")
def monthly_activity(spark: SparkSession, folder: str) -> DataFrame:
    return page.monthly_activity(view(spark, folder, "commits"))


@query(f"{_MONTHS}, used AS (SELECT *, is_full OR NOT (SELECT bool_or(is_full) FROM act) AS used FROM act) SELECT (SELECT month FROM act ORDER BY n_commits DESC, month LIMIT 1) AS most_month, max(n_commits) AS most, (SELECT month FROM used WHERE used ORDER BY n_commits, month LIMIT 1) AS fewest_month, min(n_commits) FILTER (used) AS fewest, avg(n_commits) FILTER (used) AS average FROM used")
def activity_summary(spark: SparkSession, folder: str) -> DataFrame:
    return page.activity_summary(page.monthly_activity(view(spark, folder, "commits")))


@query(f"{_SEL} SELECT CAST(date_trunc('month', local_date) AS DATE) AS month, count(*) AS n_commits, count(*) FILTER (agent <> '' AND agent <> 'Misc') AS n_ai_commits, CAST(sum(added) AS BIGINT) AS added, CAST(coalesce(sum(added) FILTER (agent <> '' AND agent <> 'Misc'), 0) AS BIGINT) AS ai_added FROM sel WHERE NOT is_merge AND local_date IS NOT NULL GROUP BY 1")
def hero_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return page.hero_monthly(_selected(spark, folder))


@query(f"{with_views('file_rows', 'languages')}, {_MATRIX} SELECT pos, " + ", ".join(f"CAST(coalesce(sum(code_added - code_removed) FILTER (language = '{x}'), 0) AS BIGINT) AS net_{x.lower()}" for x in ("Python", "Go", "Ruby", "Other")) + " FROM matrix GROUP BY 1")
def lang_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return page.language_pivot(_matrix(spark, folder), ["Python", "Go", "Ruby", "Other"])


@query(f"{_SEL} SELECT pos, local_date, agent, message, is_merge, added, removed, net FROM sel WHERE contains(lower(message), 'round') AND coalesce(nullif(agent, ''), 'Human') IN ('Human', 'Codex') ORDER BY local_date DESC, pos DESC LIMIT 500")
def commit_table_search(spark: SparkSession, folder: str) -> DataFrame:
    return page.search(_selected(spark, folder), "ROUND", ["Human", "Codex"])


@query(f"{_SEL} SELECT pos, local_date, agent, message, is_merge, added, removed, net FROM sel WHERE contains(lower(message), 'round') AND coalesce(nullif(agent, ''), 'Human') IN ('Human', 'Codex') ORDER BY added + removed DESC, pos DESC LIMIT 500")
def commit_table_by_churn(spark: SparkSession, folder: str) -> DataFrame:
    return page.search(_selected(spark, folder), "ROUND", ["Human", "Codex"], sort="churn")


@query(f"{with_views('commits', 'file_rows', 'languages')}, {_MATRIX}, n AS (SELECT pos, sum(test_code_added + test_comment_added + test_blank_added - test_code_removed - test_comment_removed - test_blank_removed) AS net FROM matrix GROUP BY 1) SELECT c.pos, CAST(sum(coalesce(net, 0)) OVER (ORDER BY c.pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM commits c LEFT JOIN n ON n.pos = c.pos")
def test_cumulative(spark: SparkSession, folder: str) -> DataFrame:
    """Running net of test lines."""
    return page.test_cumulative(_matrix(spark, folder), view(spark, folder, "commits"))


@query()
def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every commit as the page's JSON tuple."""
    return page.page_rows(_selected(spark, folder), _matrix(spark, folder), language_order(spark, folder))


@query("SELECT n, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 999950 THEN printf('%.1fK', round_even(n / 1e2, 0) / 10) ELSE printf('%.1fM', round_even(n / 1e5, 0) / 10) END AS shown FROM (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)")
def compact_numbers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.floor("o_totalprice").cast("bigint").alias("n")).distinct()
    return rows.withColumn("shown", P.compact(F.col("n")))


# Documents and windows


@query(f"{with_views('calls')}, {_DAYS} SELECT source, day, model, input, output, cache_read, cache_write, CAST(sum(turns) OVER (PARTITION BY source, day) AS BIGINT) AS turns FROM days")
def archive_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The archive written as one document a day and read back; turns are those of the source's whole day."""
    days = documents.archive_days(archive_by_day_model(spark, folder))
    whole = days.select(F.concat(F.lit('{"version":2,"days":{"'), "day", F.lit('":'), "document", F.lit("}}")).alias("t"))
    return documents.read_archives(whole, "t")


_WINDOWS = """stored AS (SELECT '/w/' || CAST(c_custkey AS STRING) AS path, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-0' || CAST(1 + c_custkey % 9 AS STRING) END AS since, CASE WHEN c_custkey % 5 = 0 THEN '2024-01-2' || CAST(c_custkey % 9 AS STRING) END AS until FROM customer),
    live AS (SELECT '/w/' || CAST(s_suppkey * 7 AS STRING) AS path, '2024-02-01' AS since FROM supplier)"""


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    stored, live = (part.strip() for part in _WINDOWS.split("live AS ("))
    stored = stored[len("stored AS (") :].rstrip(",").removesuffix(")").replace("FROM customer", "FROM {source}")
    old = spark.sql(stored, source=table(spark, folder, "customer"))
    now = spark.sql(live.removesuffix(")").replace("FROM supplier", "FROM {source}"), source=table(spark, folder, "supplier"))
    return documents.session_windows(old, now, "2024-03-01")


_NOW = "windows AS (SELECT coalesce(s.path, l.path) AS path, CASE WHEN l.path IS NOT NULL AND (s.path IS NULL OR s.until IS NOT NULL) THEN l.since ELSE s.since END AS since, CASE WHEN l.path IS NOT NULL THEN NULL WHEN s.until IS NULL THEN '2024-03-01' ELSE s.until END AS until FROM stored s FULL JOIN live l ON l.path = s.path)"


@query(f"WITH {_WINDOWS}, {_NOW} SELECT * FROM windows")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _windows(spark, folder)


@query(f"WITH {_WINDOWS}, {_NOW} SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM windows w WHERE w.path = '/w/' || CAST(e.user_id AS STRING) AND (since IS NULL OR CAST(CAST(ts AS DATE) AS STRING) >= since) AND (until IS NULL OR CAST(CAST(ts AS DATE) AS STRING) <= until))")
def calls_in_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.concat(F.lit("/w/"), F.col("user_id").cast("string")).alias("p"), F.col("ts").cast("date").cast("string").alias("d"))
    return documents.in_windows(rows, "p", "d", _windows(spark, folder)).select("event_id")


@query("SELECT event_id, CAST(event_id * 127 AS BIGINT) AS number, event_type AS text FROM events")
def protobuf_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and texts of messages in wire format, decoded without a descriptor."""
    hexed = lambda c: F.lpad(F.hex(c), 2, "0")
    number = F.col("event_id") * 127
    groups = [(F.shiftright(number, 7 * k) % 128 + 128).cast("bigint") for k in range(4)]
    varint = F.concat(*(hexed(g) for g in groups), hexed(F.shiftright(number, 28) % 128))
    blob = F.unhex(F.concat(F.lit("08"), varint, F.lit("12"), hexed(F.length("event_type").cast("bigint")), F.hex(F.encode("event_type", "UTF-8"))))
    fields = proto_fields(F.col("blob"))
    read = table(spark, folder, "events").select("event_id", blob.alias("blob")).select("event_id", fields.alias("f"))
    return read.select("event_id", field_number(F.col("f"), 1).alias("number"), F.decode(field_bytes(F.col("f"), 2), "UTF-8").alias("text"))
