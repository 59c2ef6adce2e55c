"""Hand-computed cases of the history and usage rules."""

import pytest
from pyspark.sql import functions as F

from commitlake.functions import paths as P
from commitlake.functions import usage as U
from commitlake.operators import archive, attribution, classify, graph, lines, page


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_agents_of_trailers(spark):
    bodies = [
        "Fix\n\nCo-Authored-By: Claude Opus 4.6 (1M context) <noreply@a.example>",
        "co-authored-by: Claude 3.5 Sonnet <x@y.example>",
        "Co-Authored-By: claude <x@y.example>",
        "Co-Authored-By: Codexterous <a@b.example>",
        "Co-Authored-By: Someone <codex@b.example>",
        "Co-Authored-By: x <a@antigravity-drones.example>",
        "Co-Authored-By: x <a@antigravity.dev>",
        "Co-Authored-By: qwen-coder-plus <a@b.example>",
        "Co-Authored-By: Qwen-Coder <a@b.example>",
        "Co-Authored-By: opencode-agent[bot] <a@b.example>",
        "Co-Authored-By: Jane <jane@b.example>\nCo-Authored-By: Copilot <c@b.example>",
        "Co-Authored-By: Jane <jane@b.example> (was kim@opencode.ai)",
        "Not a trailer: Co-Authored-By: Codex",
        "Co-Authored-By: Jules <j@b.example>",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = [r["agent"] for r in attribution.with_agent(df, "body", [("jules", "Jules")]).orderBy("i").collect()]
    assert got == ["Claude Opus 4.6 (1M)", "Claude Sonnet 3.5", "Claude (unknown version)", None, "Codex", None, "Antigravity", None, "Qwen Code", "OpenCode GitHub agent", "Copilot", None, None, "Jules", None, None]


def test_pull_request_numbers(spark):
    got = column(spark, ["Merge pull request #12 from a", "Add x (#7)", "Add x (#7) later", "See #7", "Merge pull request #99999999999 x", None], attribution.pr_number)
    assert got == [12, 7, None, None, None, None]


def test_extensions_and_tests(spark):
    assert column(spark, ["a/b.PY", ".gitignore", "a.", "x/.hidden.txt", "Makefile", None], P.extension) == ["py", None, "", "txt", None, None]
    paths = ["a/tests/x.c", "a/Test/x.c", "WinterUITests/a.swift", "spec/a.rb", "specs/a.md", "x_test.go", "test_a.py", "a/contest.py", "conftest.py", "a.spec.ts", "a.spec.md", "FooTest.java", "Footest.java", "a\\tests\\b.c", "latest/x.c", None]
    assert column(spark, paths, classify.TestRules().is_test) == [True, True, True, True, False, True, True, False, True, True, False, True, False, True, False, False]
    rules = classify.TestRules(include=["qa/**"], exclude=["**/gen/*.py"], replace=True)
    assert column(spark, ["qa/a/b.c", "qa/gen/x.py", "tests/a.c", "gen/x.py"], rules.is_test) == [True, False, False, False]


def test_remotes_and_formats(spark):
    remotes = ["https://Git.Forge.example/a/b.git", "git@forge.example:a/b", "ssh://git@H.example:22/a/b/", "forge.example:single", "/local/path", None]
    got = column(spark, remotes, P.parse_remote)
    assert [None if g is None else (g["host"], g["path"]) for g in got] == [("git.forge.example", "a/b"), ("forge.example", "a/b"), ("h.example", "a/b"), None, None, None]
    assert column(spark, ["file:///a%20b/c+d", "http://x/y", None], P.local_path) == ["/a b/c+d", None, None]
    assert column(spark, [950, 1250, 999_949, 999_950, 3_400_000], P.compact, "long") == ["950", "1.2K", "999.9K", "1.0M", "3.4M"]
    assert column(spark, [0.2, 242.0, 3780.0], P.duration, "double") == ["0.2s", "4m02s", "1h03m"]
    assert column(spark, ["/work/agent-sample"], lambda c: F.sha2(c, 256))[0].startswith("d431f508")


def test_days(spark):
    stamps = ["2026-09-01T00:30:00+02:00", "2026-09-01T00:30:00Z", "2026-09-01T99:00", "20260901T003000", "2026-09-01", None]
    assert column(spark, stamps, lambda c: U.utc_day(F.coalesce(c, F.lit("")))) == ["2026-08-31", "2026-09-01", "2026-09-01", "", "2026-09-01", ""]
    assert column(spark, [1_788_219_000_000, 0, -5, None], U.day_ms, "long") == ["2026-08-31", "", "", ""]


def test_counters(spark):
    assert column(spark, ["12", "1.5", "true", '"12"', "-3", None, "99999999999999999999"], U.json_count) == [12, 0, 0, 0, -3, 0, 0]
    one = spark.range(1)
    inclusive = one.select(U.inclusive(F.lit(100), F.lit(7), F.lit(120), F.lit(5)).alias("c")).first()["c"]
    assert tuple(inclusive) == (0, 7, 120, 5)
    chat = lambda **t: tuple(one.select(U.chat_counters(F.struct(*(F.lit(t.get(k)).cast("bigint").alias(k) for k in ("input", "output", "cached", "thoughts", "tool", "total")))).alias("c")).first()["c"])
    assert chat(input=10, output=5, cached=4, thoughts=3, tool=2, total=20) == (8, 8, 4, 0)
    assert chat(input=10, output=5, cached=4, thoughts=3, tool=2, total=17) == (8, 5, 4, 0)

    def store(version, provider, model, i, o, r, cr, cw, total=None):
        tokens = F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in (("input", i), ("output", o), ("reasoning", r), ("total", total))), F.struct(F.lit(cr).cast("bigint").alias("read"), F.lit(cw).cast("bigint").alias("write")).alias("cache"))
        return tuple(one.select(U.store_counters(tokens, F.lit(provider), F.lit(model), U.version(F.lit(version))).alias("c")).first()["c"])

    assert store("1.0.50", "openai", "gpt", 100, 10, 4, 60, 0) == (40, 10, 60, 0)
    assert store("1.0.50", "anthropic", "claude-x", 100, 10, 4, 60, 0) == (100, 10, 60, 0)
    assert store("1.3.5", "anthropic", "claude-x", 100, 10, 0, 60, 20) == (20, 10, 60, 20)
    assert store("1.3.16", "openai", "gpt", 100, 10, 4, 60, 0) == (100, 14, 60, 0)
    assert store("1.2.0", "google", "gemini-x", 100, 10, 4, 0, 0) == (100, 14, 0, 0)
    assert store("1.14.0", "openai", "gpt", 100, 10, 4, 0, 0, total=110) == (100, 10, 0, 0)
    assert store(None, "openai", "gpt", 100, 10, 0, 60, 0) == (40, 10, 60, 0)


def test_versions_and_copies(spark):
    assert column(spark, ["1.14.2-beta3", "v1.4", "", None], U.version) == [[1, 14, 2], [1, 4], [], []]
    minted = f"msg_{((1_790_000_000_000 % (1 << 36)) << 12):012x}abc"
    rows = spark.createDataFrame([(minted, 1_790_000_030_000), (minted, 1_790_000_090_000), ("odd", 5), (minted, 0)], "id string, ms long")
    assert [r["x"] for r in rows.select(U.fork_copy(F.col("id"), F.col("ms")).alias("x")).collect()] == [False, True, False, False]


SNAPSHOT = "source string, session string, model string, at long, day string, input long, output long, cache_read long, cache_write long, calls long, valid boolean"


def test_cumulative_snapshots(spark):
    rows = [("c", "s", "m", *r) for r in [(1, "d1", 10, 1, 0, 0, 2, True), (2, "d1", 10, 1, 0, 0, 2, True), (3, "d2", 30, 3, 5, 0, 4, True), (4, "d2", 40, 2, 5, 0, 9, True), (5, "", 50, 5, 5, 0, 9, True), (6, "d3", 45, 4, 5, 0, None, True), (7, "d3", 60, 4, 5, 0, 5, False), (8, "d4", 46, 4, 5, 0, 6, True)]]
    got = archive.cumulative_increase(spark.createDataFrame(rows, SNAPSHOT)).orderBy("day", "input").collect()
    by_state = sorted((r["state"], r["day"], r["input"], r["turns"]) for r in got)
    assert by_state == [("added", "d1", 10, 2), ("added", "d2", 20, 2), ("added", "d3", 15, 1), ("added", "d4", 1, 2), ("broken", "d2", 0, 0), ("invalid", "d3", 0, 0), ("stale", "d1", 0, 0), ("undated", "", 0, 0)]
    assert archive.cumulative_increase(spark.createDataFrame([], SNAPSHOT)).count() == 0


def test_archive_never_shrinks(spark):
    schema = "source string, day string, model string, input long, output long, cache_read long, cache_write long, turns long"
    old = spark.createDataFrame([("a", "d1", "m", 10, 0, 0, 0, 1), ("b", "d1", "m", 5, 0, 0, 0, 1), ("a", "d3", "m", 4, 0, 0, 0, 7)], schema)
    new = spark.createDataFrame([("a", "d1", "n", 9, 0, 0, 0, 1), ("b", "d1", "n", 4, 2, 0, 0, 1), ("a", "d2", "m", 1, 0, 0, 0, 1), ("a", "d3", "n", 4, 0, 0, 0, 1)], schema)
    got = sorted((r["source"], r["day"], r["model"], r["turns"]) for r in archive.merge_larger(old, new).collect())
    assert got == [("a", "d1", "m", 1), ("a", "d2", "m", 1), ("a", "d3", "m", 7), ("b", "d1", "n", 1)]
    again = archive.merge_larger(archive.merge_larger(old, new), new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, archive.merge_larger(old, new).collect()))


def test_estimates_and_shares(spark):
    """Two AI days, one human day, one archived day: 50 covered lines and 5,000 tokens rate the other day's 100 lines."""
    commits = spark.createDataFrame([(1, "Codex", "d1", 30), (2, "Codex", "d1", 20), (3, "Codex", "d2", 100), (4, None, "d3", 70), (5, "Misc", "d1", 5)], "pos long, agent string, utc_day string, churn long")
    totals = spark.createDataFrame([("codex", "d1", 5000)], "source string, day string, tokens long")
    series = archive.source_series(totals, commits).cache()
    assert sorted((r["day"], r["tokens"], r["kind"]) for r in series.collect()) == [("d1", 5000, "m"), ("d2", 10_000, "e")]
    shares = sorted((r["pos"], r["tokens"], r["kind"]) for r in archive.commit_shares(series, commits).collect())
    assert shares == [(1, 3000, "m"), (2, 2000, "m"), (3, 10_000, "e")]


def test_merge_ownership(spark):
    """1-2-5-7 is the main line; 5 merges 3-4 and 7 merges 6, which merged 4 before."""
    rows = [(1, [], "a"), (2, [1], "b"), (3, [1], "c (#9)"), (4, [3], "d"), (5, [2, 4], "Merge pull request #5 from x"), (6, [4, 99], "e"), (7, [5, 6], "Merge branch x")]
    commits = spark.createDataFrame(rows, "pos long, parents array<long>, message string")
    assert sorted(map(tuple, graph.pr_members(commits).collect())) == [(5, 3), (5, 4), (7, 6)]
    assert sorted(map(tuple, graph.assign_prs(commits).collect())) == [(1, None), (2, None), (3, 9), (4, 5), (5, 5), (6, None), (7, None)]


def test_owners_over_long_and_forked_branches(spark):
    """Against plain reachability: a long side branch, branches that fork and meet, and commits that are not merged."""
    rows = [(1, [])] + [(n, [n - 1]) for n in range(2, 40)]  # a branch of 38 commits
    rows += [(40, [1]), (41, [40]), (42, [40]), (43, [41, 42]), (44, [43]), (45, [44]), (46, [44])]
    rows += [(50, [1]), (51, [50, 39]), (52, [51, 46]), (53, [52, 45]), (54, [44])]
    commits = spark.createDataFrame([(n, p, "x") for n, p in rows], "pos long, parents array<long>, message string")
    parents = dict(rows)
    chain, at = [], 53
    while at:
        chain.append(at)
        at = parents[at][0] if parents[at] else None
    want = {}
    for top in sorted(chain):
        todo = [top]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = top
                todo.extend(parents[n])
    tip = spark.createDataFrame([(53,)], "pos long")
    assert {r["pos"]: r["owner"] for r in graph.owners(commits, tip).collect()} == want
    assert 54 not in want


def test_porcelain(spark):
    text = f"{'a' * 40} 1 1 2\nauthor x\n\tline\n{'a' * 40} 2 2\n\tline\n{'b' * 40} 3 3 1\n\t{'c' * 40} 1 1"
    df = spark.createDataFrame([("f", text)], "path string, porcelain string")
    assert sorted((r["hash"][0], r["lines"]) for r in graph.parse_porcelain(df, "porcelain", ["path"]).collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("block", [2, 4096])
def test_running_sums_and_fill_over_blocks(spark, block):
    df = spark.createDataFrame([("k", i, i % 3, "v" if i == 1 else None, 0) for i in range(9)] + [("o", 5, None, None, 0), (None, 1, 2, "n", 0)], "k string, at long, n long, v string, tie int")
    got = {(r["k"], r["at"]): r["total"] for r in lines.running_sum(df.where("k IS NOT NULL"), ["k"], "at", {"total": F.col("n")}, block).collect()}
    assert got["k", 8] == 9 and got["k", 4] == 4 and got["o", 5] == 0
    filled = {(r["k"], r["at"]): r["last"] for r in archive.carry_forward(df, ["k"], "at", "tie", "v", "last", block).collect()}
    assert (filled["k", 0], filled["k", 1], filled["k", 8], filled["o", 5], filled[None, 1]) == (None, "v", "v", None, "n")


def test_extension_table_and_activity(spark):
    table = classify.parse_extension_table(spark.createDataFrame([(1, "PY  Python"), (2, "h C/C++ Header"), (3, "py Snake"), (4, "alone"), (5, "")], "n int, line string"), "line", "n")
    assert sorted(map(tuple, table.collect())) == [("h", "C/C++ Header"), ("py", "Snake")]
    days = ["2026-01-15", "2026-02-01", "2026-02-03", "2026-04-30"]
    commits = spark.createDataFrame([(d, "x (#1)") for d in days] + [(None, "y (#2)")], "d string, message string").select(F.col("d").cast("date").alias("local_date"), "message")
    months = page.monthly_activity(commits).orderBy("month").collect()
    assert [(str(r["month"]), r["n_commits"], r["n_prs"], r["is_full"]) for r in months] == [("2026-01-01", 1, 1, False), ("2026-02-01", 2, 0, True), ("2026-03-01", 0, 0, True), ("2026-04-01", 1, 0, True)]
    summary = page.activity_summary(page.monthly_activity(commits)).first()
    assert (str(summary["most_month"]), summary["most"], str(summary["fewest_month"]), summary["fewest"], summary["average"]) == ("2026-02-01", 2, "2026-03-01", 0, 1.0)
    assert page.monthly_activity(commits.limit(0)).count() == 0
