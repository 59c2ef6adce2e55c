import pytest

from commitlake.operators import documents

STORED = "path string, since string, until string"


def test_versions(spark):
    texts = [
        '{"version": 1, "days": {"d1": {"turns": 3, "models": {"m": {"input": 1, "output": 2, "cache_read": 3, "cache_write": 4}}}}}',
        '{"version": 2, "days": {"d2": {"codex": {"turns": 1, "models": {"n": {"input": 5}}}, "gemini": {"turns": 2, "models": {}}}}}',
    ]
    got = sorted((r["source"], r["day"], r["model"], r["turns"], r["input"]) for r in documents.read_archives(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect())
    assert got == [("claude-code", "d1", "m", 3, 1), ("codex", "d2", "n", 1, 5)]


@pytest.mark.parametrize("text", ['{"version": 3, "days": {}}', "", '{"version": 2, "days": {', "[]"])
def test_anything_else_fails(spark, text):
    with pytest.raises(Exception, match="not a token archive"):
        documents.read_archives(spark.createDataFrame([(text,)], "t string"), "t").collect()


def test_session_windows(spark):
    stored = spark.createDataFrame([("/a", None, None), ("/b", "2026-01-01", None), ("/c", "2026-01-01", "2026-01-05"), ("/d", None, "2026-01-05"), ("rel", None, None), ("/bad", "soon", None)], STORED)
    live = spark.createDataFrame([("/a", None), ("/c", "2026-02-01"), ("/new", "2026-02-02"), (None, None)], "path string, since string")
    got = sorted((r["path"], r["since"], r["until"]) for r in documents.session_windows(stored, live, "2026-03-01").collect())
    assert got == [("/a", None, None), ("/b", "2026-01-01", "2026-03-01"), ("/c", "2026-02-01", None), ("/d", None, "2026-01-05"), ("/new", "2026-02-02", None)]
    rows = spark.createDataFrame([(1, "/b", "2025-12-31"), (2, "/b", "2026-03-01"), (3, "/b", "2026-03-02"), (4, "/a", "1999-01-01"), (5, None, "2026-01-01")], "i int, p string, d string")
    windows = documents.session_windows(stored, live, "2026-03-01")
    assert sorted(r["i"] for r in documents.in_windows(rows, "p", "d", windows).collect()) == [2, 4]


def test_empty(spark):
    none = spark.createDataFrame([], STORED)
    assert documents.session_windows(none, none.select("path", "since"), "2026-03-01").count() == 0
