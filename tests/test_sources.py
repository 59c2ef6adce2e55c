"""Data sources, log readers and the streaming archive on small files."""

import json
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from commitlake.functions import protobuf
from commitlake.operators.archive import by_day_model
from commitlake.sources import agents, git, numbered, sqlite
from commitlake.streaming import usage


def lines(spark, *records, path="f/s.jsonl"):
    rows = [(path, i, 1, i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(records, 1)]
    return spark.createDataFrame(rows, "file_path string, line_no long, file_seq int, row_id long, raw string")


def calls(df):
    return sorted((r["call_key"], r["day"], r["model"], r["input"], r["output"], r["cache_read"], r["cache_write"]) for r in df.collect())


def test_numbered_lines(spark, tmp_path):
    import zstandard

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text("one\r\ntwo still\n\nfour")
    (tmp_path / "y.jsonl.zst").write_bytes(zstandard.compress(b"zipped\nlines\n"))
    (tmp_path / "bad.jsonl.zst").write_bytes(b"no frame")
    numbered.register(spark)
    rows = spark.read.format("numbered_lines").option("path", f"{tmp_path}/**/*.jsonl*").load().collect()
    got = sorted((r["file_path"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in rows)
    assert got == [("bad.jsonl.zst", 0, None), ("x.jsonl", 1, "one"), ("x.jsonl", 2, "two still"), ("x.jsonl", 3, ""), ("x.jsonl", 4, "four"), ("y.jsonl.zst", 1, "zipped"), ("y.jsonl.zst", 2, "lines")]
    assert [r["error"] is not None for r in rows if r["line_no"] == 0] == [True]


def test_sqlite(spark, tmp_path):
    for name, extra in (("a", ""), ("b", ", model TEXT")):
        with sqlite3.connect(tmp_path / f"{name}.db") as db:
            db.execute(f"CREATE TABLE usage (id INTEGER, data TEXT{extra})")
            db.execute(f"INSERT INTO usage VALUES (1, '{name}'{', 5' if extra else ''})")
            db.execute(f"INSERT INTO usage VALUES ('odd', NULL{', NULL' if extra else ''})")
    (tmp_path / "c.db").write_bytes(b"not a database at all, really not")
    sqlite.register(spark)
    df = spark.read.format("sqlite").option("path", f"{tmp_path}/*.db").option("dbtable", "usage").load()
    assert df.columns == ["store_path", "store_error", "id", "data"]
    got = sorted((r["store_path"][-4:], r["id"], r["data"], r["store_error"] is None) for r in df.collect() if r["data"] or r["store_error"])
    assert got == [("a.db", 1, "a", True), ("b.db", 1, "b", True), ("c.db", None, None, False)]


def test_git(spark, tmp_path):
    def run(*args):
        env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@b.example", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@b.example", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_CONFIG_NOSYSTEM": "1"}
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True, env=env)

    run("init", "-q", "-b", "main")
    (tmp_path / "a b.txt").write_text("one\ntwo\n")
    run("add", "-A")
    run("commit", "-q", "-m", "First\n\nbody line\nCo-Authored-By: Codex <c@d.example>")
    run("mv", "a b.txt", "c.txt")
    run("commit", "-q", "-m", "Rename (#3)")
    git.register(spark)
    load = lambda name: spark.read.format(name).option("path", str(tmp_path)).load()
    log = load("gitlog").orderBy("pos").collect()
    assert [(r["message"], len(r["parents"])) for r in log] == [("First", 0), ("Rename (#3)", 1)]
    assert "Codex" in log[0]["body"]
    renamed = load("gitchanges").where(F.col("status").startswith("R")).collect()
    assert [(r["old"], r["new"]) for r in renamed] == [("a b.txt", "c.txt")]
    assert [(r["path"], r["mode"]) for r in load("gittree").collect()] == [("c.txt", "100644")]
    from commitlake.operators.graph import parse_porcelain

    blamed = parse_porcelain(load("gitblame"), "porcelain", ["path"]).collect()
    assert [(r["path"], r["hash"], r["lines"]) for r in blamed] == [("c.txt", log[0]["hash"], 2)]


def test_codex(spark):
    use = lambda i, o, c=0: {"input_tokens": i, "output_tokens": o, "cached_input_tokens": c}
    event = lambda total, last, at="2026-01-02T00:00:00Z": {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": use(*total), "last_token_usage": use(*last)}}}
    meta = lambda i, parent=None: {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": i, "forked_from_id": parent}}
    turn = {"type": "turn_context", "payload": {"turn_id": "t1", "model": "m1"}}
    record = lambda key, i: {"timestamp": "2026-01-02T00:00:00Z", "type": "token_usage_record", "payload": {"response_id": key, "turn_id": "t1", "usage": use(i, 2, 1)}}
    first = lines(spark, meta("p"), turn, event((5, 1), (5, 1)), event((5, 1), (5, 1)), event((9, 2), (4, 1)), path="f/a.jsonl")
    fork = lines(spark, meta("q", "p"), event((5, 1), (5, 1)), event((9, 2), (4, 1)), event((20, 3), (11, 1)), path="f/b.jsonl")
    other = lines(spark, meta("r"), turn, event((7, 1), (7, 1)), record("k", 10), record("k", 99), record(None, 3), event((8, 1), (1, 0)), "{torn", path="f/c.jsonl")
    headless = lines(spark, turn, record("z", 50), path="f/d.jsonl")
    got = agents.codex_calls(first.unionByName(fork).unionByName(other).unionByName(headless).unionByName(first)).collect()
    rows = sorted((r["session"], r["call_key"] or "", r["model"] or "", r["input"], r["cache_read"]) for r in got)
    assert rows == [("p", "", "m1", 4, 0), ("p", "", "m1", 5, 0), ("q", "", "", 11, 0), ("r", "", "m1", 2, 1), ("r", "", "m1", 7, 0), ("r", "k", "m1", 9, 1)]


def test_codex_forks_without_their_parent(spark):
    """What a fork inherited is known by its own turns, which are of a later time than its id."""
    use = lambda i: {"input_tokens": i, "output_tokens": 1}
    event = lambda total, last: {"timestamp": "2026-01-02T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": use(total), "last_token_usage": use(last)}}}
    uuid = lambda ms: f"{ms:012x}"[:8] + "-" + f"{ms:012x}"[8:] + "-7abc-8abc-0123456789ab"
    meta = lambda i, parent: {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": i, "forked_from_id": parent}}
    turn = lambda i: {"type": "turn_context", "payload": {"turn_id": i, "model": "m"}}
    own = uuid(5000)
    fork = [meta(own, "gone"), turn(uuid(1000)), event(10, 10), turn(uuid(6000)), event(40, 30), turn("x"), event(50, 10)]
    for block in (2, 4096):
        got = agents.codex_calls(lines(spark, *fork, path="f/a.jsonl"), block=block).collect()
        assert sorted((r["input"], r["model"]) for r in got) == [(10, "m"), (30, "m")]
    plain = [meta("no-time", "gone"), event(10, 10), event(40, 30)]
    assert sorted(r["input"] for r in agents.codex_calls(lines(spark, *plain)).collect()) == [10, 30]
    assert agents.codex_calls(lines(spark, '{"type": "session_me', *fork)).count() == 0  # a torn head says nothing about the file
    empty = [meta("e", None), {**event(1, 1), "payload": {"type": "token_count", "info": {"total_token_usage": {}, "last_token_usage": use(3)}}}]
    assert agents.codex_calls(lines(spark, *empty)).count() == 0


def test_copilot_sessions_without_a_name(spark):
    """Each counts from zero, also in a log whose first one has no name either."""
    metric = lambda i: {"usage": {"inputTokens": i, "outputTokens": 0, "cacheReadTokens": 0, "cacheWriteTokens": 0}}
    shut = lambda i: {"type": "session.shutdown", "timestamp": "2026-01-01T00:00:00Z", "data": {"modelMetrics": {"m": metric(i)}}}
    start = {"type": "session.start", "data": {}}
    df = lines(spark, start, shut(100), start, shut(60), path="x/dir/events.jsonl")
    assert sorted((r["session"], r["input"]) for r in agents.copilot_log_calls(df).collect()) == [("dir", 100), ("dir#1", 60)]
    two = lines(spark, start, shut(100), path="x/dir/a.jsonl").unionByName(lines(spark, start, shut(130), path="x/dir/b.jsonl")).withColumn("file_seq", F.lit(None).cast("int"))
    assert sorted(r["input"] for r in agents.copilot_log_calls(two).collect()) == [30, 100]


def test_copilot_sessions_are_counted_once(spark):
    """By rows from the release that writes them on, else by the larger side; rows that are gone hold a session back."""
    metric = lambda i: {"usage": {"inputTokens": i, "outputTokens": 0, "cacheReadTokens": 0, "cacheWriteTokens": 0}}
    log = lambda s, v, i: [{"type": "session.start", "data": {"sessionId": s, "copilotVersion": v}}, {"type": "session.shutdown", "timestamp": "2026-01-01T00:00:00Z", "data": {"modelMetrics": {"m": metric(i)}}}]
    df = lines(spark, *log("new", "1.0.70", 100), *log("gone", "1.0.69", 50), *log("old", "1.0.5", 100), *log("tie", None, 7), *log("alone", "1.0.5", 3), path="x/dir/events.jsonl")
    events = spark.createDataFrame([(n, s, "m", i, 0, 0, 0, None, "2026-01-02T00:00:00Z", n) for n, (s, i) in enumerate([("new", 10), ("old", 60), ("old", 30), ("tie", 7), ("rows", 4)])], "id long, session_id string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, token_details_json string, created_at string, row_id long")
    found, held = agents.copilot_calls(df, events)
    assert sorted((r["session"], r["day"][-1], r["input"]) for r in found.collect()) == [("alone", "1", 3), ("new", "2", 10), ("old", "1", 100), ("rows", "2", 4), ("tie", "2", 7)]
    assert [r["session"] for r in held.collect()] == ["gone"]
    without, held = agents.copilot_calls(df, events.limit(0), store=False)
    assert sorted((r["session"], r["input"]) for r in without.collect()) == [("alone", 3), ("gone", 50), ("new", 100), ("old", 100), ("tie", 7)] and held.isEmpty()


def test_membership(spark):
    from commitlake.operators import membership

    repos = spark.createDataFrame([("a", "/work/a/", "forge.example/x/a", ["id-a"]), ("b", "/work/b", None, []), ("c", None, "forge.example/x/c", ["id-c"])], "repo string, root_dir string, remote string, ids array<string>")
    rows = [("1", "/elsewhere", None, "Forge.example/x/A", None), ("2", "/work/a/./src/../lib", None, None, None), ("3", "/work/a", None, "forge.example/x/other", "h1"), ("4", "/work/a", None, "forge.example/x/other", "h2"), ("5", "/tmp", "/work/b/deep", "forge.example/x/z", None), ("6", "/work/ab", None, None, None), ("7", None, None, None, None), ("8", "work/a", None, "forge.example/x/c", None)]
    sessions = spark.createDataFrame(rows, "s string, cwd string, root string, url string, sha string")
    known = spark.createDataFrame([("a", "h1"), ("b", "h2")], "repo string, hash string")
    found = membership.belonging(sessions, repos, key="s", paths=["cwd", "root"], remote="url", commits=["sha"], known=known)
    assert sorted(map(tuple, found.collect())) == [("1", "a"), ("2", "a"), ("3", "a"), ("5", "b"), ("8", "c")]
    by_id = membership.belonging_by_id(sessions.select("s", "cwd", F.when(F.col("s") == "1", "id-c").when(F.col("s") == "2", "global").when(F.col("s") == "3", "h1").when(F.col("s") == "4", "h2").alias("p")), repos, key="s", project="p", paths=["cwd"], known=known)
    assert sorted(map(tuple, by_id.collect())) == [("1", "c"), ("2", "a"), ("3", "a")]
    hashed = membership.belonging_by_hash(spark.range(1).select(F.lit("s").alias("s"), F.sha2(F.lit("/work/b"), 256).alias("h")), repos.select("repo", F.col("root_dir").alias("path")), key="s", hash_="h")
    assert [tuple(r) for r in hashed.collect()] == [("s", "b")]
    assert membership.belonging(sessions.limit(0), repos, key="s", paths=["cwd"], remote="url").isEmpty()


def test_transcript_windows_and_undated_copies(spark):
    turn = lambda i, n, at: {"type": "assistant", "timestamp": at, "message": {"id": i, "model": "c", "usage": {"input_tokens": n}}}
    df = lines(spark, turn("x", 1, None), turn("x", 2, "2026-01-05T00:00:00Z"), turn("y", 3, "2026-01-01T00:00:00Z"), turn("y", 4, "2026-01-06T00:00:00Z"), path="/h/-work-a/s.jsonl")
    sub = lines(spark, turn("z", 5, "2026-01-05T00:00:00Z"), path="/h/-work-a/s/subagents/deep/agent-1.jsonl").unionByName(lines(spark, turn("q", 9, "2026-01-05T00:00:00Z"), path="/h/-work-b/s.jsonl"))
    every = df.unionByName(sub)
    assert sorted((r["call_key"], r["input"]) for r in agents.transcript_calls(every).collect()) == [("q", 9), ("x", 2), ("y", 3), ("z", 5)]
    windows = spark.createDataFrame([("/h/-work-a", "2026-01-04", None)], "folder string, since string, until string")
    assert sorted((r["call_key"], r["input"]) for r in agents.transcript_calls(every, windows).collect()) == [("x", 2), ("y", 4), ("z", 5)]


def test_telemetry_totals_and_days(spark):
    event = lambda u, **more: {"uuid": u, "timestamp": "2026-01-01T00:00:00Z", "systemPayload": {"uiEvent": {"event.name": "qwen-code.api_response", "model": "q", "auth_type": "openai", "input_token_count": 1, "output_token_count": 5, "thoughts_token_count": 3, **more}}}
    df = lines(spark, event("u", total_token_count=0), event("v", **{"event.timestamp": "soon"}), event("w", **{"event.name": "other.api_response"}))
    assert calls(agents.telemetry_calls(df)) == [("u", "2026-01-01", "q", 1, 5, 0, 0), ("v", "2026-01-01", "q", 1, 5, 0, 0)]


def test_copilot_log(spark):
    metric = lambda i, o, n, own=None: {"usage": {"inputTokens": i, "outputTokens": o, "cacheReadTokens": 0, "cacheWriteTokens": 0}, "requests": {"count": n}, **({"tokenDetails": {"input": {"tokenCount": own}}} if own is not None else {})}
    start = lambda s: {"type": "session.start", "data": {"sessionId": s}}
    shut = lambda at, **m: {"type": "session.shutdown", "timestamp": at, "data": {"modelMetrics": m}}
    df = lines(spark, start("s1"), shut("2026-01-01T00:00:00Z", m=metric(10, 1, 2)), {"type": "session.resume", "data": {}}, shut("2026-01-02T00:00:00Z", m=metric(30, 4, 5), n=metric(5, 5, 1, own=99)), start("s2"), shut("2026-01-03T00:00:00Z", m=metric(7, 7, 1)), path="x/dir/events.jsonl")
    got = sorted((r["session"], r["day"], r["model"], r["input"], r["turns"]) for r in agents.copilot_log_calls(df).collect())
    assert got == [("s1", "2026-01-01", "m", 10, 2), ("s1", "2026-01-02", "m", 20, 3), ("s2", "2026-01-03", "m", 7, 1)]


def test_chats_and_transcripts(spark):
    message = lambda i, n, at="2026-01-01T00:00:00Z", **more: {"id": i, "type": "gemini", "timestamp": at, "model": "g", "tokens": {"input": n, "output": 1, "total": n + 1}, **more}
    df = lines(spark, {"sessionId": "s", "projectHash": "h"}, message("a", 1), {"$set": {"messages": [message("a", 5), message("b", 2)]}}, {"id": "a", "type": "gemini", "tokens": None}, {"messages": [message("c", 3)]}, message("", 9), {"id": "u", "type": "user", "tokens": {"input": 4}})
    assert calls(agents.chat_calls(df)) == [("a", "2026-01-01", "g", 5, 1, 0, 0), ("b", "2026-01-01", "g", 2, 1, 0, 0), ("c", "2026-01-01", "g", 3, 1, 0, 0)]
    turn = lambda i, n, **more: {"type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": i, "model": "c", "usage": {"input_tokens": n, "output_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 3}}, **more}
    df = lines(spark, turn("x", 1), turn("x", 7), turn(None, 2, requestId="r"), turn(None, 3), turn(None, 3), {"type": "user", "usage": 1})
    assert sorted((r["call_key"] or "", r["input"]) for r in agents.transcript_calls(df).collect()) == [("", 3), ("", 3), ("r", 2), ("x", 1)]
    event = lambda u, n, auth: {"uuid": u, "timestamp": "2026-01-01T00:00:00Z", "systemPayload": {"uiEvent": {"event.name": "qwen-code.api_response", "model": "q", "auth_type": auth, "input_token_count": n, "output_token_count": 4, "thoughts_token_count": 2}}}
    df = lines(spark, event("u", 1, "openai"), event("u", 8, "openai"), event("v", 1, "other"))
    assert calls(agents.telemetry_calls(df)) == [("u", "2026-01-01", "q", 8, 4, 0, 0), ("v", "2026-01-01", "q", 1, 6, 0, 0)]


def test_store(spark):
    data = lambda **more: json.dumps({"role": "assistant", "providerID": "p", "modelID": "m", "tokens": {"input": 5, "output": 1, "reasoning": 2}, **more})
    rows = [
        ("msg_x", "s", "1788219000000", 1, 1, data()),
        ("msg_x", "s", "1788219000000", 2, 2, "{torn"),
        ("msg_y", "s", "1788219000000", 1, 3, data(parts=[{"type": "step-finish", "tokens": {"input": 9, "output": 1}, "model": {"modelID": "only"}}, {"type": "text"}, {"type": "step-finish", "tokens": {"input": 8, "output": 1}, "model": {"providerID": "a", "modelID": "b"}}])),
        ("msg_z", "s", "1788219000000", 1, 4, json.dumps({"role": "user", "tokens": {"input": 1}})),
    ]
    messages = spark.createDataFrame(rows, "id string, session_id string, time_created string, batch_no int, row_id long, data string")
    sessions = spark.createDataFrame([("s", "1.14.0")], "id string, version string")
    got = sorted((r["call_key"], r["model"], r["input"], r["output"], r["day"]) for r in agents.store_calls(messages, sessions).collect())
    assert got == [("msg_x", "p/m", 5, 3, "2026-08-31"), ("msg_y#0", "p/m", 9, 1, "2026-08-31"), ("msg_y#2", "a/b", 8, 1, "2026-08-31")] or [g[:4] for g in got] == [("msg_x", "p/m", 5, 3), ("msg_y#0", "p/m", 9, 1), ("msg_y#1", "a/b", 8, 1)]


def pb(*fields):
    """A message of (number, int | bytes) fields."""

    def varint(n):
        out = b""
        while True:
            n, low = n >> 7, n & 0x7F
            out += bytes([low | (0x80 if n else 0)])
            if not n:
                return out

    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def test_protobuf(spark):
    assert protobuf.read_varint(b"\xac\x02", 0) == (300, 2)
    for bad in (b"\x80", b"\x0a\x05ab", b"\x00", b"\x0b"):
        with pytest.raises(ValueError):
            list(protobuf.read_fields(bad))
    used = lambda key, i: pb((2, i), (3, 2), (5, 1), (11, key))
    steps = spark.createDataFrame([("p", 0, bytearray(pb((1, pb((1, 1_788_219_000))), (9, used(b"r1", 10))))), ("p", 1, bytearray(b"\x80")), ("p", 2, None)], "path string, idx int, data binary")
    gens = spark.createDataFrame([("p", 0, bytearray(pb((1, pb((4, used(b"r1", 99)), (19, b"model-x")))))), ("p", 1, bytearray(pb((1, pb((4, used(b"r2", 5)), (19, b"y"))))))], "path string, idx int, data binary")
    assert calls(agents.conversation_calls(steps, gens)) == [("r1", "2026-08-31", "model-x", 10, 2, 1, 0), ("r2", "", "y", 5, 2, 1, 0)]


def test_streaming_archive(spark, tmp_path):
    schema = "source string, day string, model string, input bigint, output bigint, cache_read bigint, cache_write bigint, turns bigint"
    landing, target = str(tmp_path / "in"), str(tmp_path / "archive")
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    for rows in ([("a", "d1", "m", 5, 0, 0, 0, 1), ("a", "d1", "m", 5, 0, 0, 0, 1)], [("a", "d1", "m", 4, 0, 0, 0, 1), ("b", "d1", "m", 1, 0, 0, 0, 1)]):
        put(*rows)
        usage.run_archive(spark.readStream.schema(schema).parquet(landing), target, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["source"], r["input"], r["turns"]) for r in usage.read_archive(spark, target).collect())
    assert got == [("a", 10, 2), ("b", 1, 1)]
    assert usage.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_empty_logs(spark):
    none = lines(spark).limit(0)
    for read in (agents.codex_calls, agents.copilot_log_calls, agents.chat_calls, agents.transcript_calls, agents.telemetry_calls):
        assert by_day_model(read(none)).count() == 0
