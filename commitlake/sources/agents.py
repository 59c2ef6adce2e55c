"""Logs of coding agents to calls: source, call_key, session, day, model, the four counters, turns.

Lines are DataFrames (file_path, line_no, row_id, raw), from Parquet tables or from ``numbered_lines``; stores are
tables. A line delivered more than once counts once. Which of them belong to a repository is a filter of the caller
on the session's folder or remote (``functions.paths``), before or after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.functions import usage as U
from commitlake.functions.jsonx import json_object, json_value
from commitlake.operators.archive import carry_forward, cumulative_increase, first_of_key
from commitlake.operators.documents import in_windows
from commitlake.operators.lines import running_sum
from commitlake.session import materialise

CALLS = ["source", "call_key", "session", "day", "model", *U.COUNTERS, "turns"]


def _calls(df: DataFrame, source: str, *, key: Column, session: Column, day: Column, model: Column, counters: Column, turns: Column | None = None) -> DataFrame:
    rows = df.select(F.lit(source).alias("source"), key.alias("call_key"), session.alias("session"), day.alias("day"), model.alias("model"), counters.alias("u_c"), (F.lit(1).cast("bigint") if turns is None else turns).alias("turns"))
    return rows.select("source", "call_key", "session", "day", "model", "u_c.*", "turns")


def once(lines: DataFrame, *more: str) -> DataFrame:
    """file_path, line_no, raw and ``more`` of each line of a file once: the delivery with the smallest row_id."""
    first = lines.groupBy("file_path", "line_no").agg(F.min_by(F.struct("raw", *more), "row_id").alias("l"))
    return first.select("file_path", "line_no", "l.*")


_COUNTS = "input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint,cache_write_input_tokens:bigint"
_CODEX = f"timestamp string, type string, payload struct<id:string,forked_from_id:string,type:string,response_id:string,turn_id:string,model:string,usage:struct<{_COUNTS}>,info:struct<total_token_usage:struct<{_COUNTS}>,last_token_usage:struct<{_COUNTS}>>>"


def _codex_counts(c: Column) -> Column:
    return U.inclusive(c["input_tokens"], c["output_tokens"], c["cached_input_tokens"], c["cache_write_input_tokens"])


def codex_calls(lines: DataFrame, block: int = 4096) -> DataFrame:
    """Calls of rollouts: usage records, once by response id, and token_count events before a rollout's first record.

    A rollout whose first line is no session_meta says nothing. A record's model is that of its turn, else the last one
    named; an event's is the last one named. Of several copies of a session the fullest counts (ties: the first path). An
    event counts when its running total differs from the event before. The leading events of a fork are its parent's: those
    the parent holds too or, without the parent, those before the fork's own first turn (its id is of a later time).

    Every line is parsed once and written. What goes on from line to line (the model, the running total, the latest turn)
    is carried from block to block by one row a block, so no file is one task; calls are written, and all that concerns
    whole sessions reads these alone.
    """
    parsed = once(lines).select("file_path", "line_no", json_object(F.col("raw"), _CODEX).alias("rec"))
    p, kind = F.col("rec.payload"), F.col("rec.type")
    info, turn, record = p["info"], kind == "turn_context", kind == "token_usage_record"
    total, last = F.to_json(info["total_token_usage"]), info["last_token_usage"]
    event = (kind == "event_msg") & (p["type"] == "token_count") & (total != "{}") & (F.to_json(last) != "{}")
    rows = materialise(
        parsed.select(
            "file_path",
            "line_no",
            F.floor(F.col("line_no") / block).alias("blk"),
            kind.alias("kind"),
            F.coalesce(record, F.lit(False)).alias("is_record"),
            F.coalesce(event, F.lit(False)).alias("is_event"),
            U.utc_day(F.coalesce("rec.timestamp", F.lit(""))).alias("day"),
            F.when(kind == "session_meta", F.struct(U.text(p["id"]).alias("id"), U.text(p["forked_from_id"]).alias("parent"))).alias("meta"),
            F.when(turn | record, U.text(p["turn_id"])).alias("turn"),
            F.when(turn, U.text(p["model"])).alias("named"),
            F.when(record, U.text(p["response_id"])).alias("call_key"),
            F.when(event, total).alias("total"),
            F.when(event, F.concat_ws(" ", total, F.to_json(last))).alias("pair"),
            F.when(record, _codex_counts(p["usage"])).when(event, _codex_counts(last)).alias("counts"),
        ),
        "rollout-lines",
    )
    started = F.when(F.col("kind") == "turn_context", U.uuid7(F.col("turn")))
    at = lambda flag: F.when(flag, F.col("line_no"))
    blocks = rows.groupBy("file_path", "blk").agg(
        F.min_by(F.struct("kind", "meta"), "line_no").alias("head"),
        F.max_by("named", at(F.col("named").isNotNull())).alias("named"),
        F.max_by("total", at(F.col("is_event"))).alias("total"),
        F.max(started).alias("started"),
        F.min(at(F.col("is_record"))).alias("first_record"),
    )
    file = Window.partitionBy("file_path")
    earlier = file.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(blocks.select(
        "file_path",
        "blk",
        F.first("head").over(file.orderBy("blk")).alias("head"),
        F.last("named", ignorenulls=True).over(earlier).alias("named_in"),
        F.last("total", ignorenulls=True).over(earlier).alias("total_in"),
        F.max("started").over(earlier).alias("started_in"),
        F.min("first_record").over(file).alias("first_record"),
    ).where("head.kind = 'session_meta'"), "rollout-blocks")
    here = Window.partitionBy("file_path", "blk").orderBy("line_no")
    before_here = here.rowsBetween(Window.unboundedPreceding, -1)
    read = rows.join(carried, ["file_path", "blk"]).select(
        "file_path", "line_no", "is_record", "is_event", "day", "turn", "call_key", "pair", "counts", "first_record", "total",
        F.col("head.meta.id").alias("session"),
        F.col("head.meta.parent").alias("forked_from"),
        F.coalesce(F.last("named", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), "named_in").alias("model"),
        F.coalesce(F.last("total", ignorenulls=True).over(before_here), "total_in").alias("before"),
        F.greatest(F.max(started).over(before_here), F.col("started_in")).alias("latest_turn"),
    )
    counted = read.where(F.col("is_record") | (F.col("is_event") & ~F.col("total").eqNullSafe(F.col("before"))))
    turns = rows.where("kind = 'turn_context' AND turn IS NOT NULL").groupBy("file_path", "turn").agg(F.max_by("named", "line_no").alias("of_turn"))
    own = U.uuid7(F.col("session"))
    named = counted.join(turns, ["file_path", "turn"], "left")
    calls = materialise(
        named.select(
            "file_path", "line_no", "is_record", "day", "call_key", "pair", "counts", "first_record", "session", "forked_from",
            F.when(F.col("is_record"), F.coalesce("of_turn", "model")).otherwise(F.col("model")).alias("model"),
            F.coalesce(F.col("forked_from").isNotNull() & own.isNotNull() & ~F.coalesce(F.col("latest_turn") > own, F.lit(False)), F.lit(False)).alias("inherited"),
        ),
        "rollout-calls",
    )
    heads = carried.groupBy("file_path").agg(F.min("head.meta.id").alias("session")).join(calls.groupBy("file_path").agg(F.count("*").alias("n")), "file_path", "left")
    fullest = heads.groupBy(F.coalesce("session", "file_path").alias("of")).agg(F.min_by(F.struct("file_path", "session"), F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "file_path")).alias("f")).select("f.*")
    mine = materialise(calls.join(fullest.select("file_path"), "file_path", "left_semi"), "rollout-calls")
    records = first_of_key(mine.where("is_record"), "call_key", ["file_path", "line_no"])
    events = mine.where("NOT is_record")
    parents = fullest.where("session IS NOT NULL").select(F.col("session").alias("forked_from"), F.lit(True).alias("has_parent"))
    held = events.where("session IS NOT NULL").select(F.col("session").alias("forked_from"), "pair", F.lit(True).alias("in_parent")).distinct()
    marked = events.join(parents, "forked_from", "left").join(held, ["forked_from", "pair"], "left")
    copied = F.when(F.col("has_parent"), F.coalesce("in_parent", F.lit(False))).otherwise(F.col("inherited"))
    begun = marked.where(~copied).groupBy("file_path").agg(F.min("line_no").alias("first_own"))
    kept = events.join(begun, "file_path").where("line_no >= first_own AND (first_record IS NULL OR line_no < first_record)").drop("first_own")
    return _calls(records.unionByName(kept), "codex", key=F.col("call_key"), session=F.coalesce("session", "file_path"), day=F.col("day"), model=F.col("model"), counters=F.col("counts"))


_METRIC = "usage struct<inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint>, requests struct<count:bigint>, tokenDetails struct<input:struct<tokenCount:bigint>>"


def copilot_snapshots(lines: DataFrame) -> DataFrame:
    """Cumulative snapshots of the logs, as ``cumulative_increase`` takes them.

    A start opens a session and names it; a start without id takes the name of the log's folder, with the number of such
    starts before it where there were any, and a resume before any start the folder's name. Shutdowns belong to the
    session that is open. Lines: file_path, line_no, file_seq, row_id, raw; files without file_seq come in the order of
    their paths.
    """
    shape = "timestamp string, type string, data struct<sessionId:string,modelMetrics:map<string,string>>"
    parsed = once(lines, "file_seq").select("file_path", "line_no", "file_seq", json_object(F.col("raw"), shape).alias("rec")).where("rec IS NOT NULL")
    folder, kind = F.regexp_extract("file_path", r"([^/]*)/[^/]*$", 1), F.col("rec.type")
    marks = materialise(parsed.where(kind.isin("session.start", "session.resume", "session.shutdown")).withColumn("tie", F.lit(0)), "session-marks")
    unnamed = F.when((kind == "session.start") & U.text(F.col("rec.data.sessionId")).isNull(), 1).otherwise(0)
    numbered = running_sum(marks, ["file_path"], "line_no", {"u_n": unnamed})
    own = F.concat(folder, F.when(F.col("u_n") > 1, F.concat(F.lit("#"), (F.col("u_n") - 1).cast("string"))).otherwise(""))
    named = numbered.withColumns({"u_start": F.when(kind == "session.start", F.coalesce(U.text(F.col("rec.data.sessionId")), own)), "u_resume": F.when(kind == "session.resume", folder)})
    opened = carry_forward(named, ["file_path"], "line_no", "tie", "u_start", "u_open")
    opened = carry_forward(opened, ["file_path"], "line_no", "tie", "u_resume", "u_folder").withColumn("session", F.coalesce("u_open", "u_folder"))
    shut = opened.where((kind == "session.shutdown") & F.col("session").isNotNull())
    each = shut.select("session", "file_path", "file_seq", "line_no", U.utc_day(F.coalesce("rec.timestamp", F.lit(""))).alias("day"), F.explode("rec.data.modelMetrics").alias("model", "metric"))
    read = each.withColumn("m", json_object(F.col("metric"), _METRIC)).where("m IS NOT NULL").withColumn("u_c", _copilot_counts(F.col("m.usage")))
    return read.select(
        F.lit("copilot").alias("source"),
        "session",
        "model",
        F.struct(F.coalesce("file_seq", F.lit(0)).alias("file_seq"), F.when(F.col("file_seq").isNull(), F.col("file_path")).alias("file_path"), "line_no").alias("at"),
        "day",
        "u_c.*",
        F.when(F.col("m.requests.count").isNotNull(), F.greatest(F.lit(0), F.col("m.requests.count"))).alias("calls"),
        _agrees(F.col("m.tokenDetails.input.tokenCount"), F.col("m.usage")).alias("valid"),
    )


def _copilot_counts(u: Column) -> Column:
    return U.inclusive(u["inputTokens"], u["outputTokens"], u["cacheReadTokens"], u["cacheWriteTokens"])


def _agrees(own: Column, u: Column) -> Column:
    """Whether the uncached input a row gives for itself is its input less both caches; true where it gives none."""
    return F.coalesce(own == U.count(u["inputTokens"]) - U.count(u["cacheReadTokens"]) - U.count(u["cacheWriteTokens"]), F.lit(True))


def copilot_log_calls(lines: DataFrame) -> DataFrame:
    """Calls of the logs: what each snapshot adds to those before it."""
    added = cumulative_increase(copilot_snapshots(lines)).where("state = 'added'")
    return added.select("source", F.lit(None).cast("string").alias("call_key"), "session", "day", "model", *U.COUNTERS, "turns")


def copilot_store_calls(events: DataFrame) -> DataFrame:
    """Calls of the usage table (id, session_id, model, counts, token_details_json, created_at), once by id; rows that
    contradict their own details are left out."""
    details = json_value(F.col("token_details_json"), "array<struct<tokenType:string,tokenCount:bigint>>")
    own = F.try_element_at(F.filter(details, lambda x: x["tokenType"] == "input"), F.lit(-1))["tokenCount"]
    u = F.struct(F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), F.col("cache_read_tokens").alias("cacheReadTokens"), F.col("cache_write_tokens").alias("cacheWriteTokens"))
    keyed = first_of_key(events.withColumn("u_key", F.col("id").cast("string")), "u_key", ["row_id"]).withColumn("u_u", u)
    return _calls(keyed.where(_agrees(own, F.col("u_u"))), "copilot", key=F.col("u_key"), session=F.col("session_id"), day=U.utc_day(F.coalesce("created_at", F.lit(""))), model=F.col("model"), counters=_copilot_counts(F.col("u_u")))


#: First release that writes a row for each call (fixed value).
ROWS_FROM = (1, 0, 69)


def copilot_calls(lines: DataFrame, events: DataFrame, store: bool = True) -> tuple[DataFrame, DataFrame]:
    """Calls of the logs and of the usage table without counting a session twice, and the sessions held back (session).

    A session of a release from ROWS_FROM on is read from its rows alone while there is a ``store``; where its rows are
    gone it is held back, if its snapshots have tokens. An older one, or one whose start names no release, is read from
    the side with more tokens, the rows on a tie. The numbered parts of a log without names are weighed as one.
    """
    base = F.substring_index("session", "#", 1).alias("base")
    used = lambda df: df.where((F.col("day") != "") & (F.greatest(*U.COUNTERS) > 0))
    size = lambda df: df.groupBy(base).agg(F.sum(sum((F.col(c) for c in U.COUNTERS[1:]), F.col(U.COUNTERS[0]))).alias("tokens"))
    logged, rows = materialise(copilot_log_calls(lines), "logged"), materialise(copilot_store_calls(events), "stored")
    start = once(lines).select("file_path", "line_no", json_object(F.col("raw"), "type string, data struct<sessionId:string,copilotVersion:string>").alias("rec")).where("rec.type = 'session.start' AND rec.data.copilotVersion <> ''")
    named = F.coalesce(U.text(F.col("rec.data.sessionId")), F.regexp_extract("file_path", r"([^/]*)/[^/]*$", 1)).alias("base")
    versions = start.groupBy(named).agg(F.min_by("rec.data.copilotVersion", F.struct("file_path", "line_no")).alias("version"))
    both = size(used(logged)).withColumnRenamed("tokens", "in_logs").join(size(used(rows)).withColumnRenamed("tokens", "in_rows"), "base", "full")
    present = events.where("session_id IS NOT NULL").select(F.col("session_id").alias("base"), F.lit(True).alias("has_rows")).distinct()
    judged = both.join(present, "base", "left").join(versions, "base", "left").withColumn("rows_only", F.lit(store) & (U.version(F.col("version")) >= U.version_lit(*ROWS_FROM)))
    side = F.when(F.col("rows_only"), F.when(F.col("has_rows"), "rows").otherwise("held")).when(F.col("has_rows").isNull(), "logs")
    judged = materialise(judged.select("base", side.when(F.coalesce("in_rows", F.lit(0)) >= F.coalesce("in_logs", F.lit(0)), "rows").otherwise("logs").alias("side"), "in_logs"), "sides")
    of = lambda df, side: df.withColumn("base", base).join(judged.where(F.col("side") == side).select("base"), "base", "left_semi").drop("base")
    nameless = rows.where("session IS NULL")
    return of(logged, "logs").unionByName(of(rows, "rows")).unionByName(nameless), judged.where("side = 'held' AND in_logs > 0").select(F.col("base").alias("session"))


_CHAT = "id:string,type:string,timestamp:string,model:string,tokens:struct<input:bigint,output:bigint,cached:bigint,thoughts:bigint,tool:bigint,total:bigint>"


def chat_messages(lines: DataFrame) -> DataFrame:
    """Every write of a message with its place: file_path, line_no, row_id, part, pos, m; on lines, in checkpoints and in
    whole documents."""
    shape = _CHAT.replace(":", " ", 1).replace(",type:", ", type ").replace(",timestamp:", ", timestamp ").replace(",model:", ", model ").replace(",tokens:struct", ", tokens struct")
    rec = json_object(F.col("raw"), f"{shape}, `$set` struct<messages:array<struct<{_CHAT}>>>, messages array<struct<{_CHAT}>>")
    top = F.struct(*(F.col(f"rec.{c}").alias(c) for c in ("id", "type", "timestamp", "model", "tokens")))
    place = lambda part, pos, m: F.struct(F.lit(part).alias("part"), pos.cast("bigint").alias("pos"), m.alias("m"))
    several = lambda part, array: F.coalesce(F.transform(array, lambda x, i: place(part, i, x)), F.array())
    parsed = lines.select("file_path", "line_no", "row_id", rec.alias("rec")).where("rec IS NOT NULL")
    each = F.explode(F.concat(F.array(place(0, F.lit(-1), top)), several(1, F.col("rec.$set.messages")), several(2, F.col("rec.messages"))))
    return parsed.select("file_path", "line_no", "row_id", each.alias("x")).select("file_path", "line_no", "row_id", "x.*")


def chat_calls(lines: DataFrame, kind: str = "gemini") -> DataFrame:
    """Calls of chat sessions: of each message of type ``kind`` the last write that has tokens."""
    writes = chat_messages(lines).where((F.col("m.type") == kind) & (F.col("m.id") != "") & F.col("m.tokens").isNotNull())
    last = writes.groupBy("m.id").agg(F.max_by(F.struct("m", "file_path"), F.struct("file_path", "line_no", "part", "pos", "row_id")).alias("l"))
    m = F.col("l.m")
    return _calls(last, kind, key=m["id"], session=F.col("l.file_path"), day=U.utc_day(F.coalesce(m["timestamp"], F.lit(""))), model=m["model"], counters=U.chat_counters(m["tokens"]))


_STORE_TOKENS = "struct<input:bigint,output:bigint,reasoning:bigint,total:bigint,cache:struct<read:bigint,write:bigint>>"


def store_calls(messages: DataFrame, sessions: DataFrame, source: str = "opencode", drop_forks: bool = True) -> DataFrame:
    """Calls of a message store: the step-finish parts of each assistant message, or the message where it has none.

    ``messages``: id, session_id, data, batch_no, row_id, time_updated and time_created (text); ``sessions``: id,
    version. Of the copies of a message the last delivered with valid data counts; a copy minted by a fork is left
    out unless ``drop_forks`` is false. Counters follow the rules of the session's release. ``messages`` may have
    utc_us, the instant of a time_created that is not in milliseconds; a call without any instant has the day ''.
    """
    shape = f"role string, providerID string, modelID string, tokens {_STORE_TOKENS}, parts array<struct<type:string,tokens:{_STORE_TOKENS},model:struct<providerID:string,modelID:string>>>"
    instant = F.floor(F.col("utc_us") / 1000).cast("bigint") if "utc_us" in messages.columns else F.lit(None).cast("bigint")
    ms = F.coalesce(F.when(F.col("time_created").rlike(r"^\d{13}$"), F.col("time_created").cast("bigint")), instant, F.lit(0).cast("bigint"))
    read = messages.select("id", "session_id", ms.alias("u_ms"), "batch_no", "row_id", json_object(F.col("data"), shape).alias("d")).where("d IS NOT NULL")
    last = read.where(F.col("id") != "").groupBy("id").agg(F.max_by(F.struct("session_id", "u_ms", "d"), F.struct("batch_no", "row_id")).alias("l")).select("id", "l.*")
    mine = last.where(F.coalesce(U.text(F.col("d.role")), F.lit("assistant")) == "assistant")
    if drop_forks:
        mine = mine.where(~U.fork_copy(F.col("id"), F.col("u_ms")))
    steps = F.filter(F.coalesce("d.parts", F.array()), lambda x: (x["type"] == "step-finish") & x["tokens"].isNotNull())
    own = F.struct(F.col("d.tokens").alias("t"), F.col("d.providerID").alias("provider"), F.col("d.modelID").alias("model"), F.lit(-1).alias("i"))

    def step(x: Column, i: Column) -> Column:
        both = (x["model"]["providerID"] != "") & (x["model"]["modelID"] != "")
        return F.struct(x["tokens"].alias("t"), F.when(both, x["model"]["providerID"]).otherwise(F.col("d.providerID")).alias("provider"), F.when(both, x["model"]["modelID"]).otherwise(F.col("d.modelID")).alias("model"), i.alias("i"))

    records = mine.withColumn("u_r", F.explode(F.when(F.size(steps) > 0, F.transform(steps, step)).otherwise(F.array(own)))).where("u_r.t IS NOT NULL")
    versions = sessions.groupBy(F.col("id").alias("session_id")).agg(F.max("version").alias("version"))
    dated = records.join(versions, "session_id", "left")
    provider, model = U.text(F.col("u_r.provider")), U.text(F.col("u_r.model"))
    name = F.when(provider.isNotNull() & model.isNotNull(), F.concat_ws("/", provider, model)).otherwise(model)
    return _calls(dated, source, key=F.concat_ws("#", "id", F.when(F.col("u_r.i") >= 0, F.col("u_r.i").cast("string"))), session=F.col("session_id"), day=U.day_ms(F.col("u_ms")), model=name, counters=U.store_counters(F.col("u_r.t"), provider, model, U.version(F.col("version"))))


def transcript_calls(lines: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Calls of transcripts (claude-code): assistant records with usage, once by message id, else request id, else uuid;
    records without any are all kept.

    Only dated records count, and with ``windows`` (folder, since, until: days or NULL) those in a window of the folder
    their file lies in; both are tested before the copies, so a copy that counts is not lost to one that does not.
    """
    shape = "type string, timestamp string, uuid string, requestId string, message struct<id:string,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
    parsed = lines.where(F.col("raw").contains('"usage"')).select("file_path", "line_no", "row_id", json_object(F.col("raw"), shape).alias("rec"))
    m, u = F.col("rec.message"), F.col("rec.message.usage")
    flat = parsed.select(
        "file_path", "line_no", "row_id", F.col("rec.type").alias("kind"), U.utc_day(F.coalesce("rec.timestamp", F.lit(""))).alias("u_day"), m["model"].alias("model"), u.isNotNull().alias("used"),
        F.coalesce(U.text(m["id"]), U.text(F.col("rec.requestId")), U.text(F.col("rec.uuid"))).alias("u_key"),
        U.additive(u["input_tokens"], u["output_tokens"], u["cache_read_input_tokens"], u["cache_creation_input_tokens"]).alias("counts"),
    )
    dated = materialise(flat, "transcripts").where("kind = 'assistant' AND used AND u_day <> ''")  # every line is parsed once
    if windows is not None:
        dated = in_windows(dated.withColumn("u_folder", transcript_folder(F.col("file_path"))), "u_folder", "u_day", windows.withColumnRenamed("folder", "path")).drop("u_folder")
    kept = first_of_key(dated, "u_key", ["file_path", "line_no", "row_id"])
    return _calls(kept, "claude-code", key=F.col("u_key"), session=F.col("file_path"), day=F.col("u_day"), model=F.col("model"), counters=F.col("counts"))


def transcript_folder(path: Column) -> Column:
    """The folder of the project a transcript belongs to: its own, or that of the session whose sub-agent wrote it."""
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]+/subagents/(.*/)?agent-[^/]*$", ""), r"/[^/]*\.jsonl$", "")


#: Login types whose missing total is input and output (fixed values).
SUMMED_LOGINS = ("openai", "openai-responses", "qwen-oauth", "anthropic")


#: Name of the event that reports a call (fixed value).
EVENT = "qwen-code.api_response"


def telemetry_calls(lines: DataFrame) -> DataFrame:
    """Calls of telemetry chats (qwen): the last write of each uuid, or of each line without one."""
    event = "`event.name`:string,`event.timestamp`:string,model:string,auth_type:string,input_token_count:bigint,output_token_count:bigint,cached_content_token_count:bigint,thoughts_token_count:bigint,tool_token_count:bigint,total_token_count:bigint"
    shape = f"uuid string, cwd string, timestamp string, systemPayload struct<uiEvent:struct<{event}>>"
    parsed = lines.select("file_path", "line_no", "row_id", json_object(F.col("raw"), shape).alias("rec")).where(F.col("rec.systemPayload.uiEvent.`event.name`") == EVENT)
    key = F.coalesce(U.text(F.col("rec.uuid")), F.concat_ws(":", "file_path", "line_no"))
    last = parsed.groupBy(key.alias("u_key")).agg(F.max_by(F.struct("rec", "file_path"), F.struct("file_path", "line_no", "row_id")).alias("l"))
    e = F.col("l.rec.systemPayload.uiEvent")
    summed = (U.count(e["total_token_count"]) == 0) & e["auth_type"].isin(*SUMMED_LOGINS)
    total = F.when(summed, U.count(e["input_token_count"]) + U.count(e["output_token_count"])).otherwise(e["total_token_count"])
    t = F.struct(e["input_token_count"].alias("input"), e["output_token_count"].alias("output"), e["cached_content_token_count"].alias("cached"), e["thoughts_token_count"].alias("thoughts"), e["tool_token_count"].alias("tool"), total.alias("total"))
    day = F.coalesce(U.text(U.utc_day(F.coalesce(e["event.timestamp"], F.lit("")))), U.utc_day(F.coalesce("l.rec.timestamp", F.lit(""))))
    return _calls(last, "qwen", key=F.col("u_key"), session=F.col("l.file_path"), day=day, model=e["model"], counters=U.chat_counters(t))


def conversation_calls(steps: DataFrame, generations: DataFrame) -> DataFrame:
    """Calls of protobuf conversations (antigravity): step usage gives the day, generation usage the model.

    Both: path, idx and data (BINARY); joined by response id, else by path and place. Usage fields: 2 input, 3 output,
    4 cache write, 5 cache read, 11 response id; a step has its time in 1.1 and its usage in 9, a generation its usage
    in 1.4 and its model in 1.19. What does not decode is left out.
    """
    from commitlake.functions.protobuf import field_bytes, field_number, proto_fields

    def read(df: DataFrame, outer: list[int], inner: int, extra: dict[str, tuple[int, str]]) -> DataFrame:
        at = df.withColumn("u_f", proto_fields("data"))
        for number in outer:
            at = at.withColumn("u_f", proto_fields(field_bytes(F.col("u_f"), number)))
        held = at.withColumn("u_u", proto_fields(field_bytes(F.col("u_f"), inner))).where("u_u IS NOT NULL")
        u = F.col("u_u")
        columns = {"input": field_number(u, 2), "output": field_number(u, 3), "cache_write": field_number(u, 4), "cache_read": field_number(u, 5), "response": F.decode(field_bytes(u, 11), "UTF-8")}
        more = {n: (F.decode(field_bytes(F.col("u_f"), k), "UTF-8") if kind == "text" else field_bytes(F.col("u_f"), k)) for n, (k, kind) in extra.items()}
        return held.select("path", "idx", *(c.alias(n) for n, c in {**columns, **more}.items()))

    when = read(steps, [], 9, {"time": (1, "bytes")}).withColumn("u_t", proto_fields("time"))
    dated = when.select("*", F.coalesce(F.date_format(F.timestamp_seconds(field_number(F.col("u_t"), 1)), "yyyy-MM-dd"), F.lit("")).alias("day")).withColumn("key", F.coalesce(U.text(F.col("response")), F.concat_ws(":", "path", F.lit("steps"), "idx")))
    named = read(generations, [1], 4, {"model": (19, "text")}).withColumn("key", F.coalesce(U.text(F.col("response")), F.concat_ws(":", "path", F.lit("gen"), "idx")))
    pick = lambda df, columns: df.groupBy("key").agg(F.min_by(F.struct(*columns), "idx").alias("x")).select("key", "x.*")
    a = pick(dated, ["path", "day", "input", "output", "cache_read", "cache_write"])
    b = pick(named.withColumnRenamed("path", "path_b"), ["path_b", "model", *(F.col(c).alias(f"{c}_b") for c in U.COUNTERS)])
    both = a.join(b, "key", "full")
    counters = U.additive(*(F.coalesce(F.col(c), F.col(f"{c}_b")) for c in U.COUNTERS))
    return _calls(both, "antigravity", key=F.col("key"), session=F.coalesce("path", "path_b"), day=F.coalesce("day", F.lit("")), model=F.col("model"), counters=counters)

