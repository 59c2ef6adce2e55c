"""Queries over the log tables for the general data problems (p1 to p5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlake.functions.jsonx import json_object
from commitlake.operators import dedup, drift, hierarchy, inlining, stamps
from commitlake.session import materialise
from commitlake.sources.tables import table

#: Instants of the test tables lie between August 2025 and January 2027 (TESTDATA.md); a day more on either side.
WINDOW_US = (1_753_920_000_000_000, 1_801_526_400_000_000)


def stamp_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-null stamp of the five tables: table_name, row_id, field_name, source, ord, project, stamp, normal."""
    log = "timestamp string"
    parts = []
    for name, raw, fields in (
        ("codex_lines", log, {"timestamp": "rec.timestamp"}),
        ("copilot_lines", f"{log}, data struct<startTime:string>", {"timestamp": "rec.timestamp", "startTime": "rec.data.startTime"}),
        ("gemini_lines", f"{log}, startTime string", {"timestamp": "rec.timestamp", "startTime": "rec.startTime"}),
    ):
        rec = table(spark, folder, name).select("row_id", "file_path", "line_no", "project", json_object(F.col("raw"), raw).alias("rec"))
        found = F.explode(F.array(*(F.struct(F.lit(k).alias("field_name"), F.col(v).alias("stamp")) for k, v in fields.items())))
        flat = rec.select("row_id", "file_path", "line_no", "project", found.alias("x"))
        parts.append(flat.select(F.lit(name).alias("table_name"), "row_id", "x.field_name", F.col("file_path").alias("source"), F.col("line_no").alias("ord"), "project", "x.stamp"))
    valid = json_object(F.col("data"), "role string").isNotNull()
    message = table(spark, folder, "message").where(valid)
    parts.append(message.select(F.lit("message").alias("table_name"), "row_id", F.lit("time_created").alias("field_name"), F.col("session_id").alias("source"), F.col("row_id").alias("ord"), "project", F.col("time_created").alias("stamp")))
    usage = table(spark, folder, "assistant_usage_events")
    parts.append(usage.select(F.lit("assistant_usage_events").alias("table_name"), "row_id", F.lit("created_at").alias("field_name"), F.col("session_id").alias("source"), F.col("row_id").alias("ord"), "project", F.col("created_at").alias("stamp")))
    rows = reduce(DataFrame.unionByName, parts).where(F.col("stamp").isNotNull())
    return rows.withColumn("normal", F.when(F.col("field_name") == "time_created", F.col("stamp").rlike(r"^\d{13}$")).otherwise(stamps.is_iso_ms(F.col("stamp"))))


def normal_stamps(spark: SparkSession, folder: str, of: str | None = None) -> DataFrame:
    """Every stamp with its instant: table_name, row_id, field_name, normal, utc_us (NULL where it names none).

    ``of``: only the stamps of that table. projects is joined by broadcast only as far as Spark finds it below its own
    size limit.
    """
    zones = table(spark, folder, "projects").groupBy("project").agg(F.min("zone_name").alias("zone_name"))
    stamped = stamp_rows(spark, folder)
    rows = (stamped if of is None else stamped.where(F.col("table_name") == of)).join(zones, "project", "left")
    return stamps.normalise_stamps(
        rows, stamp="stamp", zone="zone_name", source=["table_name", "field_name", "source"], order="ord", tie="row_id", keep=["table_name", "row_id", "field_name", "normal"], window=WINDOW_US
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stamps that name an instant without being in their field's normal form."""
    return normal_stamps(spark, folder).where(~F.col("normal") & F.col("utc_us").isNotNull()).select("table_name", "row_id", "field_name", "utc_us")


#: Days of delivery that are ingested together.
DAYS_AT_ONCE = 16


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of an identifier: scope (the table), id, batch_no, row_id, part, pos.

    part tells the arrays of one record apart: 0 outside of an array, 1 in ``$set.messages``, 2 in ``messages``.
    """
    columns = ["batch_no", "row_id"]
    codex = table(spark, folder, "codex_lines").select(*columns, json_object(F.col("raw"), "payload struct<response_id:string>")["payload"]["response_id"].alias("id"))
    rec = json_object(F.col("raw"), "id string, `$set` struct<messages:array<struct<id:string>>>, messages array<struct<id:string>>").alias("rec")
    at = lambda array, part: F.coalesce(F.transform(array, lambda x, i: F.struct(F.lit(part).alias("part"), i.cast("bigint").alias("pos"), x["id"].alias("id"))), F.array())
    top = F.array(F.struct(F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("pos"), F.col("rec.id").alias("id")))
    gemini = table(spark, folder, "gemini_lines").select(*columns, rec).select(*columns, F.explode(F.concat(top, at(F.col("rec.$set.messages"), 1), at(F.col("rec.messages"), 2))).alias("x"))
    plain = lambda df: df.withColumns({"part": F.lit(0), "pos": F.lit(-1).cast("bigint")})
    parts = {
        "codex_lines": plain(codex),
        "gemini_lines": gemini.select(*columns, "x.*"),
        "message": plain(table(spark, folder, "message").select(*columns, "id")),
        "assistant_usage_events": plain(table(spark, folder, "assistant_usage_events").select(*columns, F.col("id").cast("string").alias("id"))),
    }
    return reduce(DataFrame.unionByName, (df.withColumn("scope", F.lit(name)) for name, df in parts.items()))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Surplus copies of every identifier, each delivery compared with the index of all earlier ones."""
    found = dedup.surplus_copies(
        identifiers(spark, folder), batch=F.floor(F.col("batch_no") / DAYS_AT_ONCE), order=["batch_no", "row_id", "pos", "part"], key=["row_id", "pos", "part"]
    )
    return found.select(F.col("scope").alias("table_name"), "row_id", "pos")


#: Holder and field of the children that p3_found reports: {table: (text column, path of the root, {holder: [field]})}.
CHILDREN = {
    "codex_lines": ("raw", "", {"thread_token_usage": ["cached_input_tokens"]}),
    "copilot_lines": ("raw", "", {"context": ["gitRoot"]}),
    "message": ("data", "data", {"tokens": ["input"]}),
}


def graph_edges(spark: SparkSession, folder: str, name: str) -> list[tuple[str, str, str, bool]]:
    """The schema graph of one table on the driver; as many edges as the schemas have, whatever the number of rows."""
    return [tuple(r) for r in inlining.schema_graph(table(spark, folder, name), CHILDREN[name][0]).collect()]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the children asked for, read off the flat tables in which shared inlining puts them."""
    parts = []
    for name, (text, base, wanted) in CHILDREN.items():
        rows = inlining.shred(table(spark, folder, name), text, "row_id", graph_edges(spark, folder, name), base, wanted)
        cells = rows.select("row_id", "path", F.explode(F.map_keys("columns")).alias("field"))
        parts.append(cells.select(F.lit(name).alias("table_name"), "row_id", inlining.full_path(F.col("path"), F.col("field")).alias("child_path")))
    return reduce(DataFrame.unionByName, parts)


def shredded(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, list]:
    """All rows of all flat tables of one table, and its schema graph; the holders of CHILDREN have tables of their own."""
    text, base, wanted = CHILDREN[name]
    edges = graph_edges(spark, folder, name)
    return inlining.shred(table(spark, folder, name), text, "row_id", edges, base, also=list(wanted)), edges


def p3_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every flat table that shared inlining makes of the three tables, with the rows that have a parent row."""
    parts = []
    for name in CHILDREN:
        rows, _ = shredded(spark, folder, name)
        counts = rows.groupBy("element", "parent_element").agg(F.count("*").alias("n_rows"), F.count("parent_path").alias("n_linked"), F.sum(F.size("columns")).alias("n_values"))
        parts.append(counts.withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def p3_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the flat tables with the place it had in its record: nothing is lost, nothing is told twice."""
    parts = []
    for name in CHILDREN:
        rows, _ = shredded(spark, folder, name)
        cells = rows.select("row_id", "path", "columns", F.explode("columns").alias("column", "cell")).where(~F.col("cell").isin("{}", "[]"))
        item = (F.col("column") == "value") & (F.size("columns") == 1) & F.col("path").endswith("]")
        parts.append(cells.select(F.lit(name).alias("table_name"), "row_id", F.when(item, F.col("path")).otherwise(inlining.full_path(F.col("path"), F.col("column"))).alias("cell_path"), "cell"))
    return reduce(DataFrame.unionByName, parts)


def _holder(spark: SparkSession, folder: str, name: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of a table's holder element: row_id, path, parent_path and ``fields`` (column: field) as bigint."""
    rows, _ = shredded(spark, folder, name)
    element = next(iter(CHILDREN[name][2]))
    cell = lambda field: F.try_element_at("columns", F.lit(field))
    return rows.where(F.col("element") == element).select("row_id", "path", "parent_path", *(cell(f).alias(c) for c, f in fields.items()))


#: Columns of the holders' flat tables: {table: {column: field below the holder}}.
HOLDER_FIELDS = {
    "codex_lines": {"input_tokens": "input_tokens", "cached_input_tokens": "cached_input_tokens", "output_tokens": "output_tokens"},
    "copilot_lines": {"cwd": "cwd", "git_root": "gitRoot"},
    "message": {"input": "input", "output": "output", "reasoning": "reasoning", "cache_read": "cache.read", "cache_write": "cache.write"},
}


def p3_thread_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the thread_token_usage objects of codex_lines, each with its place."""
    return _holder(spark, folder, "codex_lines", HOLDER_FIELDS["codex_lines"]).drop("parent_path")


def p3_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the context objects of copilot_lines, each with its place."""
    return _holder(spark, folder, "copilot_lines", HOLDER_FIELDS["copilot_lines"]).drop("parent_path")


def p3_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of the tokens objects of message, each with its place."""
    return _holder(spark, folder, "message", HOLDER_FIELDS["message"]).drop("parent_path")


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Foreign keys of the holders' flat tables: how many rows have their parent's row among the rows of its table."""
    parts = []
    for name, (_, _, wanted) in CHILDREN.items():
        rows, _ = shredded(spark, folder, name)
        mine = rows.where(F.col("element").isin(list(wanted))).select("row_id", F.col("parent_path").alias("path"), F.col("parent_element").alias("element"))
        found = mine.join(rows.select("row_id", "path", "element", F.lit(1).alias("hit")), ["row_id", "path", "element"], "left")
        parts.append(found.agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_parents")).select(F.lit(name).alias("table_name"), "n_rows", "n_parents"))
    return reduce(DataFrame.unionByName, parts)


def thread_copies(spark: SparkSession, folder: str) -> DataFrame:
    """node, parent of every record that names a thread."""
    rec = json_object(F.col("raw"), "payload struct<id:string,parent_thread_id:string,forked_from_id:string>")["payload"].alias("p")
    found = table(spark, folder, "codex_lines").select(rec).where(F.col("p.id") != "")
    return found.select(F.col("p.id").alias("node"), F.coalesce(F.nullif("p.parent_thread_id", F.lit("")), F.nullif("p.forked_from_id", F.lit(""))).alias("parent"))


def message_copies(spark: SparkSession, folder: str) -> DataFrame:
    """node, parent of every delivered message."""
    parent = json_object(F.col("data"), "parentID string")["parentID"]
    return table(spark, folder, "message").where(F.col("id") != "").select(F.col("id").alias("node"), F.nullif(parent, F.lit("")).alias("parent"))


def _forest(spark: SparkSession, folder: str) -> DataFrame:
    """Links of both trees in one forest; tree is a part of the node's key."""
    both = thread_copies(spark, folder).withColumn("tree", F.lit("thread")).unionByName(message_copies(spark, folder).withColumn("tree", F.lit("message")))
    return hierarchy.links(both, ["tree"], "node", "parent")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every node that is not a root, -1 and the smallest id of the loop on or below a loop."""
    nodes = hierarchy.resolve(_forest(spark, folder), ["tree"])
    return nodes.where(F.col("node_depth") != 0).select("tree", F.col("node").alias("node_id"), "root_id", "node_depth")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path from the root of every node outside of loops, its ids joined with ``/``."""
    nodes = hierarchy.resolve(_forest(spark, folder), ["tree"], paths=True).where(F.col("node_depth") >= 0)
    return nodes.select("tree", F.col("node").alias("node_id"), F.array_join("path", "/").alias("full_path"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every (ancestor, descendant) pair outside of loops with its distance."""
    pairs = hierarchy.descendants(hierarchy.resolve(_forest(spark, folder), ["tree"], paths=True), ["tree"])
    return pairs.select("tree", "ancestor_id", "descendant_id", "distance")


#: Fields whose drift is reported: {table: (text column, {field: (place of its object, own name)})}.
DRIFTING = {
    "codex_lines": ("raw", {"type": ("", "type"), "payload.info": ("payload<token_count>", "info")}),
    "copilot_lines": ("raw", {"type": ("", "type")}),
    "message": ("data", {"data.tokens.total": ("tokens", "total")}),
}
_FILE = ["install_id", "file_path", "file_seq"]


def _schemas(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """The files of a table, the names and types of each, and all names of each drifting field."""
    text, fields = DRIFTING[name]
    rows = table(spark, folder, name)
    files = materialise(rows.select(*_FILE).distinct(), "files")
    places = sorted({place for place, _ in fields.values()})
    found = materialise(drift.signatures(rows, text, _FILE, places), "signatures")
    names = materialise(drift.file_names(found, _FILE), "names")
    replaced = [tuple(r) for r in drift.swaps(names, files, ["install_id"], "file_seq", _FILE, places).collect()]
    pairs: dict[tuple[str, bool], set] = {}
    for kind, of in ((True, drift.beside(names, _FILE)), (False, drift.alike(found))):
        for r in of.collect():
            pairs.setdefault((r["place"], kind), set()).add(frozenset((r["a"], r["b"])))
    return files, names, {field: drift.aliases(replaced, place, own, pairs.get((place, True), set()), pairs.get((place, False), set())) for field, (place, own) in fields.items()}


def schema_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of the fields of DRIFTING from each file of an install to the next, with the names and types on both sides."""
    parts = []
    for name, (_, fields) in DRIFTING.items():
        files, names, known = _schemas(spark, folder, name)
        held = drift.file_fields(names, files, _FILE, {field: (place, known[field]) for field, (place, _) in fields.items()})
        parts.append(drift.changes(held, ["install_id"], "file_seq").withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of the fields above from each file of an install to the next."""
    return schema_changes(spark, folder).select("table_name", "file_path", "field_name", "change_kind")


def p5_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered log: each change with its place in its install's history of files, and what it led from and to."""
    log = schema_changes(spark, folder)
    return log.select("table_name", "install_id", "file_seq", "field_name", "change_kind", F.col("prev_name").alias("from_name"), F.col("name").alias("to_name"), F.col("prev_kind").alias("from_type"), F.col("kind").alias("to_type"))


def _union_table(spark: SparkSession, folder: str, name: str, others: dict[str, tuple[str, str]]) -> DataFrame:
    """Every record of a table with its drifting fields under one name and the union type of all files, beside ``others``
    ({column: (path, type)}), which do not drift. Columns: row_id, one for each field with ``_`` for its dots."""
    text, fields = DRIFTING[name]
    _, names, known = _schemas(spark, folder, name)
    wanted = {}
    for field, (place, _) in fields.items():
        bits = names.where((F.col("place") == place) & F.col("name").isin(known[field])).agg(drift.lattice_join(F.bit_or("bits")).alias("kind")).first()["kind"]
        wanted[field.replace(".", "_")] = ([key for key in place.split("<")[0].split(".") if key], known[field], drift.union_type([bits]))
    for column, (path, kind) in others.items():
        *above, own = path.split(".")
        wanted[column] = (above, [own], kind)
    return drift.unified(table(spark, folder, name).select("row_id", text), text, wanted).drop(text)


def p5_codex(spark: SparkSession, folder: str) -> DataFrame:
    """codex_lines under the union schema."""
    return _union_table(spark, folder, "codex_lines", {"ordinal": ("ordinal", "bigint"), "payload_type": ("payload.type", "string"), "payload_id": ("payload.id", "string")})


def p5_copilot(spark: SparkSession, folder: str) -> DataFrame:
    """copilot_lines under the union schema."""
    return _union_table(spark, folder, "copilot_lines", {"session_id": ("data.sessionId", "string")})


def p5_message(spark: SparkSession, folder: str) -> DataFrame:
    """message under the union schema."""
    return _union_table(spark, folder, "message", {"role": ("role", "string"), "tokens_input": ("tokens.input", "bigint"), "tokens_output": ("tokens.output", "bigint"), "tokens_reasoning": ("tokens.reasoning", "bigint")})


def p5_unified(spark: SparkSession, folder: str) -> DataFrame:
    """The drifting fields of every record under one name and the union type: table_name, row_id, field_name, value."""
    parts = []
    for name, read in (("codex_lines", p5_codex), ("copilot_lines", p5_copilot), ("message", p5_message)):
        cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f.replace(".", "_")).cast("string").alias("value")) for f in DRIFTING[name][1])))
        parts.append(read(spark, folder).select(F.lit(name).alias("table_name"), "row_id", cells.alias("x")).select("table_name", "row_id", "x.*").where(F.col("value").isNotNull()))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    q.__name__: q
    for q in (
        p1_found, p2_found, p3_found, p3_tables, p3_cells, p3_thread_usage, p3_contexts, p3_tokens, p3_links, p4_found, p4_paths, p4_descendants,
        p5_found, p5_changes, p5_unified, p5_codex, p5_copilot, p5_message,
    )
}

# SQL over the flat tables: every node of every record by DuckDB's own walk. Keys are put between dots without quotes.
_NODES = """found AS (
            SELECT 'codex_lines' AS table_name, row_id, '' AS base, raw AS j FROM codex_lines
            UNION ALL SELECT 'copilot_lines', row_id, '', raw FROM copilot_lines
            UNION ALL SELECT 'message', row_id, 'data.', data FROM message),
        nodes AS (SELECT v.table_name, v.row_id, base || replace(substr(t.fullkey, 3), '"', '') AS path, t.type, t.value FROM (SELECT * FROM found WHERE CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END) v, json_tree(v.j) t)"""


def _holder_sql(name: str, holder: str, fields: dict[str, str]) -> str:
    cells = ", ".join(f"json_extract_string(value, '$.{f}') AS {c}" for c, f in fields.items())
    return f"WITH {_NODES} SELECT row_id, path, {cells} FROM nodes WHERE table_name = '{name}' AND type = 'OBJECT' AND regexp_matches(path, '(^|\\.){holder}(\\[[0-9]+\\])*$')"


# SQL of drift: names of one field are listed, because SQL cannot find them.
_NAMES = {
    ("codex_lines", "type"): ("raw", "", ["type", "entry", "kind", "record_type"]), ("codex_lines", "payload.info"): ("raw", "payload.", ["info", "token_info", "details", "usage_info"]),
    ("copilot_lines", "type"): ("raw", "", ["type", "event", "eventType", "kind"]), ("message", "data.tokens.total"): ("data", "tokens.", ["total", "total_tokens", "all", "sum"]),
}


def _cell_sql(path: str) -> str:
    return f"CASE json_type(j, '$.{path}') WHEN 'VARCHAR' THEN json_extract_string(j, '$.{path}') WHEN 'NULL' THEN NULL ELSE CAST(json_extract(j, '$.{path}') AS VARCHAR) END"


def _field_sql(table_name: str, field: str) -> str:
    _, place, names = _NAMES[table_name, field]
    return f"coalesce({', '.join(_cell_sql(place + n) for n in names)})"


def _union_sql(name: str, columns: dict[str, str]) -> str:
    text = DRIFTING[name][0]
    fields = {f.replace(".", "_"): _field_sql(name, f) for f in DRIFTING[name][1]}
    cells = ", ".join(f"{sql} AS {c}" for c, sql in {**fields, **columns}.items())
    return f"SELECT row_id, {cells} FROM (SELECT row_id, CASE WHEN json_valid({text}) AND json_type({text}) = 'OBJECT' THEN {text} END AS j FROM {name})"


_UNION_SQL = {
    "codex_lines": _union_sql("codex_lines", {"ordinal": f"TRY_CAST({_cell_sql('ordinal')} AS BIGINT)", "payload_type": _cell_sql("payload.type"), "payload_id": _cell_sql("payload.id")}),
    "copilot_lines": _union_sql("copilot_lines", {"session_id": _cell_sql("data.sessionId")}),
    "message": _union_sql("message", {"role": _cell_sql("role"), **{f"tokens_{c}": f"TRY_CAST({_cell_sql(f'tokens.{c}')} AS BIGINT)" for c in ("input", "output", "reasoning")}}),
}
_FOREST = """codex AS (SELECT CASE WHEN json_valid(raw) THEN raw END AS j FROM codex_lines),
        copies AS (
            SELECT 'thread' AS tree, json_extract_string(j, '$.payload.id') AS node,
                coalesce(nullif(json_extract_string(j, '$.payload.parent_thread_id'), ''), nullif(json_extract_string(j, '$.payload.forked_from_id'), '')) AS parent FROM codex
            UNION ALL SELECT 'message', id, nullif(json_extract_string(CASE WHEN json_valid(data) THEN data END, '$.parentID'), '') FROM message),
        merged AS (SELECT tree, node, min(parent) AS parent FROM copies WHERE node <> '' GROUP BY 1, 2),
        links AS (SELECT a.tree, a.node, b.node AS parent FROM merged a LEFT JOIN merged b ON a.tree = b.tree AND a.parent = b.node)"""
ORACLES: dict[str, str] = {
    "p2_found": """
        WITH gemini AS (SELECT batch_no, row_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM gemini_lines),
        codex AS (SELECT batch_no, row_id, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j FROM codex_lines),
        found AS (
            SELECT 'codex_lines' AS table_name, batch_no, row_id, -1 AS pos, json_extract_string(j, '$.payload.response_id') AS id FROM codex
            UNION ALL SELECT 'gemini_lines', batch_no, row_id, -1, json_extract_string(j, '$.id') FROM gemini
            UNION ALL SELECT 'gemini_lines', batch_no, row_id, k, json_extract_string(j, '$."$set".messages[' || k || '].id')
                FROM (SELECT *, unnest(range(coalesce(json_array_length(j, '$."$set".messages'), 0)::BIGINT)) AS k FROM gemini)
            UNION ALL SELECT 'gemini_lines', batch_no, row_id, k, json_extract_string(j, '$.messages[' || k || '].id')
                FROM (SELECT *, unnest(range(coalesce(json_array_length(j, '$.messages'), 0)::BIGINT)) AS k FROM gemini)
            UNION ALL SELECT 'message', batch_no, row_id, -1, id FROM message
            UNION ALL SELECT 'assistant_usage_events', batch_no, row_id, -1, CAST(id AS VARCHAR) FROM assistant_usage_events),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, id ORDER BY batch_no, row_id, pos) AS n FROM found WHERE id <> '')
        SELECT table_name, row_id, CAST(pos AS BIGINT) AS pos FROM ranked WHERE n > 1""",
    "p3_found": """
        WITH found AS (
            SELECT 'codex_lines' AS table_name, row_id, '' AS base, 'thread_token_usage' AS holder, 'cached_input_tokens' AS field, raw AS j FROM codex_lines
            UNION ALL SELECT 'copilot_lines', row_id, '', 'context', 'gitRoot', raw FROM copilot_lines
            UNION ALL SELECT 'message', row_id, 'data.', 'tokens', 'input', data FROM message),
        valid AS (SELECT * FROM found WHERE json_valid(j) AND json_type(j) = 'OBJECT'),
        tree AS (SELECT v.table_name, v.row_id, v.base, v.holder, v.field, t.fullkey FROM valid v, json_tree(v.j) t WHERE t.key = v.field AND t.type <> 'NULL')
        SELECT table_name, row_id, base || substr(fullkey, 3) AS child_path FROM tree
        WHERE regexp_matches(fullkey, '\\.' || holder || '(\\[[0-9]+\\])*\\.' || field || '$')""",
    "p3_cells": f"""
        WITH {_NODES} SELECT table_name, row_id, path AS cell_path, json_extract_string(value, '$') AS cell FROM nodes WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p3_thread_usage": _holder_sql("codex_lines", "thread_token_usage", HOLDER_FIELDS["codex_lines"]),
    "p3_contexts": _holder_sql("copilot_lines", "context", HOLDER_FIELDS["copilot_lines"]),
    "p3_tokens": _holder_sql("message", "tokens", HOLDER_FIELDS["message"]),
    "p3_links": f"""
        WITH {_NODES}, holders(table_name, holder) AS (VALUES ('codex_lines', 'thread_token_usage'), ('copilot_lines', 'context'), ('message', 'tokens'))
        SELECT h.table_name, count(n.path) AS n_rows, count(n.path) AS n_parents FROM holders h
        LEFT JOIN nodes n ON n.table_name = h.table_name AND type NOT IN ('ARRAY', 'NULL') AND (type = 'OBJECT' OR path LIKE '%]') AND regexp_matches(path, '(^|\\.)' || holder || '(\\[[0-9]+\\])*$') GROUP BY 1""",
    "p4_paths": f"""
        WITH RECURSIVE {_FOREST},
        down AS (SELECT tree, node, node AS full_path FROM links WHERE parent IS NULL
            UNION ALL SELECT l.tree, l.node, d.full_path || '/' || l.node FROM links l JOIN down d ON l.tree = d.tree AND l.parent = d.node)
        SELECT tree, node AS node_id, full_path FROM down""",
    "p4_descendants": f"""
        WITH RECURSIVE {_FOREST},
        down AS (SELECT tree, node, [node] AS path FROM links WHERE parent IS NULL
            UNION ALL SELECT l.tree, l.node, list_append(d.path, l.node) FROM links l JOIN down d ON l.tree = d.tree AND l.parent = d.node),
        above AS (SELECT tree, node, path, unnest(range(1, len(path))) AS k FROM down)
        SELECT tree, path[k] AS ancestor_id, node AS descendant_id, len(path) - k AS distance FROM above""",
    "p4_found": f"""
        WITH RECURSIVE {_FOREST},
        down AS (SELECT tree, node, node AS root_id, 0 AS depth FROM links WHERE parent IS NULL
            UNION ALL SELECT l.tree, l.node, d.root_id, d.depth + 1 FROM links l JOIN down d ON l.tree = d.tree AND l.parent = d.node),
        stuck AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.tree = l.tree AND d.node = l.node)),
        walk AS (SELECT tree, node, parent AS spot FROM stuck UNION SELECT w.tree, w.node, s.parent FROM walk w JOIN stuck s ON s.tree = w.tree AND s.node = w.spot),
        loops AS (SELECT tree, node FROM walk WHERE node = spot),
        named AS (SELECT w.tree, w.node, min(w.spot) AS root_id FROM walk w JOIN loops USING (tree) WHERE loops.node = w.spot GROUP BY 1, 2)
        SELECT tree, node AS node_id, root_id, CAST(depth AS BIGINT) AS node_depth FROM down WHERE depth > 0
        UNION ALL SELECT tree, node, root_id, CAST(-1 AS BIGINT) FROM named""",
    "p5_codex": _UNION_SQL["codex_lines"],
    "p5_copilot": _UNION_SQL["copilot_lines"],
    "p5_message": _UNION_SQL["message"],
    "p5_unified": " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, '{f}' AS field_name, {f.replace('.', '_')} AS value FROM ({_UNION_SQL[t]}) WHERE {f.replace('.', '_')} IS NOT NULL" for t, (_, fields) in DRIFTING.items() for f in fields),
    "p5_found": """
        WITH cells AS (
            SELECT 'codex_lines' AS table_name, install_id, file_path, file_seq, 'type' AS field_name, raw AS j, '$' AS place FROM codex_lines WHERE json_valid(raw)
            UNION ALL SELECT 'codex_lines', install_id, file_path, file_seq, 'payload.info', raw, '$.payload' FROM codex_lines
                WHERE CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.payload.type') END = 'token_count'
            UNION ALL SELECT 'copilot_lines', install_id, file_path, file_seq, 'type', raw, '$' FROM copilot_lines WHERE json_valid(raw)
            UNION ALL SELECT 'message', install_id, file_path, file_seq, 'data.tokens.total', data, '$.tokens' FROM message WHERE json_valid(data)),
        keyed AS (SELECT *, unnest(json_keys(j, place)) AS name FROM cells),
        typed AS (SELECT table_name, file_path, field_name, name, CASE json_type(j, place || '."' || name || '"') WHEN 'VARCHAR' THEN 'string'
            WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM keyed
            WHERE name NOT IN ('timestamp', 'payload', 'ordinal', 'data', 'rate_limits', 'input', 'output', 'reasoning', 'cache') AND NOT (place = '$.payload' AND name = 'type')),
        held AS (SELECT table_name, file_path, field_name, min(name) AS name, min(kind) AS kind FROM typed WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
        files AS (
            SELECT DISTINCT 'codex_lines' AS table_name, install_id, file_path, file_seq, unnest(['type', 'payload.info']) AS field_name FROM codex_lines
            UNION SELECT DISTINCT 'copilot_lines', install_id, file_path, file_seq, 'type' FROM copilot_lines
            UNION SELECT DISTINCT 'message', install_id, file_path, file_seq, 'data.tokens.total' FROM message),
        placed AS (SELECT f.*, h.name, h.kind, lag(h.name) OVER w AS prev_name, lag(h.kind) OVER w AS prev_kind, row_number() OVER w AS n
            FROM files f LEFT JOIN held h USING (table_name, file_path, field_name)
            WINDOW w AS (PARTITION BY f.table_name, f.install_id, f.field_name ORDER BY f.file_seq))
        SELECT table_name, file_path, field_name, 'added' AS change_kind FROM placed WHERE n > 1 AND name IS NOT NULL AND prev_name IS NULL
        UNION ALL SELECT table_name, file_path, field_name, 'removed' FROM placed WHERE n > 1 AND name IS NULL AND prev_name IS NOT NULL
        UNION ALL SELECT table_name, file_path, field_name, 'renamed' FROM placed WHERE name <> prev_name
        UNION ALL SELECT table_name, file_path, field_name, 'retyped' FROM placed WHERE kind <> prev_kind""",
}
_PLACED = ORACLES["p5_found"].split("        SELECT table_name, file_path, field_name, 'added'")[0]
_STEP = "table_name, install_id, file_seq, field_name, '{}' AS change_kind, prev_name AS from_name, name AS to_name, prev_kind AS from_type, kind AS to_type FROM placed WHERE {}"
ORACLES["p5_changes"] = _PLACED + " UNION ALL ".join(
    "SELECT " + _STEP.format(kind, where)
    for kind, where in (("added", "n > 1 AND name IS NOT NULL AND prev_name IS NULL"), ("removed", "n > 1 AND name IS NULL AND prev_name IS NOT NULL"), ("renamed", "name <> prev_name"), ("retyped", "kind <> prev_kind"))
)
