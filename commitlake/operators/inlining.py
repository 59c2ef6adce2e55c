"""Deeply nested records to related flat tables, by shared inlining over the observed schema graph.

1. ``schema_graph`` walks every record and reports each distinct edge (element, child element or field). Edges are
   reduced in the task and then by ``distinct``; their number is bounded by the schemas, not by the rows. An element
   with more than ``max_children`` different children is a map, its keys are data: its entries are one repeated element,
   named ``<element>/*``, whatever their keys. Where such maps are found the records are walked once more with them
   known, so that a key of a map is never taken for an element of the same name elsewhere.
2. ``table_elements`` decides on the driver which elements get a table: the root, repeated elements (entries of maps
   among them), elements with several parents, and one on every cycle. All others are inlined into the table of the
   element above them.
3. ``shred`` walks the records again and emits one row for each instance of a table's element, with the columns of all
   elements inlined into it, its place in the row above and the path of that row as its foreign key.
4. ``flat_table`` gives the table of one element with a column for each of its fields.

No value is lost on the way: every scalar of a record is a column of exactly one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlake.functions.jsonx import parse_object, sound, text_array
from commitlake.session import materialise

ROOT = ""
_GRAPH = "parent string, child string, kind string, many boolean"
Edge = tuple[str, str, str, bool]


def entry_of(element: str) -> str:
    """The element that all entries of a map are."""
    return f"{element}/*"


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    return {str: "string", float: "double", dict: "object", list: "array"}.get(type(value), "null")


def _flat(items: list) -> Iterator[tuple[str, object]]:
    """(place, item) of the items of nested arrays, such as ``[0][2]``, by an explicit stack."""
    todo = [(f"[{i}]", x) for i, x in enumerate(items)]
    todo.reverse()
    while todo:
        place, x = todo.pop()
        if isinstance(x, list):
            todo.extend((f"{place}[{i}]", y) for i, y in reversed(list(enumerate(x))))
        else:
            yield place, x


def _edges(record: dict, maps: frozenset, out: set) -> None:
    """Add (parent, child, kind, many) of every field in ``record``; an explicit stack, so depth is no limit."""
    stack: list[tuple[str, dict]] = [(ROOT, record)]
    while stack:
        parent, value = stack.pop()
        entries = parent in maps
        for key, child in value.items():
            name = entry_of(parent) if entries else key
            if isinstance(child, list):
                many, flat = True, [x for _, x in _flat(child)]
                if not flat:
                    out.add((parent, name, "array", True))
            else:
                many, flat = entries, [child]
            for x in flat:
                if isinstance(x, dict):
                    out.add((parent, name, "object", many))
                    stack.append((name, x))
                elif x is not None:
                    out.add((parent, name, _kind(x), many))


def _walk(df: DataFrame, text: str, maps: frozenset) -> DataFrame:
    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            fresh: set = set()
            for value in batch.column(0).to_pylist():
                record = parse_object(value)
                if record is not None:
                    _edges(record, maps, fresh)
            new = list(fresh - seen)
            seen.update(new)
            if len(seen) > 100_000:  # keys are data here: what repeats is left to distinct
                seen.clear()
            yield pa.RecordBatch.from_arrays([*(text_array(x[i] for x in new) for i in range(3)), pa.array([x[3] for x in new], pa.bool_())], ["parent", "child", "kind", "many"])

    return df.select(text).mapInArrow(walk, _GRAPH).distinct()


def schema_graph(df: DataFrame, text: str, max_children: int = 200) -> DataFrame:
    """Distinct edges of all records in column ``text``: parent, child, kind, many.

    ``kind`` is object, array (an empty one), string, bigint, double or boolean; null values leave no edge. Elements
    are named by their key, entries of maps by ``entry_of``; the root is the empty string. Rows that hold no JSON object
    leave no edge. ``max_children`` decides how a wide element is laid out (a column for each child, or a row), not
    what is read. Maps in maps are found level by level, a walk for each.
    """
    maps: frozenset = frozenset()
    while True:
        edges = materialise(_walk(df, text, maps), "edges")
        children = edges.groupBy("parent").agg(F.count_distinct("child").alias("n"))
        wide = frozenset(r["parent"] for r in children.where(F.col("n") > max_children).collect())
        if wide <= maps:
            return edges
        maps |= wide


def table_elements(edges: list[Edge], also: Iterable[str] = ()) -> set[str]:
    """Elements that get a table of their own: the root, repeated, shared and recursive ones, and those in ``also``."""
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    tables = {ROOT, *also}
    for parent, child, kind, many in edges:
        if kind == "object" or many:
            parents.setdefault(child, set()).add(parent)
            children.setdefault(parent, set()).add(child)
        if many:
            tables.add(child)
    tables |= {child for child, above in parents.items() if len(above) > 1}
    # every cycle must pass through a table: what a search without tables meets twice on its path becomes one
    state: dict[str, int] = {}
    for start in sorted(children):
        stack = [(start, iter(sorted(children.get(start, ()))))]
        if state.get(start):
            continue
        state[start] = 1
        while stack:
            node, rest = stack[-1]
            for child in rest:
                if child in tables:
                    continue
                if state.get(child) == 1:
                    tables.add(child)
                elif not state.get(child):
                    state[child] = 1
                    stack.append((child, iter(sorted(children.get(child, ())))))
                    break
            else:
                state[node] = 2
                stack.pop()
    return tables


def map_elements(edges: Iterable[Edge]) -> frozenset:
    """Elements whose keys are data."""
    return frozenset(parent for parent, child, _, _ in edges if child == entry_of(parent))


def _named(key: str) -> str:
    """A key as part of a column's name, in which a dot stands between keys."""
    return key.replace("\\", "\\\\").replace(".", "\\.") if "." in key or "\\" in key else key


def _instances(record: dict, tables: frozenset, maps: frozenset, base: str, wanted: dict[str, frozenset] | None) -> Iterator[tuple]:
    """(table, path, parent table, parent path, position, columns) of every table row in ``record``."""
    todo: list[tuple] = [(ROOT, ROOT, base, None, None, None, record)]
    while todo:
        table, own, path, above, above_path, position, value = todo.pop()
        columns: dict[str, str] = {}
        if isinstance(value, dict):
            inlined: list[tuple] = [("", path, table, own, value)]
            while inlined:
                prefix, at, element, holder, held = inlined.pop()
                asked = None if wanted is None else wanted.get(holder, ())
                entries = element in maps
                child_element = entry_of(element) if entries else ""
                for key, child in held.items():
                    if child is None:
                        continue
                    where = f"{at}.{key}" if at else key
                    if isinstance(child, list):
                        items = [(place, x) for place, x in _flat(child) if x is not None]
                        todo.extend((child_element or key, key, where + place, table, path, (f"{key}." if entries else "") + place[1:-1].replace("][", "."), x) for place, x in items)
                        if entries and not items:
                            todo.append((child_element, key, where, table, path, key, []))
                        mark = "[]"
                    elif entries or (isinstance(child, dict) and key in tables):
                        todo.append((child_element or key, key, where, table, path, key, child))
                        mark = "{}"
                    elif isinstance(child, dict):
                        inlined.append((f"{prefix}{_named(key)}.", where, key, key, child))
                        mark = "{}"
                    else:
                        mark = child if isinstance(child, str) else json.dumps(child)
                    if key in asked if asked is not None else not entries:
                        columns[prefix + _named(key)] = mark
        elif wanted is None:
            columns["value"] = value if isinstance(value, str) else json.dumps(value)
        if columns or wanted is None:
            yield table, path, above, above_path, position, columns


SHREDDED = "element string, path string, parent_element string, parent_path string, position string, columns map<string,string>"


def shred(df: DataFrame, text: str, key: str, edges: list[Edge], base: str = "", wanted: dict[str, list[str]] | None = None, also: Iterable[str] = ()) -> DataFrame:
    """Rows of all tables: ``key`` (bigint), element, path, parent_element, parent_path, position, columns.

    (key, path) identifies a row, (key, parent_path) its parent; position is its place in an array (``2``; ``0.2`` in an
    array of arrays), else its key in the row above, and both in a map of arrays. Columns hold strings as they are and other values as JSON; ``{}`` and
    ``[]`` mark fields that hold an object or an array; null fields are left out; dots and backslashes of a key are
    escaped by a backslash in its name. ``base`` is the path of the root. ``also``: elements that get a table whatever
    the graph says. ``wanted`` ({key of the holder: [field]}) keeps only these fields, in whichever table they lie, and
    drops rows without any: a projection that is applied during the walk. Rows that hold no JSON object give nothing;
    repeated rows give repeated results.
    """
    tables = frozenset(table_elements(edges, also))
    maps = map_elements(edges)
    asked = None if wanted is None else {h: frozenset(f) for h, f in wanted.items()}
    names = ["element", "path", "parent_element", "parent_path", "position"]
    kind = pa.map_(pa.string(), pa.string())

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = parse_object(value)
                if record is not None:
                    for row in _instances(record, tables, maps, base, asked):
                        keys.append(k)
                        out.append(row)
            cells = [list(r[5].items()) for r in out]
            try:
                columns = pa.array(cells, kind)
            except UnicodeEncodeError:
                columns = pa.array([[(sound(n), sound(v)) for n, v in row] for row in cells], kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(text_array(r[i] for r in out) for i in range(5)), columns], ["key", *names, "columns"])

    rows = df if wanted is None else df.where(_may_hold(text, list(wanted)))
    return rows.select(F.col(key).cast("bigint"), text).mapInArrow(walk, f"key bigint, {SHREDDED}").withColumnRenamed("key", key)


def _may_hold(text: str, elements: list[str]) -> Column:
    """Rows whose text has one of the names, or an escape that could spell one: all others hold none."""
    found = F.contains(F.col(text), F.lit("\\u"))
    for name in elements:
        found = found | F.contains(F.col(text), F.lit(name))
    return found


def full_path(path: Column, column: Column) -> Column:
    """Where in the record a column of a row was: the row's path, and the keys of the column's name behind it."""
    return F.concat_ws(".", F.nullif(path, F.lit("")), F.regexp_replace(column, r"\\(.)", "$1"))


def table_fields(element: str, edges: list[Edge], also: Iterable[str] = ()) -> list[str]:
    """Names of the columns of an element's table, as the edges allow them; ``value`` for items that are no objects."""
    tables, fields = table_elements(edges, also), set()
    if any(child == element and many and kind != "object" for _, child, kind, many in edges):
        fields.add("value")
    todo = [(element, "")]
    while todo:
        at, prefix = todo.pop()
        for parent, child, kind, many in edges:
            if parent != at or child == entry_of(at):
                continue
            if kind == "object" and not many and child not in tables:
                todo.append((child, f"{prefix}{_named(child)}."))
            elif kind not in ("object", "array") and not many:
                fields.add(prefix + _named(child))
    return sorted(fields)


def flat_table(shredded: DataFrame, key: str, element: str, edges: list[Edge], also: Iterable[str] = ()) -> DataFrame:
    """The relational table of one element: ``key``, path, parent_path, position and a column for each field.

    A field's column is ``f_`` and its path below the element with ``_`` between the names; where two fields come to one
    name (compared without case), the later has a number behind it.
    """
    columns, taken = [], set()
    for field in table_fields(element, edges, also):
        name = "f_" + field.replace("\\", "").replace(".", "_")
        number = 1
        while (unique := name if number == 1 else f"{name}_{number}").lower() in taken:
            number += 1
        taken.add(unique.lower())
        columns.append(F.try_element_at("columns", F.lit(field)).alias(unique))
    return shredded.where(F.col("element") == element).select(key, "path", "parent_path", "position", *columns)
