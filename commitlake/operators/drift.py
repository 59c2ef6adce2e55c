"""Schemas that drift between files: one union schema and an ordered report of every change.

``signatures`` reads all files in parallel and reduces each to its distinct object signatures: which keys an object has
together and of which JSON kinds. The rows that leave a task are few, because the lines of a file share signatures.

The kinds of a field form a lattice: null lies below boolean, bigint and double, bigint below double, all of these below
string, and string, objects and arrays below json. A file's type of a field is the least upper bound of the kinds in it
(``lattice_join`` over ``kind_bits``, combined before the shuffle), and the union schema is that of all files.

A renamed field is recognised by what happens between neighbouring files: one name goes and the other comes, while no
object and no file ever holds both (``aliases``).

``changes`` compares the type and name of each file with those of the file before in its source; ``unified`` reads every
record under the union schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.functions.jsonx import json_object, parse_object, sound, text_array

#: The kinds above null, each with its bit; a set of kinds is the sum of their bits.
KINDS = {"boolean": 1, "bigint": 2, "double": 4, "string": 8, "array": 16, "object": 32}
_NESTED = KINDS["array"] | KINDS["object"]


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "bigint", float: "double", dict: "object", list: "array"}[type(value)]


def kind_bits(kind: Column) -> Column:
    """Aggregate: the set of kinds of a group. NULL and null add nothing."""
    return F.bit_or(F.coalesce(F.try_element_at(F.create_map(*(x for k, b in KINDS.items() for x in (F.lit(k), F.lit(b)))), kind), F.lit(0)))


def lattice_join(bits: Column) -> Column:
    """The least type above a set of kinds: the kind itself, double, string or json; null for the empty set."""
    case = F.when(bits == 0, "null")
    for kind, bit in KINDS.items():
        case = case.when(bits == bit, kind)
    numbers = KINDS["bigint"] | KINDS["double"]
    return case.when(bits == numbers, "double").when(bits.bitwiseAND(F.lit(_NESTED)) == 0, "string").otherwise("json")


def union_type(kinds: Iterable[str]) -> str:
    """The column type that holds all ``kinds`` or types of files: as ``lattice_join``, but objects and arrays are json."""
    seen = {k for k in kinds if k and k != "null"}
    if seen & {"array", "object", "json"}:
        return "json"
    if len(seen) < 2:
        return next(iter(seen), "null")
    return "double" if seen == {"bigint", "double"} else "string"


def _objects(record: dict, places: frozenset[str]) -> Iterator[tuple[str, dict]]:
    """(place, object) of the objects at ``places``; a string ``type`` below the root tells variants of a place apart."""
    prefixes = {p.split("<")[0] for p in places}
    todo = [("", record)]
    while todo:
        place, value = todo.pop()
        variant = value.get("type") if place else None
        for name in (place, f"{place}<{variant}>") if isinstance(variant, str) else (place,):
            if name in places:
                yield name, value
        for key, child in value.items():
            if isinstance(child, dict):
                below = f"{place}.{key}" if place else key
                if any(p == below or p.startswith(below + ".") for p in prefixes):
                    todo.append((below, child))


def signatures(df: DataFrame, text: str, file: list[str], places: list[str]) -> DataFrame:
    """``file`` columns, place, keys, kinds, n: how often objects at ``places`` have just these keys and kinds.

    A place is the path of an object, keys joined with dots ('' is the record itself), of any depth; ``place<x>`` is only
    those of its objects whose ``type`` is x. ``keys`` is sorted; ``kinds`` names the kind of each: null, boolean,
    bigint, double, string, array or object. Rows that hold no JSON object count for nothing; NULL file columns are kept
    as they are.
    """
    wanted = frozenset(places)
    columns = [next(f for f in df.schema.fields if f.name == c) for c in file]

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            heads = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            for head, value in zip(heads, batch.columns[-1].to_pylist(), strict=True):
                record = parse_object(value)
                if record is None:
                    continue
                for place, held in _objects(record, wanted):
                    names = sorted(held)
                    key = (head, place, tuple(names), tuple(_kind(held[k]) for k in names))
                    counts[key] = counts.get(key, 0) + 1
            rows = list(counts)
            heads = [pa.array([r[0][i] for r in rows], batch.schema.types[i]) for i in range(len(file))]
            rest = [text_array(r[1] for r in rows), pa.array([list(map(sound, r[2])) for r in rows], pa.list_(pa.string())), pa.array([list(r[3]) for r in rows], pa.list_(pa.string())), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*heads, *rest], [*file, "place", "keys", "kinds", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", place string, keys array<string>, kinds array<string>, n bigint"
    return df.select(*file, text).mapInArrow(walk, schema).groupBy(*file, "place", "keys", "kinds").agg(F.sum("n").alias("n"))


def file_names(found: DataFrame, file: list[str]) -> DataFrame:
    """``file`` columns, place, name, n, kind: every name of every file that is not null at least once, and its type."""
    cells = found.select(*file, "place", "n", F.explode(F.arrays_zip("keys", "kinds")).alias("x")).where("x.kinds <> 'null'")
    folded = cells.groupBy(*file, "place", F.col("x.keys").alias("name")).agg(F.sum("n").alias("n"), kind_bits(F.col("x.kinds")).alias("bits"))
    return folded.select(*file, "place", "name", "n", "bits", lattice_join(F.col("bits")).alias("kind"))


def swaps(names: DataFrame, files: DataFrame, source: list[str], order: str, file: list[str], places: list[str]) -> DataFrame:
    """place, gone, come, n: how often one name went and another came from a file to the next of its source.

    As many rows as pairs of names at a place, whatever the number of files.
    """
    sets = names.groupBy(*file, "place").agg(F.collect_set("name").alias("held"))
    grid = files.select(*file).distinct().withColumn("place", F.explode(F.array(*map(F.lit, places))))
    filled = grid.join(sets, [*file, "place"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    step = before(filled, [*source, "place"], order, ["held"]).where("has_prev AND held <> prev_held")
    gone = step.select("place", F.explode(F.array_except("prev_held", "held")).alias("gone"), F.array_except("held", "prev_held").alias("new"))
    return gone.select("place", "gone", F.explode("new").alias("come")).groupBy("place", "gone", "come").agg(F.count("*").alias("n"))


def aliases(replaced: Iterable[tuple[str, str, str, int]], place: str, name: str, met: set[frozenset] = frozenset(), like: set[frozenset] = frozenset()) -> list[str]:
    """``name`` and the other names of the same field at ``place``.

    ``replaced``: rows of ``swaps``; ``met``: pairs of names that stand in one file; ``like``: pairs of names that stand
    among the same other keys. A name is taken if it has replaced, or been replaced by, a name already taken, or at least
    stands where one of those does, and has met none of them. The most often replaced comes first (ties: by name).
    """
    weight = {pair: 0 for two in like for pair in (tuple(sorted(two)), tuple(sorted(two))[::-1])}
    for at, gone, come, n in replaced:
        if at == place:
            for pair in ((gone, come), (come, gone)):
                weight[pair] = weight.get(pair, 0) + n
    taken = [name]
    while True:
        scores: dict[str, int] = {}
        for (a, b), n in weight.items():
            if a in taken and b not in taken and not any(frozenset((b, t)) in met for t in taken):
                scores[b] = scores.get(b, 0) + n
        if not scores:
            return taken
        taken.append(min(scores, key=lambda k: (-scores[k], k)))


def alike(found: DataFrame) -> DataFrame:
    """place, a, b (a < b): pairs of names of which one stands in an object with just the other keys that the other has
    beside it in another; as many rows as the schemas have pairs."""
    sets = found.groupBy("place", "keys").count()
    rest = sets.select("place", "keys", F.explode("keys").alias("name")).groupBy("place", F.array_except("keys", F.array("name")).alias("rest")).agg(F.collect_set("name").alias("held"))
    return rest.select("place", "held", F.explode("held").alias("a")).select("place", "a", F.explode("held").alias("b")).where("a < b").distinct()


def beside(names: DataFrame, file: list[str]) -> DataFrame:
    """place, a, b (a < b): pairs of names that stand in one file at least once; as many rows as the schemas have pairs."""
    sets = names.groupBy(*file, "place").agg(F.array_sort(F.collect_set("name")).alias("held")).groupBy("place", "held").count()
    first = sets.select("place", "held", F.explode("held").alias("a"))
    return first.select("place", "a", F.explode("held").alias("b")).where("a < b").distinct()


def json_type(kind: Column) -> Column:
    """JSON's own type of a kind: string, number, boolean, object or array."""
    return F.when(kind.isin("bigint", "double"), "number").otherwise(kind)


def file_fields(names: DataFrame, files: DataFrame, file: list[str], fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One row for each of ``files`` and field: ``file`` columns, field_name, name, kind (NULL where it has none).

    ``fields``: {field: (place, its names)}; ``names`` as ``file_names`` gives them. Its type in a file is the join of the
    kinds it has there under all its names, its name the one of most of its objects (ties: the first in byte order).
    """
    table = names.sparkSession.createDataFrame([(field, place, name) for field, (place, of) in fields.items() for name in of], "field_name string, place string, name string")
    held = names.join(F.broadcast(table), ["place", "name"])
    best = held.groupBy(*file, "field_name").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("name"), json_type(lattice_join(F.bit_or("bits"))).alias("kind"))
    grid = files.select(*file).distinct().withColumn("field_name", F.explode(F.array(*map(F.lit, fields))))
    return grid.join(best, [*file, "field_name"], "left").select(*file, "field_name", "name", "kind")


def before(df: DataFrame, keys: list[str], order: str, columns: list[str], block: int = 1024) -> DataFrame:
    """``df`` with ``prev_<column>`` of the row before in ``keys`` by ``order``, and ``has_prev``.

    Rows with a NULL key or order have no place in an order and are left out.

    Works block by block of the order, so a key with a third of all rows does not end up in one task: only the last
    row of each block goes on to the second step.
    """
    w = Window.partitionBy(*keys, "b_block").orderBy(order)
    held = F.struct(*columns)
    inner = df.withColumn("b_block", F.floor(F.col(order) / block)).withColumn("b_prev", F.lag(held).over(w))
    last = inner.groupBy(*keys, "b_block").agg(F.max_by(held, order).alias("b_last"))
    carried = last.select(*keys, "b_block", F.lag("b_last").over(Window.partitionBy(*keys).orderBy("b_block")).alias("b_carried"))
    joined = inner.join(carried, [*keys, "b_block"]).withColumn("b_prev", F.coalesce("b_prev", "b_carried"))
    return joined.select(*df.columns, F.col("b_prev").isNotNull().alias("has_prev"), *(F.col("b_prev")[c].alias(f"prev_{c}") for c in columns))


def changes(fields: DataFrame, source: list[str], order: str) -> DataFrame:
    """``fields`` rows with change_kind for each change from the file before in ``source`` by ``order``.

    added, removed, renamed (another name) and retyped (another JSON type); a field may be renamed and retyped at
    once, which gives two rows. The first file of a source changes nothing.
    """
    compared = before(fields, [*source, "field_name"], order, ["name", "kind"]).where("has_prev")
    now, prev = F.col("name").isNotNull(), F.col("prev_name").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(now & ~prev, "added"),
            F.when(prev & ~now, "removed"),
            F.when(now & prev & (F.col("name") != F.col("prev_name")), "renamed"),
            F.when(now & prev & (F.col("kind") != F.col("prev_kind")), "retyped"),
        )
    )
    return compared.withColumn("change_kind", F.explode(kinds)).drop("has_prev")


def unified(df: DataFrame, text: str, fields: dict[str, tuple[list[str], list[str], str]]) -> DataFrame:
    """``df`` with a column for each field, read under whichever of its names a record uses and cast to its union type.

    ``fields``: {column: (path of the object, its names, union type)}. json and string columns hold decoded strings, or
    the JSON text of other values. Records without the field, and rows without a JSON object, get NULL.
    """
    tree: dict = {}
    for path, names, _ in fields.values():
        at = tree
        for key in path:
            below = at.get(key)
            if not isinstance(below, dict):
                below = at[key] = {}
            at = below
        for name in names:
            at.setdefault(name, "string")

    def ddl(node: dict) -> str:
        return ", ".join(f"`{k.replace('`', '``')}` {v if isinstance(v, str) else f'struct<{ddl(v)}>'}" for k, v in node.items())

    def value(path: list[str], name: str) -> Column:
        column, node = F.col("d_rec"), tree
        for key in [*path, name]:
            column, node = column[key], node[key]
        return F.to_json(column) if isinstance(node, dict) else column

    cast: Callable[[Column, str], Column] = lambda c, kind: c if kind in ("json", "string", "null") else c.try_cast(kind)
    read = df.withColumn("d_rec", json_object(F.col(text), ddl(tree)))
    return read.select(*df.columns, *(cast(F.coalesce(*(value(path, n) for n in names)), kind).alias(column) for column, (path, names, kind) in fields.items()))
