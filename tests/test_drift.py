import json

import pytest

from commitlake.operators import drift

FILE = ["install", "file", "seq"]


def frame(spark, files):
    rows = [(inst, name, seq, json.dumps(r) if isinstance(r, dict) else r, "clash") for inst, name, seq, records in files for r in records]
    return spark.createDataFrame(rows, "install string, file string, seq int, raw string, keys string")


FILES = [
    ("i", "f1", 1, [{"type": "a", "at": 1}, {"type": None, "at": 2}, "{torn"]),
    ("i", "f2", 2, [{"kind": "a", "at": 1}, {"kind": "b", "at": 2}]),
    ("i", "f3", 3, [{"kind": 3, "at": 1, "n": 1}]),
    ("i", "f4", 4, [{"at": 1, "n": 2}]),
    ("i", "f5", 5, [{"type": {"name": "a"}, "at": 1, "n": 2}]),
    ("i", "f6", 7, [{"kind": ["a"], "at": 1, "n": 2}]),
    ("j", "g1", 1, [{"at": 1}]),
    ("j", "g2", 2, [{"type": "a", "at": 1}]),
]
WANT = [("f2", "renamed"), ("f3", "retyped"), ("f4", "removed"), ("f5", "added"), ("f6", "renamed"), ("f6", "retyped"), ("g2", "added")]


def known_names(df, found, names):
    replaced = [tuple(r) for r in drift.swaps(names, df.select(*FILE).distinct(), ["install"], "seq", FILE, [""]).collect()]
    met = {frozenset((r["a"], r["b"])) for r in drift.beside(names, FILE).collect()}
    like = {frozenset((r["a"], r["b"])) for r in drift.alike(found).collect()}
    return drift.aliases(replaced, "", "type", met, like)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_changes(spark, block, monkeypatch):
    df = frame(spark, FILES)
    found = drift.signatures(df, "raw", FILE, [""]).cache()
    names = drift.file_names(found, FILE).cache()
    assert known_names(df, found, names) == ["type", "kind"]
    held = drift.file_fields(names, df, FILE, {"type": ("", ["type", "kind"])})
    before = drift.before
    monkeypatch.setattr(drift, "before", lambda *a: before(*a, block=block))
    assert sorted((r["file"], r["change_kind"]) for r in drift.changes(held, ["install"], "seq").collect()) == WANT


def test_an_unrelated_field_is_no_new_name(spark):
    """``extra`` comes where ``type`` goes, but stands beside it in another file."""
    files = [("i", "f1", 1, [{"type": "a", "at": 1}]), ("i", "f2", 2, [{"extra": "x", "at": 1}]), ("i", "f3", 3, [{"type": "a", "at": 1}, {"extra": "x", "at": 2}])]
    df = frame(spark, files)
    found = drift.signatures(df, "raw", FILE, [""]).cache()
    assert known_names(df, found, drift.file_names(found, FILE)) == ["type"]


def test_the_type_of_a_file_is_the_join_of_its_kinds(spark):
    df = frame(spark, [("i", "f1", 1, [{"type": 1}, {"type": 2.5}, {"type": None}]), ("i", "f2", 2, [{"type": 1}, {"type": "x"}]), ("i", "f3", 3, [{"type": "x"}, {"type": {}}]), ("i", "f4", 4, [{"type": True}])])
    names = drift.file_names(drift.signatures(df, "raw", FILE, [""]), FILE)
    assert {r["file"]: r["kind"] for r in names.collect()} == {"f1": "double", "f2": "string", "f3": "json", "f4": "boolean"}
    held = drift.file_fields(names, df, FILE, {"type": ("", ["type"])})
    assert {r["file"]: r["kind"] for r in held.collect()} == {"f1": "number", "f2": "string", "f3": "json", "f4": "boolean"}


def test_places_of_any_depth_and_variants(spark):
    df = frame(spark, [("i", "f", 1, [{"payload": {"type": "count", "info": {}}}, {"payload": {"type": "o" * 100, "details": 1}}, {"a": {"b": {"c": {"d": 1}}}}])])
    places = {(r["place"], tuple(r["keys"])) for r in drift.signatures(df, "raw", FILE, ["payload<count>", f"payload<{'o' * 100}>", "a.b.c"]).collect()}
    assert places == {("payload<count>", ("info", "type")), (f"payload<{'o' * 100}>", ("details", "type")), ("a.b.c", ("d",))}


def test_lattice():
    assert drift.union_type(["bigint", "double"]) == "double"
    assert drift.union_type(["bigint", "null", None]) == "bigint"
    assert drift.union_type(["boolean", "bigint"]) == "string"
    assert drift.union_type(["string", "object"]) == "json"
    assert drift.union_type(["array"]) == "json"
    assert drift.union_type([]) == "null"


def test_unified(spark):
    df = frame(spark, FILES)
    got = drift.unified(df.select("file", "raw"), "raw", {"type": ([], ["type", "kind"], "json"), "n": ([], ["n"], "bigint")}).collect()
    values = {(r["file"], r["type"]) for r in got}
    assert {("f1", "a"), ("f1", None), ("f2", "b"), ("f3", "3"), ("f5", '{"name":"a"}'), ("f6", '["a"]')} <= values
    assert {r["n"] for r in got if r["file"] == "f4"} == {2}


def test_empty(spark):
    df = frame(spark, [("i", "f", 1, [None, ""])])
    found = drift.signatures(df, "raw", FILE, [""])
    assert found.count() == 0
    names = drift.file_names(found, FILE)
    assert known_names(df, found, names) == ["type"]
    held = drift.file_fields(names, df, FILE, {"type": ("", ["type"])})
    assert [(r["name"], r["kind"]) for r in held.collect()] == [(None, None)]
    assert drift.changes(held, ["install"], "seq").count() == 0
