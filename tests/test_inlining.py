import json

import pytest

from commitlake.functions import jsonx
from commitlake.operators import inlining

RECORDS = [
    {"role": "a", "tokens": {"input": 1, "cache": {"read": 2}}, "parts": [{"tokens": {"input": 0}}, {"messages": [{"tokens": {"input": 5}}, {"tokens": None}]}]},
    {"tokens": [{"input": 7}, {"input": None}], "path": {"root": "/x"}, "tags": ["p", "q"]},
    {"tokens": {"input": False}, "deep": [[{"tokens": {"input": "9"}}]]},
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "row_id long, raw string, columns string")


def edges_of(spark, df):
    return [tuple(r) for r in inlining.schema_graph(df, "raw").collect()]


def test_tables_by_shared_inlining():
    edges = [("", "a", "object", False), ("a", "x", "object", False), ("", "b", "object", False), ("b", "x", "object", False), ("", "many", "object", True), ("b", "only", "object", False)]
    assert inlining.table_elements(edges) == {"", "x", "many"}
    loop = [("", "n", "object", False), ("n", "m", "object", False), ("m", "n", "object", False)]
    assert "n" in inlining.table_elements(loop) or "m" in inlining.table_elements(loop)


def test_children_at_any_depth(spark):
    df = frame(spark, [*map(json.dumps, RECORDS), '{"tokens": {"input": 1', "", None, "[1]", '{"tok\\u0065ns": {"input": 3}}'])
    rows = inlining.shred(df, "raw", "row_id", edges_of(spark, df), "data", {"tokens": ["input"]})
    got = sorted((r["row_id"], f"{r['path']}.{c}") for r in rows.collect() for c in r["columns"])
    assert got == [
        (0, "data.parts[0].tokens.input"), (0, "data.parts[1].messages[0].tokens.input"), (0, "data.tokens.input"),
        (1, "data.tokens[0].input"), (2, "data.deep[0][0].tokens.input"), (2, "data.tokens.input"), (7, "data.tokens.input"),
    ]


def test_foreign_keys_and_columns(spark):
    df = frame(spark, map(json.dumps, RECORDS))
    edges = edges_of(spark, df)
    rows = inlining.shred(df, "raw", "row_id", edges).cache()
    keys = {(r["row_id"], r["path"]) for r in rows.collect()}
    assert all((r["row_id"], r["parent_path"]) in keys for r in rows.collect() if r["element"] != "")
    tokens = inlining.flat_table(rows, "row_id", "tokens", edges)
    assert {"f_input", "f_cache_read"} <= set(tokens.columns)
    first = tokens.where("row_id = 0 AND path = 'tokens'").first()
    assert (first["f_input"], first["f_cache_read"], first["parent_path"]) == ("1", "2", "")
    tags = inlining.shred(df, "raw", "row_id", edges).where("element = 'tags'").collect()
    assert sorted((r["position"], r["columns"]["value"]) for r in tags) == [("0", "p"), ("1", "q")]


def test_maps_become_one_element(spark):
    df = frame(spark, [json.dumps({"models": {f"m{i}": {"usage": {"n": i}}}}) for i in range(12)])
    edges = [tuple(r) for r in inlining.schema_graph(df, "raw", max_children=5).collect()]
    assert ("models", "models/*", "object", True) in edges and ("models/*", "usage", "object", False) in edges
    assert not any(e[0].startswith("m") and not e[0].startswith("models") for e in edges)


def leaves(value, path=""):
    """Every scalar of a record with its path, by plain recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    elif value is not None:
        yield path, value if isinstance(value, str) else json.dumps(value)


def cells(rows):
    """Every value of the flat tables with its path."""
    out = []
    for r in rows:
        for name, cell in r["columns"].items():
            item = name == "value" and len(r["columns"]) == 1
            keys = name.replace("\\.", "\0").replace("\\\\", "\\").split(".")
            below = ".".join(keys).replace("\0", ".")
            if cell not in ("{}", "[]"):
                out.append((r["path"] if item and r["scalar"] else f"{r['path']}.{below}" if r["path"] else below, cell))
    return sorted(out)


def test_a_map_beside_an_ordinary_element_loses_nothing(spark):
    """A map of 301 keys, one of them the name of an ordinary element elsewhere; maps in maps; scalars and arrays in them."""
    record = {
        "m": {**{f"k{i}": {"x": i, "deep": {"y": [i]}} for i in range(300)}, "tokens": {"a": 7, "b": "8"}},
        "tokens": {"a": 1, "b": 2, "c.d": 3, "c": {"d": 4}},
        "n": {f"q{i}": i for i in range(250)} | {"list": [1, [2, {"z": 3}]], "none": None, "empty": []},
        "mm": {f"o{i}": {f"p{i}_{j}": {"v": i} for j in range(2)} for i in range(210)},
    }
    df = frame(spark, [json.dumps(record)])
    edges = edges_of(spark, df)
    assert {"m/*", "n/*", "mm/*"} <= inlining.table_elements(edges)
    rows = inlining.shred(df, "raw", "row_id", edges).collect()
    scalars = {r["path"] for r in rows if r["element"] in ("n/*", "y") and set(r["columns"]) == {"value"}}
    got = cells([{**r.asDict(), "scalar": r["path"] in scalars or r["path"].endswith("]")} for r in rows])
    assert got == sorted(leaves(record))
    keys = {r["path"] for r in rows}
    assert len(keys) == len(rows) and all(r["parent_path"] in keys for r in rows if r["element"])
    root = inlining.flat_table(inlining.shred(df, "raw", "row_id", edges), "row_id", "", edges).first().asDict()
    assert (root["f_tokens_a"], root["f_tokens_b"]) == ("1", "2")
    assert sorted(v for k, v in root.items() if k.startswith("f_tokens_c_d")) == ["3", "4"]
    entries = inlining.flat_table(inlining.shred(df, "raw", "row_id", edges), "row_id", "m/*", edges)
    assert {r["position"]: r["f_a"] for r in entries.collect()}["tokens"] == "7"
    items = inlining.flat_table(inlining.shred(df, "raw", "row_id", edges), "row_id", "n/*", edges)
    assert {r["f_value"] for r in items.collect()} >= {"0", "249", "1", "2"}


def test_any_depth_no_nan_and_lone_surrogates(spark):
    deep = '{"a":' * 20_000 + '{"tokens":{"input":1}}' + "}" * 20_000
    df = frame(spark, [deep, '{"a":' * 20_000 + "}", '{"tokens":{"input":NaN}}', '{"tokens":{"input":"\\ud800"}}'])
    rows = inlining.shred(df, "raw", "row_id", edges_of(spark, df), "", {"tokens": ["input"]}).collect()
    assert sorted((r["row_id"], list(r["columns"].values())) for r in rows) == [(0, ["1"]), (3, ["?"])]


def test_parser_without_recursion():
    value = {"a": [1, -2.5e3, {"b": [[], {}, 'x\u00e9"\\']}, None, True, False], "": {"c": ""}}
    for indent in (None, 2):
        assert jsonx._parse_deep(json.dumps(value, indent=indent)) == value
    for bad in ("", "{", '{"a":}', "[1,]", '{"a":1,}', "1 2", "NaN", '{"a" 1}', "[1 2]", "tru", "{1:2}", "[1}", '{"a":1]', "01"):
        with pytest.raises(ValueError):
            jsonx._parse_deep(bad)


def test_empty_table_and_deep_nesting(spark):
    assert inlining.schema_graph(frame(spark, []), "raw").count() == 0
    text = '{"a":' * 400 + '{"tokens":{"input":1}}' + "}" * 400
    df = frame(spark, [text, text])
    rows = inlining.shred(df, "raw", "row_id", edges_of(spark, df), "", {"tokens": ["input"]})
    assert rows.count() == 2
