import random

from commitlake.operators import hierarchy


def brute(parent):
    """(root, depth) of every node by walking up; -1 and the smallest id of the loop on and below loops."""
    out = {}
    for node in parent:
        seen, at = [], node
        while at not in seen and parent.get(at) in parent and parent.get(at) is not None:
            seen.append(at)
            at = parent[at]
        out[node] = (min(seen[seen.index(at) :]), -1) if at in seen else (at, len(seen))
    return out


def run(spark, parent, paths=False):
    copies = spark.createDataFrame([(0, n, p, "clash") for n, p in parent.items()], "tree int, node string, parent string, up string")
    return hierarchy.resolve(hierarchy.links(copies, ["tree"], "node", "parent"), ["tree"], paths=paths)


def test_against_brute_force(spark):
    random.seed(11)
    for size in (1, 40, 300):
        parent = {f"n{i}": random.choice([None, f"n{random.randrange(size)}", f"n{max(0, i - 1)}", "gone"]) for i in range(size)}
        got = {r["node"]: (r["root_id"], r["node_depth"]) for r in run(spark, parent).collect()}
        assert got == brute(parent)


def test_chain_star_and_loops(spark):
    parent = {f"c{i:03d}": (f"c{i - 1:03d}" if i else None) for i in range(130)}
    parent |= {f"s{i}": "c064" for i in range(50)} | {"self": "self", "x": "y", "y": "x", "z": "x", "zz": "z"}
    resolved = run(spark, parent, paths=True).cache()
    rows = {r["node"]: r for r in resolved.collect()}
    assert (rows["c129"]["root_id"], rows["c129"]["node_depth"]) == ("c000", 129)
    assert rows["s7"]["path"] == [f"c{i:03d}" for i in range(65)] + ["s7"]
    assert [(rows[n]["root_id"], rows[n]["node_depth"], rows[n]["path"]) for n in ("self", "x", "zz")] == [("self", -1, None), ("x", -1, None), ("x", -1, None)]
    pairs = hierarchy.descendants(resolved, ["tree"])
    assert pairs.where("ancestor_id = 'c127'").count() == 2
    assert pairs.count() == sum(r["node_depth"] for r in rows.values() if r["node_depth"] > 0)


def test_links_of_copies(spark):
    copies = spark.createDataFrame([("a", None), ("a", "b"), ("b", ""), ("b", None), (None, "b"), ("c", "missing")], "node string, parent string")
    got = {r["node"]: r["parent"] for r in hierarchy.links(copies.replace("", None, ["parent"]), [], "node", "parent").collect()}
    assert got == {"a": "b", "b": None, "c": None}


def test_empty(spark):
    assert run(spark, {"a": None}).where("node = 'b'").count() == 0
    empty = spark.createDataFrame([], "tree int, node string, parent string")
    assert hierarchy.resolve(hierarchy.links(empty, ["tree"], "node", "parent"), ["tree"]).count() == 0
