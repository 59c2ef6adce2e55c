import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitlake.llm import packing

ITEM = st.tuples(st.integers(0, 40), st.integers(-1, 3), st.integers(0, 2))


def check(items, capacity, apart, out):
    """Every token once, no container too full, no item cut that fits, no conflict in a container."""
    spans, boxes = {}, {}
    for item, piece, start, box, place, offset in out:
        size = min(capacity, items[item][0] - start)
        spans.setdefault(item, []).append((piece, start, size))
        boxes.setdefault(box, []).append((place, offset, size, item))
    for item, (size, _, _) in enumerate(items):
        held = sorted(spans[item])
        assert [p for p, _, _ in held] == list(range(len(held))) and sum(s for *_, s in held) == size
        assert len(held) == 1 or size > capacity
    for held in boxes.values():
        held.sort()
        at = 0
        for n, (place, offset, size, _) in enumerate(held):
            assert (place, offset) == (n, at)
            at += size
        assert at <= capacity
        whole = [items[i] for *_, i in held]
        clusters = [c for _, c, _ in whole if c >= 0]
        assert len(clusters) == len(set(clusters))
        sources = {1 << s for *_, s in whole}
        assert not any(apart.get(s, 0) & t for s in sources for t in sources if s != t)
    return len(boxes)


@settings(max_examples=200, deadline=None)
@given(st.lists(ITEM, max_size=40), st.integers(1, 25))
def test_any_items(items, capacity):
    apart = {1 << 1: 1 << 2, 1 << 2: 1 << 1}
    check(items, capacity, apart, packing.pack(items, capacity, apart))


def best_fit(sizes, capacity):
    """Plain best-fit decreasing by looking at every container."""
    boxes = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in range(len(boxes)) if boxes[b] >= size]
        if fits:
            boxes[min(fits, key=lambda b: boxes[b])] -= size
        else:
            boxes.append(capacity - size)
    return len(boxes)


def test_as_good_as_plain_best_fit():
    random.seed(4)
    for _ in range(20):
        sizes = [random.randint(1, 100) for _ in range(200)]
        out = packing.pack([(s, -1, 0) for s in sizes], 100)
        assert check([(s, -1, 0) for s in sizes], 100, {}, out) == best_fit(sizes, 100)


def test_a_hot_cluster_is_spread():
    items = [(3, 0, 0)] * 300 + [(2, -1, 0)] * 600
    assert check(items, 10, {}, packing.pack(items, 10)) == 300


def test_capacity_must_hold_something():
    with pytest.raises(ValueError):
        packing.pack([(1, -1, 0)], 0)


def test_frames(spark):
    rows = [(i, random.randint(0, 90), random.choice(["a", "b", None]), 7 if i % 10 == 0 else None, "clash") for i in range(300)] + [(300, None, "a", None, None), (1, 4, "a", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster long, shard string")
    got = packing.fill(df, key="doc_id", size="n", capacities=[32, 64], source="source", cluster="cluster", apart=[("a", "b")], shard_items=100).collect()
    for capacity in (32, 64):
        mine = [r for r in got if r["capacity"] == capacity]
        assert sum(r["piece_size"] for r in mine) == sum(r[1] or 0 for r in rows)
        assert {r["doc_id"] for r in mine} == {r[0] for r in rows}
        full = {}
        for r in mine:
            full[r["container_id"]] = full.get(r["container_id"], 0) + r["piece_size"]
        assert max(full.values()) <= capacity
    assert packing.fill(df.limit(0), key="doc_id", size="n", capacities=[8], source="source", cluster="cluster").count() == 0


def test_duplicate_clusters(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "doc_id long, h long")
    assert sorted((r["doc_id"], r["cluster"]) for r in packing.duplicate_clusters(df, "h").collect()) == [(1, 5), (2, 5), (3, None), (4, None)]
