"""Items into containers of fixed capacity: conflict-constrained best-fit over shards.

Items are spread over shards of bounded size by the hash of their key; every shard is packed on its own, items with
copies first (they have the fewest containers to go to), then the others, each from the largest to the smallest, into the container whose residual is the least that still takes it. Containers are ordered by residual in
buckets under one bit mask, so the successor search (the tightest residual not yet tried) is a bit operation. A
container carries a bitmap of its duplicate clusters and of its sources; where either conflicts with the item, the
search goes on to the next tighter container. An item that is larger than the capacity is cut into full pieces and a
rest; no other item is ever cut. Copies of one text (a cluster) are never put into one container.

A shard leaves about one container partly filled, which is one in thousands at ``SHARD_ITEMS`` items; shards do not
wait for each other and no task holds more than its shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a shard holds on average; its memory and time are bounded by it.
SHARD_ITEMS = 50_000


class Containers:
    """Open containers of one capacity, by residual."""

    def __init__(self, capacity: int, apart: dict[int, int] | None = None) -> None:
        self.capacity = capacity
        self.apart = apart or {}  # source bit -> mask of the sources it may not meet
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.count: list[int] = []
        self._buckets: dict[int, dict[int, None]] = {}  # residual -> containers in order of arrival
        self._mask = 0  # bit r: some container has residual r

    def _put(self, box: int, residual: int) -> None:
        self.residual[box] = residual
        self._buckets.setdefault(residual, {})[box] = None
        self._mask |= 1 << residual

    def _take(self, box: int) -> None:
        bucket = self._buckets[self.residual[box]]
        del bucket[box]
        if not bucket:
            del self._buckets[self.residual[box]]
            self._mask ^= 1 << self.residual[box]

    def tightest(self, size: int, cluster: int, source: int) -> Iterator[int]:
        """Containers that take the item, tightest first; the caller may fill one before asking for the next."""
        at = size
        while (rest := self._mask >> at) > 0:
            at += (rest & -rest).bit_length() - 1
            for box in list(self._buckets.get(at, ())):
                if not self.clusters[box] & cluster and not self.sources[box] & self.apart.get(source, 0):
                    yield box
            at += 1

    def open(self) -> int:
        self.residual.append(0)
        self.clusters.append(0)
        self.sources.append(0)
        self.count.append(0)
        self._put(len(self.residual) - 1, self.capacity)
        return len(self.residual) - 1

    def add(self, box: int, size: int, cluster: int, source: int) -> tuple[int, int]:
        """Put an item into a container; its place and the offset it starts at."""
        place, offset = self.count[box], self.capacity - self.residual[box]
        self._take(box)
        self.clusters[box] |= cluster
        self.sources[box] |= source
        self.count[box] += 1
        self._put(box, self.capacity - offset - size)
        return place, offset


def pack(items: list[tuple[int, int, int]], capacity: int, apart: dict[int, int] | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, start, container, place, offset) of every piece of ``items`` (size, cluster, source).

    ``cluster``: number of the item's duplicate cluster, negative where it has none. ``source``: number of its source;
    ``apart`` gives for a source's bit the mask of the sources it may not share a container with. Items of size 0 take
    a place in the tightest container. Ties go to the container opened first.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least 1")
    out: list[tuple[int, int, int, int, int, int]] = []
    boxes = Containers(capacity, apart)
    rests = []
    for number, (size, cluster, source) in enumerate(items):
        pieces = size // capacity if size > capacity else 0
        bit = 1 << cluster if cluster >= 0 else 0
        for piece in range(pieces):
            box = boxes.open()
            place, offset = boxes.add(box, capacity, bit, 1 << source)
            out.append((number, piece, piece * capacity, box, place, offset))
        if size > pieces * capacity or size == 0:
            rests.append((size - pieces * capacity, cluster, source, number, pieces))
    rests.sort(key=lambda r: (r[1] < 0, -r[0], r[1], r[2], r[3]))
    run: tuple | None = None
    search: Iterator[int] = iter(())
    for size, cluster, source, number, piece in rests:
        bit = 1 << cluster if cluster >= 0 else 0
        if not bit or run != (size, cluster, source):  # copies in a row share one search: what it passed stays in conflict
            run, search = (size, cluster, source), boxes.tightest(size, bit, 1 << source)
        box = next(search, None)
        if box is None:
            box = boxes.open()
        place, offset = boxes.add(box, size, bit, 1 << source)
        out.append((number, piece, piece * capacity, box, place, offset))
    return out


PACKED = "container_id bigint, place bigint, offset bigint, piece bigint, piece_start bigint, piece_size bigint"


def fill(items: DataFrame, *, key: str, size: str, capacities: list[int], source: str, cluster: str, apart: list[tuple[str, str]] = (), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Where every piece of every item lies, for each capacity: capacity, ``key`` and the columns of PACKED.

    ``cluster`` (bigint) is the same for copies of one text and NULL for an item without copies. ``apart``: pairs of
    source names that may not share a container. container_id is unique within a capacity; place counts from 0 in
    it, offset is where the piece starts in it, piece_start where it starts in the item. A NULL size counts as 0, a
    NULL source as a source of its own. An empty table gives an empty result; repeated rows are packed each.
    """
    names = sorted({n for pair in apart for n in pair})
    bits = {name: i + 1 for i, name in enumerate(names)}
    against: dict[int, int] = {}
    for a, b in apart:
        against[1 << bits[a]] = against.get(1 << bits[a], 0) | 1 << bits[b]
        against[1 << bits[b]] = against.get(1 << bits[b], 0) | 1 << bits[a]
    shards = max(1, -(-items.count() // shard_items))
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"), F.col(source).alias("source"), F.col(cluster).alias("cluster"))
    spread = rows.withColumn("capacity", F.explode(F.array(*(F.lit(int(c)).cast("bigint") for c in sorted(set(capacities))))))

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard, capacity = int(keys[0]), int(keys[1])
        frame = frame.sort_values(["size", "item"], ascending=[False, True], kind="stable", ignore_index=True)
        numbers = {c: i for i, c in enumerate(frame["cluster"].dropna().unique())}
        clusters = [numbers[c] if c is not None and c == c else -1 for c in frame["cluster"]]
        sources = [bits.get(s, 0) for s in frame["source"]]
        found = pack(list(zip(frame["size"].astype("int64").tolist(), clusters, sources, strict=True)), capacity, against)
        sizes, ids = frame["size"].astype("int64").tolist(), frame["item"].tolist()
        return pd.DataFrame(
            [(capacity, ids[i], (shard << 40) + box, place, offset, piece, start, min(capacity, sizes[i] - start)) for i, piece, start, box, place, offset in found],
            columns=["capacity", key, "container_id", "place", "offset", "piece", "piece_start", "piece_size"],
        )

    return spread.groupBy("shard", "capacity").applyInPandas(run, f"capacity bigint, `{key}` {kind}, {PACKED}")


def duplicate_clusters(items: DataFrame, text_hash: str) -> DataFrame:
    """``items`` with ``cluster``: the text hash where two or more items share it, else NULL.

    The hashes are counted before they are joined, so a text that a third of all rows share is one row of the count;
    the join splits its partition.
    """
    several = items.where(F.col(text_hash).isNotNull()).groupBy(text_hash).count().where("count > 1").select(text_hash, F.col(text_hash).alias("cluster"))
    return items.join(several, text_hash, "left")

