"""Exactly one copy of each identifier, over batches that arrive one after another.

``IdentifierIndex`` keeps all identifiers seen so far in immutable runs. A run is a folder of Parquet files, one
partition for each prefix of the identifier's 64-bit hash, sorted by that hash. An incoming batch is first reduced to
the first occurrence of each identifier (combined before the shuffle, so an identifier that holds a third of all rows
is one row for each map task), then sorted by prefix and hash; each task binary-searches the sorted hash arrays of the
runs for its prefixes, compares the identifiers themselves on a hit, and writes what is new as the next run. Every
``merge_every`` runs are merged into one. Runs are disjoint, so a merge neither loses nor repeats anything.

The length of the prefix follows the number of identifiers, so that one prefix always fits a task: it is set when the
first batch comes, is part of a run's name, and is raised by the merge that finds the index grown.

The kept occurrences are the payload of the runs. All others are surplus: an anti-join on the row's own key, which is
unique, so no hot identifier ever gathers in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from commitlake.session import materialise, remove_path, scratch_path

_RUN = re.compile(r"run-(\d+)-(\d+)-b(\d+)$")
#: Identifiers of one prefix, about 40 MB of hashes and texts in a task.
IDS_PER_PREFIX = 1 << 19
#: Names under which Hadoop knows a scheme that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_SEARCHED = ["h", "scope", "id"]


def prefix_bits(identifiers: int) -> int:
    """The least prefix length with at most IDS_PER_PREFIX of so many identifiers on average, but 8 partitions."""
    return min(24, max(3, (-(-identifiers // IDS_PER_PREFIX) - 1).bit_length()))


def _arrow_files(run: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a run's folder and the path in it; ArrowInvalid or NotImplementedError where it has none."""
    scheme, mark, rest = run.partition("://")
    if mark:
        return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
    return pafs.FileSystem.from_uri(run) if run.startswith("file:") else (pafs.LocalFileSystem(), run)


def _read_prefix(run: str, prefix: int) -> pa.Table:
    """The sorted hash and identifier arrays of one prefix of a run; empty where the run has none."""
    files, root = _arrow_files(run)
    found = files.get_file_info(pafs.FileSelector(f"{root}/prefix={prefix}", allow_not_found=True))
    tables = [pq.read_table(f.path, columns=_SEARCHED, filesystem=files, partitioning=None) for f in found if f.path.endswith(".parquet")]
    if not tables:
        return pa.table({"h": pa.array([], pa.int64()), "scope": pa.array([], pa.string()), "id": pa.array([], pa.string())})
    merged = pa.concat_tables(tables)
    return merged if len(tables) == 1 else merged.sort_by("h")


def _known(batch: pa.Table, run: pa.Table) -> np.ndarray:
    """Which rows of ``batch`` have their identifier in ``run``, which is sorted by h."""
    held, asked = run["h"].to_numpy(), batch["h"].to_numpy()
    low, high = np.searchsorted(held, asked, "left"), np.searchsorted(held, asked, "right")
    hit = np.zeros(len(asked), bool)
    at = np.flatnonzero(high > low)
    step = 0
    while len(at):  # one round, but for identifiers of one hash
        there, here = pa.array(low[at] + step), pa.array(at)
        same = [pc.equal(run[c].take(there), batch[c].take(here)).to_numpy(zero_copy_only=False) for c in ("id", "scope")]
        hit[at] |= same[0] & same[1]
        step += 1
        at = at[(low[at] + step < high[at]) & ~hit[at]]
    return hit


def _novel(part: pa.Table, runs: list[pa.Table]) -> pa.Table:
    known = np.zeros(len(part), bool)
    for run in runs:
        known |= _known(part, run)
    return part.filter(pa.array(~known))


def _search(runs: list[str]):
    """Arrow function that passes on the identifiers found in none of ``runs``."""

    def novel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: tuple[int, list[pa.Table]] = (-1, [])
        for record in batches:
            whole = pa.Table.from_batches([record])
            prefixes = record["prefix"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(prefixes)) + 1), len(prefixes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                prefix = int(prefixes[a])
                if loaded[0] != prefix:
                    loaded = (prefix, [_read_prefix(run, prefix) for run in runs])
                yield from _novel(whole.slice(a, b - a), loaded[1]).to_batches()

    return novel


def _search_group(batch: pa.Table, index: pa.Table) -> pa.Table:
    """The same for one prefix whose part of the index Spark has read."""
    return _novel(batch, [index.select(_SEARCHED).sort_by("h")])


class IdentifierIndex:
    """Persistent set of (scope, id) in a folder all executors share; opening an existing folder goes on with it.

    Tasks open the runs' files by Arrow; where it does not know the file system, or with ``by_spark``, Spark reads them
    and each prefix is searched in a cogroup of the batch and the index.
    """

    def __init__(self, spark: SparkSession, path: str, merge_every: int = 8, by_spark: bool = False) -> None:
        self.spark, self.path, self.merge_every = spark, path.rstrip("/"), merge_every
        self._schema: StructType | None = None
        try:
            _arrow_files(self.path)
            self.by_spark = by_spark
        except (pa.ArrowInvalid, NotImplementedError, OSError):
            self.by_spark = True

    def runs(self) -> list[str]:
        """Folders of the valid runs in order. A merged run covers the runs it was made of, should these still exist."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        spans = {}
        for status in files.listStatus(root):
            found = _RUN.search(str(status.getPath().getName()))
            if found and files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                spans[int(found[1]), int(found[2])] = f"{self.path}/{found[0]}"
        return [p for (a, b), p in sorted(spans.items()) if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in spans)]

    def _write(self, df: DataFrame, first: int, last: int, bits: int) -> str:
        path = f"{self.path}/run-{first:06d}-{last:06d}-b{bits:02d}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("prefix").parquet(path)
        return path

    def _sorted(self, df: DataFrame, bits: int) -> DataFrame:
        """``df`` with its prefix of so many bits, one partition or more a prefix, each sorted by hash."""
        prefix = F.shiftrightunsigned("h", 64 - bits).cast("int").alias("prefix")
        return df.select(prefix, *(c for c in df.columns if c != "prefix")).repartition(1 << bits, "prefix").sortWithinPartitions("prefix", "h")

    def ingest(self, batch: DataFrame, order: list[str], expected: int = 0) -> None:
        """Add the identifiers of ``batch`` (columns scope, id and ``order``) as a new run.

        The run has one row for each identifier that no earlier batch had: the occurrence that comes first by the
        ``order`` columns. NULL and empty identifiers identify nothing and are left out. ``expected``: the number of
        identifiers to come, should it be known; it decides the first run's prefix length.
        """
        runs = self.runs()
        spans = [tuple(map(int, _RUN.search(r).groups())) for r in runs]
        number = 1 + max((b for _, b, _ in spans), default=0)
        bits = spans[-1][2] if spans else prefix_bits(expected or batch.count())
        firsts = batch.where(F.col("id") != "").groupBy("scope", "id").agg(F.min(F.struct(*order)).alias("first"))
        ready = self._sorted(firsts.select(F.xxhash64("scope", "id").alias("h"), "scope", "id", "first.*"), bits)
        self._schema = ready.schema
        if runs and self.by_spark:
            held = self.entries(runs).select("prefix", *_SEARCHED)
            found = ready.groupBy("prefix").cogroup(held.groupBy("prefix")).applyInArrow(_search_group, ready.schema)
            ready = self._sorted(found, bits)
        elif runs:
            ready = ready.mapInArrow(_search(runs), ready.schema).sortWithinPartitions("prefix", "h")
        self._write(ready, number, number, bits)
        if len(runs) + 1 >= self.merge_every:
            self.merge()

    def merge(self) -> None:
        """Replace all runs by one, with a longer prefix where the index has outgrown its own."""
        runs = self.runs()
        if len(runs) < 2:
            return
        spans = [tuple(map(int, _RUN.search(r).groups())) for r in runs]
        held = self.entries(runs)
        bits = max(spans[-1][2], prefix_bits(held.count()))  # a count of Parquet rows reads the footers alone
        self._write(self._sorted(held, bits), min(a for a, _, _ in spans), max(b for _, b, _ in spans), bits)
        for run in runs:
            remove_path(self.spark, run)

    def entries(self, runs: list[str] | None = None) -> DataFrame:
        """All kept occurrences: prefix, h, scope, id and the order columns.

        A run may have no file (its batch brought nothing new) and then says nothing about columns.
        """
        jvm = self.spark._jvm
        held = []
        for run in runs or self.runs():
            path = jvm.org.apache.hadoop.fs.Path(run)
            found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
            if any(str(f.getPath().getName()).startswith("prefix=") for f in found):
                read = self.spark.read if self._schema is None else self.spark.read.schema(self._schema)  # known: no job to infer it
                held.append(read.parquet(run))
        if not held:
            return self.spark.createDataFrame([], self._schema or "prefix int, h bigint, scope string, id string")
        return reduce(DataFrame.unionByName, held)


def surplus_copies(occurrences: DataFrame, *, batch: Column, order: list[str], key: list[str], index: IdentifierIndex | None = None, merge_every: int = 8) -> DataFrame:
    """Rows of ``occurrences`` (columns scope, id, ``order`` and ``key``) other than the first of their (scope, id).

    ``batch``: number of the delivery an occurrence came with; batches are ingested in its order, and it must not fall
    where ``order`` rises. ``key`` columns are part of ``order`` and identify an occurrence within its scope. NULL and
    empty identifiers are never surplus. An empty table gives an empty result. ``index``: an index that is kept; what it
    holds from earlier calls came first, and a delivery given once more gives the same rows again. Without one an index
    is built for this call.
    """
    spark = occurrences.sparkSession
    columns = list(dict.fromkeys(["scope", "id", *order, *key]))
    held = materialise(occurrences.where(F.col("id") != "").select(*columns, batch.cast("int").alias("delivery")), "occurrences", "delivery")
    if index is None:
        index = IdentifierIndex(spark, scratch_path(spark, "identifiers"), merge_every)
    sizes = {r[0]: r[1] for r in held.groupBy("delivery").count().collect()}
    for number in sorted(sizes):
        index.ingest(held.where(F.col("delivery") == number), order, sum(sizes.values()))
    if not sizes:
        return held.drop("delivery")
    return held.drop("delivery").join(index.entries().select("scope", *key), ["scope", *key], "left_anti")
