import random

from pyspark.sql import functions as F

from commitlake.operators import dedup
from commitlake.session import scratch_path

SCHEMA = "scope string, id string, batch_no int, row_id long, pos long, prefix string, h string"


def surplus(spark, rows, days=2, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    found = dedup.surplus_copies(df, batch=F.floor(F.col("batch_no") / days), order=["batch_no", "row_id", "pos"], key=["row_id", "pos"], **options)
    return sorted((r["scope"], r["row_id"], r["pos"]) for r in found.collect())


def brute(rows):
    first = {}
    for scope, id_, batch, row, pos in rows:
        if id_:
            first[scope, id_] = min(first.get((scope, id_), (batch, row, pos)), (batch, row, pos))
    return sorted((s, r, p) for s, i, b, r, p in rows if i and first[s, i] != (b, r, p))


def test_against_brute_force(spark):
    random.seed(3)
    rows = []
    for row in range(600):
        id_ = random.choice(["hot", f"i{random.randint(0, 150)}", "", None, "Hot", "é" * 3])
        rows.append((random.choice("ab"), id_, random.randint(0, 11), row, -1))
        if row % 7 == 0:
            rows += [(rows[-1][0], random.choice(["hot", "x"]), rows[-1][2], row, k) for k in range(3)]
    assert surplus(spark, rows) == brute(rows)
    assert surplus(spark, rows, days=100) == brute(rows)
    assert surplus(spark, rows, days=1, merge_every=3) == brute(rows)


def test_nothing_to_do(spark):
    assert surplus(spark, []) == []
    assert surplus(spark, [("a", None, 1, 1, -1), ("a", "", 1, 2, -1)]) == []


def test_index_persists_and_merges(spark):
    path = scratch_path(spark, "index-test")
    index = dedup.IdentifierIndex(spark, path, merge_every=100)
    batch = lambda ids, at: spark.createDataFrame([("s", i, at, k) for k, i in enumerate(ids)], "scope string, id string, batch_no int, row_id long")
    order = ["batch_no", "row_id"]
    index.ingest(batch(["a", "b", "a"], 1), order)
    assert index.entries().count() == 2
    reopened = dedup.IdentifierIndex(spark, path, merge_every=100)
    reopened.ingest(batch(["b", "c", None, ""], 2), order)
    assert len(reopened.runs()) == 2
    reopened.merge()
    assert len(reopened.runs()) == 1
    reopened.ingest(batch(["a", "b", "c"], 3), order)
    kept = {r["id"]: (r["batch_no"], r["row_id"]) for r in reopened.entries().collect()}
    assert kept == {"a": (1, 0), "b": (1, 1), "c": (2, 1)}
    empty = dedup.IdentifierIndex(spark, scratch_path(spark, "index-empty"))
    empty.ingest(batch([None], 1), order)
    assert empty.entries().count() == 0


def test_calls_that_share_an_index(spark):
    """What an earlier call brought came first; the same deliveries once more give the same rows."""
    random.seed(5)
    rows = [("a", f"i{random.randint(0, 60)}", n // 40, n, -1) for n in range(200)]
    index = dedup.IdentifierIndex(spark, scratch_path(spark, "index-kept"), merge_every=3)
    early, late = rows[:120], rows[120:]
    assert surplus(spark, early, days=1, index=index) == brute(early)
    reopened = dedup.IdentifierIndex(spark, index.path, merge_every=3)
    want = [r for r in brute(rows) if r[1] >= 120]
    assert surplus(spark, late, days=1, index=reopened) == want
    assert surplus(spark, late, days=1, index=reopened) == want


def test_spark_reads_the_index_where_arrow_cannot(spark):
    rows = [("a", f"i{n % 30}", n // 20, n, -1) for n in range(100)]
    index = dedup.IdentifierIndex(spark, scratch_path(spark, "index-spark"), merge_every=3, by_spark=True)
    assert surplus(spark, rows, days=1, index=index) == brute(rows)
    assert dedup.IdentifierIndex(spark, "odd-scheme://bucket/index").by_spark
    assert dedup.IdentifierIndex(spark, "s3a://bucket/index").by_spark in (True, False)  # Arrow's s3 where it is reached, else Spark


def test_prefixes_follow_the_number_of_identifiers(spark, monkeypatch):
    assert [dedup.prefix_bits(n) for n in (0, 1 << 22, (1 << 22) + 1, 10**9, 10**12)] == [3, 3, 4, 11, 21]
    monkeypatch.setattr(dedup, "IDS_PER_PREFIX", 4)
    rows = [("a", f"i{n % 90}", n // 30, n, -1) for n in range(150)]
    index = dedup.IdentifierIndex(spark, scratch_path(spark, "index-grows"), merge_every=3)
    df = spark.createDataFrame(rows, "scope string, id string, batch_no int, row_id long, pos long")
    for day in range(5):
        index.ingest(df.where(F.col("batch_no") == day), ["batch_no", "row_id", "pos"])
    assert index.entries().count() == 90
    assert {r[-3:] for r in index.runs()} <= {"b05", "b06"}  # the first batch has 30 identifiers, the whole 90


def test_equal_hashes_are_told_apart():
    import pyarrow as pa

    run = pa.table({"h": [1, 5, 5, 5, 9], "scope": ["s"] * 5, "id": ["a", "b", "c", "d", "e"]})
    batch = pa.table({"h": [1, 5, 5, 7, 9], "scope": ["s", "s", "s", "s", "t"], "id": ["a", "d", "x", "a", "e"]})
    assert dedup._known(batch, run).tolist() == [True, True, False, False, False]


def test_long_identifiers(spark):
    long = "z" * 200_000
    rows = [("a", long, 0, 1, -1), ("a", long, 5, 2, -1), ("a", long[:-1], 5, 3, -1)]
    assert surplus(spark, rows) == [("a", 2, -1)]
