"""Queries and readers that must do the whole job: no row or line is left out unseen."""

import json

from pyspark.sql import functions as F

from commitlake.plans import history
from commitlake.sources import agents
from commitlake.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def test_store_calls_with_instants(spark):
    data = json.dumps({"role": "assistant", "providerID": "p", "modelID": "m", "tokens": {"input": 5, "output": 1}})
    stamps = [("a", "1788219000000", None), ("b", "2026-09-22 07:39:07 +1000", 1_790_026_747_000_000), ("c", "20261027T215820Z", 1_793_138_300_000_000), ("d", "soon", None), ("e", None, None)]
    messages = spark.createDataFrame([(i, "s", t, us, 1, n, data) for n, (i, t, us) in enumerate(stamps)], "id string, session_id string, time_created string, utc_us long, batch_no int, row_id long, data string")
    sessions = spark.createDataFrame([("s", "1.14.0")], "id string, version string")
    found = {r["call_key"]: r["day"] for r in agents.store_calls(messages, sessions).collect()}
    assert found == {"a": "2026-08-31", "b": "2026-09-21", "c": "2026-10-27", "d": "", "e": ""}


def test_opencode_usage_keeps_every_call(spark):
    calls = agents.store_calls(table(spark, FOLDER, "message"), table(spark, FOLDER, "opencode_session"), drop_forks=False)
    used = calls.where(F.greatest("input", "output", "cache_read", "cache_write") > 0)
    counted = history.QUERIES["opencode_usage"](spark, FOLDER)
    sums = lambda df: df.agg(*(F.sum(c) for c in ("input", "output", "cache_read", "cache_write", "turns"))).first()
    assert sums(counted) == sums(used)
    undated, without_ms = counted.where("day = 'undated'").agg(F.sum("turns")).first()[0] or 0, used.where("day = ''").count()
    assert undated < without_ms  # most stamps that are no milliseconds name an instant


MOVED = {
    "2026-01-01T00:30:00+02:00": "2025-12-31", "2026-01-01 23:30:00 -0300": "2026-01-02", "2026-01-01T23:30:00-04": "2026-01-02", "2026-01-01T00:30:00.5+01": "2025-12-31",
    "2026-01-01T00:30:00+00:00": "2026-01-01", "2026-01-01T23:30:00.000Z": "2026-01-01", "2026-01-01 23:30": "2026-01-01", "2026-01-01 11:30:00 PM": "2026-01-01", "01.01.2026 10:00:00": "", "1767225600000": "", "": "", None: "",
}


def test_utc_day_moves_offsets(spark, tmp_path):
    stamps = dict(enumerate(MOVED))
    spark.createDataFrame([(i, s) for i, s in stamps.items()], "row_id long, created_at string").write.parquet(str(tmp_path / "assistant_usage_events.parquet"))
    found = {stamps[r["row_id"]]: r["day"] for r in history.QUERIES["utc_day"](spark, str(tmp_path)).collect()}
    assert found == MOVED


def test_utc_day_has_every_row(spark):
    assert history.QUERIES["utc_day"](spark, FOLDER).count() == table(spark, FOLDER, "assistant_usage_events").count()


def test_windows_of_all_customers(spark):
    """At a size with more than 400 customers, and against the SQL."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for name in ("customer", "supplier", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("session_windows", "calls_in_windows"):
        found = history.QUERIES[name](spark, folder)
        want = db.execute(history.ORACLES[name])
        places = [[c[0] for c in want.description].index(c) for c in found.columns]
        rows = sorted(map(tuple, found.collect()), key=repr)
        assert rows == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=repr)
        if name == "session_windows":
            keys = {r[0] for r in db.execute("SELECT '/w/' || c_custkey FROM customer").fetchall()}
            assert len(keys) > 400 and keys <= {r[0] for r in rows}


def test_series_keeps_every_total(spark):
    measured = history.QUERIES["source_series"](spark, FOLDER).where("kind = 'm'").select("source", "day", "tokens")
    totals = history.QUERIES["source_totals"](spark, FOLDER).select("source", "day", "tokens")
    assert sorted(measured.collect()) == sorted(totals.collect())
    assert totals.where("substring(day, 9, 2) <= '10'").count() > 0
    assert history.QUERIES["source_series"](spark, FOLDER).where("kind = 'e'").count() > 0


def test_no_intermediate_table_outside_of_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from commitlake.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(cluster)


def test_results_kept_by_key(spark, tmp_path):
    from commitlake.operators.measuring import KeyedCache

    schema = "blob string, path string, lines long"
    cache = KeyedCache(spark, str(tmp_path / "cache"), ["blob", "path"], schema)
    rows = lambda *r: spark.createDataFrame(r, schema)
    assert cache.rows().isEmpty() and cache.missing(rows(("a", "p", 1))).count() == 1
    cache.put(rows(("a", "p", 1), ("a", "p", 2), ("b", "p", 3)))
    cache.put(rows(("a", "p", 9), ("a", "q", 4), (None, "p", 5)))
    again = KeyedCache(spark, str(tmp_path / "cache"), ["blob", "path"], schema)
    assert sorted(map(tuple, again.rows().where("blob IS NOT NULL").collect())) == [("a", "p", 1), ("a", "p", 2), ("a", "q", 4), ("b", "p", 3)]
    assert [tuple(r) for r in again.missing(rows(("a", "p", 1), ("c", "p", 1))).collect()] == [("c", "p", 1)]
    assert again.get(rows(("a", "p", 0), ("a", "p", 0))).count() == 2
    assert KeyedCache(spark, str(tmp_path / "cache"), ["blob", "path"], schema, version=2).rows().isEmpty()


def test_as_of_beyond_its_limit(spark):
    """The merge in sorted ranges gives what the array gives."""
    import random

    from commitlake.operators.archive import as_of

    random.seed(2)
    df = spark.createDataFrame([(i, random.choice([None, *range(-5, 320)])) for i in range(400)], "i int, at int")
    releases = spark.createDataFrame([(n, f"r{n}" if n % 3 else None) for n in range(0, 300, 7)] + [(None, "x"), (7, "a")], "since int, v string")
    small, large = (as_of(df, "at", releases, "since", "v", "found", limit=limit) for limit in (1000, 5))
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
