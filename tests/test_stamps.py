import random
from datetime import datetime, timezone

import pytest

from commitlake.operators import stamps

WIDE = (0, 4_102_444_800_000_000)


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2026-01-02T03:04:05.678Z", "UTC", us(2026, 1, 2, 3, 4, 5, micro=678000)),
    ("2026-01-02 03:04", "Europe/Berlin", us(2026, 1, 2, 2, 4)),
    ("2026-01-02 03:04:05.123456789Z", "UTC", us(2026, 1, 2, 3, 4, 5, micro=123456)),
    ("2026-10-25 02:30:00", "Europe/Berlin", us(2026, 10, 25, 0, 30)),  # occurs twice: the earlier
    ("2026-03-29 02:30:00", "Europe/Berlin", us(2026, 3, 29, 1, 30)),  # never occurs
    ("25.12.2025 10:00:00", "UTC", us(2025, 12, 25, 10)),
    ("20260402T022644Z", None, us(2026, 4, 2, 2, 26, 44)),
    ("2026-100T01:02:03Z", None, us(2026, 4, 10, 1, 2, 3)),
    ("Fri, 21 Aug 2026 05:29:45 GMT", None, us(2026, 8, 21, 5, 29, 45)),
    ("Wed Feb 25 05:53:17 2026 -0330", None, us(2026, 2, 25, 9, 23, 17)),
    ("27-Jun-2026 03:24:37.009 +0000", None, us(2026, 6, 27, 3, 24, 37, micro=9000)),
    ("2026-07-15 11:18:07 CEST", None, us(2026, 7, 15, 9, 18, 7)),
    ("2026-07-15 11:18:07 IST", "Asia/Kolkata", us(2026, 7, 15, 5, 48, 7)),
    ("2026-10-04 12:39:00 AM", "UTC", us(2026, 10, 4, 0, 39)),
    ("2026-10-04 12:39:00 PM", "UTC", us(2026, 10, 4, 12, 39)),
    ("2026-02-27T05:24:39,172+01:00[Europe/Berlin]", None, us(2026, 2, 27, 4, 24, 39, micro=172000)),
    ("1787178414", None, 1787178414000000),
    ("1787178414.5", None, 1787178414500000),
    ("1787178414123", None, 1787178414123000),
    ("1787178414123456", None, 1787178414123456),
    ("1.787178414123E9", None, 1787178414123000),
    ("2026-01-02 03:04:05", None, None),
    ("2026-02-30T10:00:00.000Z", "UTC", None),
    ("2025-366T10:00:00Z", "UTC", None),
    ("2026-10-04 13:39:00 PM", "UTC", None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("unknown", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
]


def normalise(spark, rows, **options):
    df = spark.createDataFrame(rows, "src string, ord long, stamp string, zone string, extra string, t_src string")
    found = stamps.normalise_stamps(df, stamp="stamp", zone="zone", source=["src"], order="ord", tie="ord", keep=["src", "ord", "extra"], **{"window": WIDE, **options})
    return {(r["src"], r["ord"]): r["utc_us"] for r in found.collect()}


def test_every_format(spark):
    got = normalise(spark, [(f"s{i}", 1, text, zone, None, "clash") for i, (text, zone, _) in enumerate(CASES)], window=(1_700_000_000_000_000, 1_900_000_000_000_000))
    for i, (text, zone, want) in enumerate(CASES):
        assert got[f"s{i}", 1] == want, (text, zone)


def test_order_decides_ambiguous_dates(spark):
    """03/04 is March 4 among American dates and 3 April among European ones."""
    american = [("a", 1, "03/03/2026 10:00:00"), ("a", 2, "03/04/2026 10:00:00"), ("a", 3, "03/25/2026 10:00:00")]
    european = [("e", 1, "28/03/2026 10:00:00"), ("e", 2, "03/04/2026 10:00:00"), ("e", 3, "05/04/2026 10:00:00")]
    got = normalise(spark, [(s, o, t, "UTC", None, None) for s, o, t in american + european])
    assert got["a", 2] == us(2026, 3, 4, 10)
    assert got["e", 2] == us(2026, 4, 3, 10)


def test_fold_from_the_chain(spark):
    rows = [("b", 1, "2026-10-25 02:10:00"), ("b", 2, "2026-10-25 02:50:00"), ("b", 3, "2026-10-25 02:20:00"), ("b", 4, "2026-10-25T01:25:00.000Z")]
    got = normalise(spark, [(s, o, t, "Europe/Berlin", None, None) for s, o, t in rows], fold="chain")
    assert [got["b", o] for o in (1, 3)] == [us(2026, 10, 25, 0, 10), us(2026, 10, 25, 1, 20)]


def brute(states):
    """One Viterbi over a whole chain of (format, instant, cost) lists."""
    costs, back = [s["cost"] for s in states[0]], []
    for a, b in zip(states, states[1:]):
        steps = [min((costs[i] + stamps._step(x, y), i) for i, x in enumerate(a)) for y in b]
        back.append([i for _, i in steps])
        costs = [c + y["cost"] for (c, _), y in zip(steps, b)]
    state = min(range(len(costs)), key=lambda j: (costs[j], j))
    path = [state]
    for pointers in reversed(back):
        path.append(pointers[path[-1]])
    return [s[k]["us"] for s, k in zip(states, reversed(path))], min(costs)


@pytest.mark.parametrize(("block", "fan"), [(3, 2), (7, 4096), (4096, 4096)])
def test_blocks_give_the_whole_chain(spark, block, fan):
    """Any block size finds a path as cheap as one Viterbi over the whole source, even without a single clear stamp."""
    random.seed(block)
    rows = []
    for source in ("hot", "small"):
        for i in range(60 if source == "hot" else 9):
            d, m = random.randint(1, 12), random.randint(1, 12)
            rows.append((source, i, f"{d:02d}/{m:02d}/2026 {random.randint(0, 23):02d}:00:00", "UTC", None, None))
    got = normalise(spark, rows, block=block, fan=fan)
    df = spark.createDataFrame(rows, "src string, ord long, stamp string, zone string, extra string, t_src string")
    cands = {(r["src"], r["ord"]): [c.asDict() for c in r["t_cands"]] for r in stamps.with_candidates(df, "stamp", "zone", WIDE).collect()}
    for source in ("hot", "small"):
        order = sorted(o for s, o in cands if s == source)
        states = [cands[source, o] for o in order]
        path, cost = brute(states)
        mine = [next(c for c in cands[source, o] if c["us"] == got[source, o]) for o in order]
        assert sum(c["cost"] for c in mine) + sum(stamps._step(a, b) for a, b in zip(mine, mine[1:])) == pytest.approx(cost)


def test_empty_and_repeated_rows(spark):
    assert normalise(spark, []) == {}
    rows = [("r", 1, "2026-01-01T00:00:00.000Z", "UTC", None, None)] * 3
    df = spark.createDataFrame(rows, "src string, ord long, stamp string, zone string, extra string, t_src string")
    out = stamps.normalise_stamps(df, stamp="stamp", zone="zone", source=["src"], order="ord", tie="ord", keep=["src"], window=WIDE)
    assert out.count() == 3


def test_very_long_stamp(spark):
    assert normalise(spark, [("l", 1, "9" * 100_000, "UTC", None, None), ("l", 2, "x" * 100_000, "UTC", None, None)]) == {("l", 1): None, ("l", 2): None}


def test_the_zone_of_the_session_says_nothing(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = normalise(spark, [("z", 1, "2026-01-02T03:04:05.678Z", "UTC", None, None), ("z", 2, "2026-01-02 03:04", "Europe/Berlin", None, None)])
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {("z", 1): us(2026, 1, 2, 3, 4, 5, micro=678000), ("z", 2): us(2026, 1, 2, 2, 4)}


def test_a_hot_source_is_spread_over_its_blocks(spark):
    """Without broadcasts, too, the chain is partitioned by source and block."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cands = [("dmy", 1, 0.0), ("mdy", 2, 0.0)]
        df = spark.createDataFrame([(i % 2, i, i, cands) for i in range(50)], "t_src long, t_ord long, t_tie long, t_cands array<struct<fmt:string,us:long,cost:double>>")
        plan = stamps._around_open(df, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    window = plan[plan.index("Window [") :]
    assert "hashpartitioning(t_src" in window and window.index("t_blk") < window.index("SortMergeJoin")
