"""Mixed timestamp formats and zones to UTC instants.

Every stamp gets the array of all its valid interpretations (format, instant, prior cost) as JVM-side expressions.
A stamp with one interpretation is settled; where there are several, a Viterbi pass over the record order of the
source chooses, paying for switches of format and for jumps back in time.

Scale: a chain is cut into blocks of the record order, so a source that holds a third of all rows is spread over many
tasks. A record with one interpretation separates a chain exactly, so only ambiguous records, their neighbours and the
ends of blocks reach Python. Blocks are first reduced to the cost matrix between the states of their first and last
record; blocks of blocks likewise, until a source has few of them. One pass over the topmost fixes the states at their
ends, and level by level those of the blocks within; then all blocks are decoded on their own. The result equals one
Viterbi over the whole chain, whatever the block size, and no task holds more than a block or a block of blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from commitlake.session import materialise, utc

#: Cost of a change of format from one record to the next, and of a step back in time by more than SLACK_US.
SWITCH, BACKWARD, SLACK_US = 1.0, 2.0, 90_000_000
#: Prior cost of a reading that no convention has (month first between dots), and of a zone abbreviation whose offset
#: is not in force in the row's own zone.
UNUSUAL, FOREIGN = 8.0, 4.0

#: Offsets in minutes that an abbreviation can stand for.
ABBREVIATIONS = {
    "Z": [0], "UTC": [0], "GMT": [0], "UT": [0], "WET": [0], "WEST": [60], "BST": [60, 360], "CET": [60],
    "CEST": [120], "EET": [120], "EEST": [180], "MSK": [180], "EST": [-300], "EDT": [-240], "CST": [-360, 480],
    "CDT": [-300], "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480],
    "HST": [-600], "BRT": [-180], "ART": [-180], "IST": [330, 60, 120], "PKT": [300], "SGT": [480], "HKT": [480],
    "JST": [540], "KST": [540], "AWST": [480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660],
    "NZST": [720], "NZDT": [780], "SAST": [120],
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp][Mm]))?"
_ZONE = r" ?([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})?(?:\[[^\]]*\])?"
#: (family, pattern, replacement): year|month|day|hour|minute|second|fraction|half of the day|zone. The month may be a
#: name; day|month stands for an ordinal day where the month is empty.
_FAMILIES = [
    ("iso", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[Tt ]{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("numbers", rf"^(\d{{1,2}})([./-])(\d{{1,2}})\2(\d{{4}}),?[Tt ]{_TIME}{_ZONE}$", "$4|$3|$1|$5|$6|$7|$8|$9|$10"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("ordinal", rf"^(\d{{4}})-(\d{{3}})[Tt ]{_TIME}{_ZONE}$", "$1||$2|$3|$4|$5|$6|$7|$8"),
    ("mail", rf"^(?:[A-Za-z]{{3}}, *)?(\d{{1,2}})[ -]([A-Za-z]{{3}})[ -](\d{{4}}) {_TIME}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("ctime", rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) +(\d{{1,2}}) {_TIME} (\d{{4}}){_ZONE}$", "$8|$1|$2|$3|$4|$5|$6|$7|$9"),
    ("date", rf"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) +(\d{{1,2}}) {_TIME}{_ZONE} (\d{{4}})$", "$9|$1|$2|$3|$4|$5|$6|$7|$8"),
]
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_ISO_MS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
_CANDIDATES = "array<struct<fmt:string,us:bigint,cost:double>>"


def _candidate(fmt: Column | str, us: Column, cost: Column | float = 0.0) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(column(fmt).alias("fmt"), us.cast("bigint").alias("us"), column(cost).cast("double").alias("cost"))


def _epochs(text: Column) -> list[Column]:
    """Readings of a number as seconds to nanoseconds since 1970; digits below a microsecond are cut off."""
    number = F.when(text.rlike(r"^\d{9,20}(\.\d*)?$|^\d(\.\d+)?[eE]\+?\d{1,2}$"), text.try_cast("decimal(38,9)"))
    units = [("s", number * 1_000_000), ("ms", number * 1_000), ("us", number), ("ns", number / 1_000)]
    return [_candidate(f"epoch.{unit}", F.floor(value).try_cast("bigint")) for unit, value in units]


def with_candidates(df: DataFrame, stamp: str, zone: str, window: tuple[int, int], fold: str = "earlier") -> DataFrame:
    """``df`` with ``t_cands``: all interpretations of ``stamp`` with instants in ``window`` (microseconds, inclusive).

    ``zone``: column with the IANA zone of a wall-clock time without zone; NULL leaves such a stamp without
    interpretation. A wall-clock time that occurs twice gives the earlier instant, or with ``fold="chain"`` both; one
    that never occurs (a skipped hour) is read with the offset before the change. NULL, empty and impossible stamps
    give an empty array. Equal instants are listed once, the reading with the lower cost first.

    The work is laid out in stages of columns, each computed once a row; stamps in ISO form with milliseconds take a
    cast and nothing else.
    """
    text = F.col("t_text")
    canon = F.when(text.rlike(_ISO_MS), F.lit(None))
    for family, pattern, to in _FAMILIES:
        canon = canon.when(text.rlike(pattern), F.regexp_replace(text, pattern, f"{family}|{to}"))
    staged = df.withColumn("t_text", F.trim(F.col(stamp))).withColumn("t_part", F.split(canon, r"\|", -1))
    part = F.col("t_part")
    hour, half, mark = part[4].cast("int"), F.lower(part[8]), part[9]
    sign = F.when(F.substring(mark, 1, 1) == "-", -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(mark, r"[^0-9]", ""), 4, "0")
    numeric = F.array(sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")))
    table = F.create_map(*(x for name, offsets in ABBREVIATIONS.items() for x in (F.lit(name), F.array(*map(F.lit, offsets)))))
    named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part[2]))
    staged = staged.withColumns(
        {
            "t_hour": F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)),
            "t_fraction": F.when(part[7] == "", 0).otherwise(F.rpad(F.substring(part[7], 1, 6), 6, "0").cast("bigint")),
            "t_month": F.when(named > 0, named.cast("string")).when(part[2].rlike(r"^\d+$"), part[2]),
            "t_ordinal": F.when(part[0] == "ordinal", F.date_add(F.concat(part[1], F.lit("-01-01")).try_cast("date"), part[3].cast("int") - 1)),
            "t_offsets": F.when(mark == "", F.lit(None)).when(mark.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(table, F.upper(mark))),
        }
    )

    def local(month: Column, day: Column) -> Column:
        """Wall-clock time as a timestamp in UTC; NULL for an impossible one. concat_ws drops a NULL hour, so it is tested."""
        date = F.concat_ws("-", part[1], F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        clock = F.concat_ws(":", F.lpad(F.col("t_hour").cast("string"), 2, "0"), part[5], F.when(part[6] == "", "00").otherwise(part[6]))
        return F.when(F.col("t_hour").isNotNull() & month.isNotNull(), F.concat_ws(" ", date, clock).try_cast("timestamp"))

    ordinal = F.col("t_ordinal")
    inside = (part[3].cast("int") > 0) & (F.year(ordinal) == part[1].cast("int"))
    staged = staged.withColumns(
        {
            "t_plain": F.when(part[0] == "ordinal", F.when(inside, local(F.month(ordinal), F.day(ordinal)))).otherwise(local(F.col("t_month"), part[3])),
            "t_swapped": F.when(part[0] == "numbers", local(part[3], part[2])),
        }
    )
    where = F.col(zone)
    staged = staged.withColumns({"t_home": F.to_utc_timestamp("t_plain", where), "t_home2": F.to_utc_timestamp("t_swapped", where)})
    offsets, found = F.col("t_offsets"), []
    unusual = F.when(text.rlike(r"^\d{1,2}\."), UNUSUAL).otherwise(0.0)
    for name, time, home, cost in (
        (F.when(part[0] == "numbers", "dmy").otherwise(part[0]), F.col("t_plain"), F.col("t_home"), F.lit(0.0)),
        (F.lit("mdy"), F.col("t_swapped"), F.col("t_home2"), unusual),
    ):
        first = F.when(mark == "", F.unix_micros(home))
        found.append(_candidate(F.concat(name, F.lit(".local")), first + F.col("t_fraction"), cost))
        if fold == "chain":  # the same wall-clock time once more, an hour of offset later, where that reads back as it
            later = F.timestamp_micros(first + 3_600_000_000)
            found.append(_candidate(F.concat(name, F.lit(".local")), F.when(F.from_utc_timestamp(later, where) == time, F.unix_micros(later)) + F.col("t_fraction"), cost))
        for k in range(max(map(len, ABBREVIATIONS.values()))):
            at = F.unix_micros(time) - F.try_element_at(offsets, F.lit(k + 1)).cast("bigint") * 60_000_000
            foreign = F.when((F.size(offsets) > 1) & (F.coalesce(F.unix_micros(home) - at, F.lit(1)) != 0), FOREIGN).otherwise(0.0)
            found.append(_candidate(F.concat(name, F.lit(".zoned")), at + F.col("t_fraction"), cost + foreign))
    kept = F.filter(
        F.when(part.isNotNull(), F.array(*found)).when(text.rlike(_ISO_MS), F.array(_candidate("iso.zoned", F.unix_micros(text.try_cast("timestamp"))))).otherwise(F.array(*_epochs(text))),
        lambda x: x["us"].between(*window),
    )
    staged = staged.withColumn("t_cands", F.coalesce(kept, F.array().cast(_CANDIDATES)))
    several = F.col("t_cands")
    ranked = F.array_sort(several, lambda a, b: F.when(a["cost"] < b["cost"], -1).when(a["cost"] > b["cost"], 1).when(a["us"] < b["us"], -1).when(a["us"] > b["us"], 1).otherwise(0))
    once = F.filter(ranked, lambda x, i: F.array_position(F.transform(ranked, lambda y: y["us"]), x["us"]) == i + 1)
    staged = staged.withColumn("t_cands", F.when(F.size(several) > 1, once).otherwise(several))
    return staged.select(*df.columns, "t_cands")


def is_iso_ms(stamp: Column) -> Column:
    """Whether ``stamp`` has the form ``YYYY-MM-DDThh:mm:ss.SSSZ``; NULL for NULL."""
    return stamp.rlike(_ISO_MS)


def _step(a: dict, b: dict) -> float:
    return (SWITCH if a["fmt"] != b["fmt"] else 0.0) + (BACKWARD if b["us"] < a["us"] - SLACK_US else 0.0)


def _forward(rows: list, start: list[float]) -> tuple[list[float], list[list[int]]]:
    """Costs of the last record's states, and for each later record the best state before each of its states."""
    costs, back = start, []
    for before, now in zip(rows, rows[1:], strict=False):
        steps = [min((costs[i] + _step(a, b), i) for i, a in enumerate(before)) for b in now]
        back.append([i for _, i in steps])
        costs = [c + b["cost"] for (c, _), b in zip(steps, now, strict=True)]
    return costs, back


def _groups(batches: Iterable[pd.DataFrame], *keys: str) -> Iterator[tuple[tuple, list]]:
    """Runs of equal keys in sorted batches, as lists of row tuples; a run may go over batches."""
    held: list = []
    now: tuple | None = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            key = tuple(getattr(row, k) for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _summarise(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each block: states of its first and last record and the least cost from each to each."""
    out = []
    for (src, blk), rows in _groups(batches, "t_src", "t_blk"):
        states = [list(r.t_cands) for r in rows]
        matrix = []
        for i in range(len(states[0])):
            start = [c["cost"] if k == i else float("inf") for k, c in enumerate(states[0])]
            matrix.append(_forward(states, start)[0])
        out.append((src, blk, states[0], states[-1], matrix))
    yield pd.DataFrame(out, columns=["t_src", "t_blk", "first", "last", "matrix"])


def _joined(blocks: list) -> list[list[float]]:
    """The least cost from each state of the first block's first record to each of the last block's last."""
    costs = [list(row) for row in blocks[0].matrix]
    for b, n in zip(blocks, blocks[1:], strict=False):
        entry = [[min(row[i] + _step(a, x) for i, a in enumerate(b.last)) for x in n.first] for row in costs]
        costs = [[min(e[i] + n.matrix[i][j] for i in range(len(n.first))) for j in range(len(n.last))] for e in entry]
    return costs


def _summarise_blocks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of blocks as ``_summarise`` gives blocks: t_src, t_sup as t_blk, first, last, matrix."""
    out = [(src, sup, blocks[0].first, blocks[-1].last, _joined(blocks)) for (src, sup), blocks in _groups(batches, "t_src", "t_sup")]
    yield pd.DataFrame(out, columns=["t_src", "t_blk", "first", "last", "matrix"])


def _stitch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States of the first and last record of every block on the best path through the blocks of its block of blocks.

    Rows with t_first and t_last (states of the ends of the whole, fixed a level above) go on the best path between
    these; others on the best of all.
    """
    out = []
    for (src, _), blocks in _groups(batches, "t_src", "t_sup"):
        fixed = hasattr(blocks[0], "t_first")
        costs: list[float] = []
        back: list[list[tuple[int, int]]] = []  # for each block and last state: first state, last state of the block before
        for n, b in enumerate(blocks):
            entry = [(float("inf") if fixed and i != b.t_first else 0.0, 0) for i in range(len(b.first))]
            if n:
                entry = [min((costs[i] + _step(a, x), i) for i, a in enumerate(blocks[n - 1].last)) for x in b.first]
            best = [min((entry[i][0] + b.matrix[i][j], i) for i in range(len(b.first))) for j in range(len(b.last))]
            costs = [c for c, _ in best]
            back.append([(i, entry[i][1]) for _, i in best])
        state = int(blocks[-1].t_last) if fixed else min(range(len(costs)), key=lambda j: (costs[j], j))
        for n in range(len(blocks) - 1, -1, -1):
            first, before = back[n][state]
            out.append((src, blocks[n].t_blk, first, state))
            state = before
    yield pd.DataFrame(out, columns=["t_src", "t_blk", "t_first", "t_last"])


def _decode(keep: list[str]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _, rows in _groups(batches, "t_src", "t_blk"):
            states = [list(r.t_cands) for r in rows]
            start = [c["cost"] if k == rows[0].t_first else float("inf") for k, c in enumerate(states[0])]
            _, back = _forward(states, start)
            state = rows[0].t_last
            for n in range(len(rows) - 1, -1, -1):
                if len(states[n]) > 1:
                    out.append((*(getattr(rows[n], k) for k in keep), states[n][state]["us"]))
                if n:
                    state = back[n - 1][state]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[*keep, "utc_us"])
                out = []
        yield pd.DataFrame(out, columns=[*keep, "utc_us"])

    return run


def normalise_stamps(
    df: DataFrame, *, stamp: str, zone: str, source: list[str], order: str, tie: str, keep: list[str], window: tuple[int, int], fold: str = "earlier", block: int = 4096, fan: int = 4096
) -> DataFrame:
    """``keep`` columns and ``utc_us`` of every row of ``df``: the instant its ``stamp`` names, or NULL.

    ``source`` columns name the chain, ``order`` (bigint) and ``tie`` (bigint) its record order. Rows without an
    interpretation get NULL and leave the chain. Equal orders and ties are taken as they come. An empty table gives
    an empty result. Columns of ``df`` outside ``keep`` are not carried, so any further columns may exist. ``block``: span
    of the order that a block covers; ``fan``: blocks in a block of blocks. Times are read in UTC whatever the zone of
    the session.
    """
    with utc(df.sparkSession):
        return _normalise(df, stamp, zone, source, order, tie, keep, window, fold, block, fan)


def _around_open(parsed: DataFrame, block: int) -> DataFrame:
    """Records with several readings and their neighbours, by source and block, and the ends of blocks."""
    open_sources = parsed.where(F.size("t_cands") > 1).select("t_src").distinct()
    chain = parsed.where(F.size("t_cands") > 0).join(open_sources, "t_src", "left_semi").withColumn("t_blk", F.floor(F.col("t_ord") / block))
    # asked for by name: the join's own partitioning, by source alone, would do for the windows and put a hot source in one task
    chain = chain.repartition("t_src", "t_blk")
    inside = Window.partitionBy("t_src", "t_blk").orderBy("t_ord", "t_tie")
    several = F.size("t_cands") > 1
    near = F.coalesce(F.lag(several).over(inside), F.lit(True)) | F.coalesce(F.lead(several).over(inside), F.lit(True))
    return chain.withColumn("t_near", several | near).where("t_near").drop("t_near")


def _normalise(df: DataFrame, stamp: str, zone: str, source: list[str], order: str, tie: str, keep: list[str], window: tuple[int, int], fold: str, block: int, fan: int) -> DataFrame:
    parsed = materialise(
        with_candidates(
            df.select(
                *keep,
                F.xxhash64(*source).alias("t_src"),
                F.coalesce(F.col(order), F.lit(0)).cast("bigint").alias("t_ord"),
                F.coalesce(F.col(tie), F.lit(0)).cast("bigint").alias("t_tie"),
                F.col(stamp).alias("t_stamp"),
                F.col(zone).alias("t_zone"),
            ),
            "t_stamp",
            "t_zone",
            window,
            fold,
        ).drop("t_stamp", "t_zone"),
        "stamps",
    )
    settled = parsed.where(F.size("t_cands") < 2).select(*keep, F.try_element_at("t_cands", F.lit(1))["us"].alias("utc_us"))
    chain = materialise(_around_open(parsed, block), "chain")  # read twice, and small
    kinds = T.StructType([f for f in chain.schema.fields if f.name in ("t_src", "t_blk")])
    states = next(f.dataType for f in chain.schema.fields if f.name == "t_cands")
    summary = T.StructType([*kinds.fields, T.StructField("first", states), T.StructField("last", states), T.StructField("matrix", T.ArrayType(T.ArrayType(T.DoubleType())))])
    ends = T.StructType([*kinds.fields, T.StructField("t_first", T.IntegerType()), T.StructField("t_last", T.IntegerType())])
    by_block = lambda df, *keys: df.repartition(*keys).sortWithinPartitions(*keys, *(c for c in ("t_blk", "t_ord", "t_tie") if c in df.columns and c not in keys))
    levels = [materialise(by_block(chain, "t_src", "t_blk").mapInPandas(_summarise, summary), "blocks")]
    above = lambda level: level.withColumn("t_sup", F.floor(F.col("t_blk") / fan))
    while not above(levels[-1]).groupBy("t_src").agg(F.count_distinct("t_sup").alias("n")).where("n > 1").isEmpty():
        levels.append(materialise(by_block(above(levels[-1]), "t_src", "t_sup").mapInPandas(_summarise_blocks, summary), "blocks"))
    fixed = by_block(above(levels[-1]), "t_src", "t_sup").mapInPandas(_stitch, ends)
    for level in reversed(levels[:-1]):
        whole = fixed.withColumnRenamed("t_blk", "t_sup")
        fixed = by_block(above(level).join(whole, ["t_src", "t_sup"]), "t_src", "t_sup").mapInPandas(_stitch, ends)
    ordered = by_block(chain.join(fixed, ["t_src", "t_blk"]), "t_src", "t_blk")
    out = T.StructType([*(f for f in parsed.schema.fields if f.name in keep), T.StructField("utc_us", T.LongType())])
    return settled.unionByName(ordered.mapInPandas(_decode([f.name for f in out.fields[:-1]]), out))
