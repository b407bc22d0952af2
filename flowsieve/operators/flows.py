"""Flow assembly over a stored packet table: idle gaps and an age limit cut each key's packets into flows."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.values import all_rows
from flowsieve.session import materialise

IDLE_SECONDS = 15.0
AGE_SECONDS = 30.0
#: Packets of a block, and step functions that one task composes.
BLOCK_ROWS = 500_000
FAN = 16
NEVER = np.iinfo(np.int64).max


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _starts_after(t: np.ndarray, idle: int, age: int) -> np.ndarray:
    """For a flow that starts at packet i: the packet that starts the next flow, len(t) if none does."""
    n = len(t)
    gaps = np.flatnonzero(np.diff(t) >= idle) + 1
    by_gap = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n), side="right")]
    return np.minimum(by_gap, np.searchsorted(t, t + age, side="left"))


def _last_starts(t: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For a flow that starts at packet i: the start time of the last flow it leads to."""
    times, nxt, n = t.tolist(), following.tolist(), len(t)
    last = times[:]
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    return np.asarray(last, np.int64)


class Steps:
    """What a stretch of packets without an idle gap does to a flow that is open when it begins.

    A flow of start s is cut at the first packet at or after s + age. ``times`` are such moments, ascending: the flow
    that is open at the end is ``exits[i]`` for the first i with s + age <= times[i]. After the last one the flow stays.
    Moments with the same exit are one step.
    """

    def __init__(self, times: np.ndarray, exits: np.ndarray):
        # of neighbours with one exit, the later moment stands for both
        kept = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.empty(0, bool)
        self.times, self.exits = times[kept], exits[kept]

    @classmethod
    def of(cls, t: np.ndarray, last: np.ndarray, age: int) -> Steps:
        """``last`` are the last starts of the packets. Flows that are open began before the first packet."""
        reach = int(np.searchsorted(t, t[0] + age, side="left")) + 1
        return cls(t[:reach], last[:reach])

    def before(self, moment: int) -> Steps:
        """Without the steps that no start + age before ``moment`` reaches."""
        reach = int(np.searchsorted(self.times, moment, side="left")) + 1
        return Steps(self.times[:reach], self.exits[:reach])

    def __call__(self, start: np.ndarray, age: int) -> np.ndarray:
        at = np.searchsorted(self.times, start + age, side="left")
        return np.where(at < len(self.times), np.append(self.exits, 0)[at], start)

    def then(self, later: Steps, age: int) -> Steps:
        """This stretch followed by another one."""
        if not len(self.times):
            return later
        more = later.times > self.times[-1]
        return Steps(np.append(self.times, later.times[more]), np.append(later(self.exits, age), later.exits[more]))


def _ordered(pdf: pd.DataFrame, key: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a block in order, and where each key begins."""
    pdf = pdf.sort_values("order__", ignore_index=True)
    fresh = np.zeros(len(pdf), bool)
    fresh[:1] = True
    for k in key:
        codes = pd.factorize(pdf[k])[0]
        fresh[1:] |= codes[1:] != codes[:-1]
    return pdf, np.flatnonzero(fresh)


def mark_flows(
    packets: DataFrame,
    key: list[str],
    ts: str,
    idle_seconds: float = IDLE_SECONDS,
    age_seconds: float = AGE_SECONDS,
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
) -> DataFrame:
    """Adds ``flow_start`` and ``iat`` (microseconds; iat is NULL on a flow's first packet).

    A packet opens a flow when it comes ``idle_seconds`` or more after the key's last packet, or ``age_seconds`` or more
    after the start of the open flow. The second rule chains through all of a key's packets, yet nothing but the order
    of the packets decides where they are cut into tasks: Spark's range partitioning deals (key, time) to blocks of
    about ``block_rows`` packets, however many a key has, or an instant. Where a key goes on from block to block
    without an idle gap, each block is a step function from the start of the flow that is open before it to that of
    the flow open after it. These functions are composed ``fan`` at a time, up a tree and down again, which gives each
    block the flow it begins with; then the blocks are marked independently. A function has at most as many steps as
    there are packets of different time within ``age_seconds``. Packets without a time are left out.
    """
    idle, age = int(idle_seconds * 1e6), int(age_seconds * 1e6)
    rows = packets.withColumn("t__", micros(ts)).filter("t__ IS NOT NULL")
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, ceil(rows.count() / block_rows))
    order = [*key, "t__", "order__"]
    dealt = rows.withColumn("order__", F.monotonically_increasing_id()).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"order__": F.monotonically_increasing_id(), "block__": F.spark_partition_id()})
    placed = materialise(dealt, "packets")
    marked = T.StructType([*rows.schema.fields, T.StructField("start__", T.LongType()), T.StructField("iat", T.LongType())])

    def mark(left: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf, heads = _ordered(left, key)
        t, n = pdf["t__"].to_numpy(), len(pdf)
        if not n:
            return left.assign(start__=0, iat=0)[marked.names]
        # All keys on one axis: an idle gap, whatever its length, and a change of key count as idle.
        steps = np.minimum(np.diff(t, prepend=t[0]), idle)
        steps[heads] = idle
        following = _starts_after(np.cumsum(steps), idle, age).tolist()
        ends = np.append(heads[1:], n).tolist()
        first = heads.tolist()
        open_start, open_last = (int(entry[c].iloc[0]) for c in ("open_start", "open_last")) if len(entry) else (0, 0)
        if len(entry):
            gap = np.flatnonzero(np.diff(t[: ends[0]]) >= idle)
            cut = int(np.searchsorted(t[: ends[0]], open_start + age, side="left"))
            first[0] = min(int(gap[0]) + 1 if len(gap) else ends[0], cut)
        starts = []
        for at, end in zip(first, ends):
            while at < end:
                starts.append(at)
                at = following[at]
        is_start = np.zeros(n, dtype=bool)
        is_start[starts] = True
        origin = np.maximum.accumulate(np.where(is_start, np.arange(n), -1))
        start = np.where(origin >= 0, t[np.maximum(origin, 0)], open_start)
        iat = pd.array(np.diff(t, prepend=open_last), dtype="Int64")
        iat[is_start] = pd.NA
        return pdf.drop(columns=["order__", "block__"]).assign(start__=start, iat=iat)

    entries = _entries(placed, key, idle, age, fan)
    done = placed.groupBy("block__").cogroup(entries.groupBy("block__")).applyInPandas(mark, marked)
    start = F.timestamp_micros("start__").cast(packets.schema[ts].dataType)
    return done.withColumn("flow_start", start).drop("t__", "start__")


def _entries(placed: DataFrame, key: list[str], idle: int, age: int, fan: int) -> DataFrame:
    """(block__, open_start, open_last) of the blocks whose first packet follows one of the same key without an idle gap."""
    keys = [placed.schema[k] for k in key]
    longs = [T.StructField(c, T.LongType()) for c in ("chunk", "first", "last", "fresh")]
    arrays = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("times", "exits")]

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        """The first and the last key of a block: no other goes on elsewhere. Without steps its last flow is known."""
        pdf, heads = _ordered(pdf, key)
        all_t, n = pdf["t__"].to_numpy(), len(pdf)
        out = []
        for which, (lo, hi) in enumerate(dict.fromkeys([(0, int(np.append(heads, n)[1])), (int(heads[-1]), n)])):
            t = all_t[lo:hi]
            last = _last_starts(t, _starts_after(t, idle, age))
            whole = lo == 0 and not (np.diff(t) >= idle).any()
            steps = Steps.of(t, last, age) if whole else None
            ids = [pdf[k].iloc[lo] for k in key]
            chunk = 2 * int(pdf["block__"].iloc[0]) + which
            out.append((*ids, chunk, t[0], t[-1], last[0], steps.times if whole else None, steps.exits if whole else None))
        return pd.DataFrame(out, columns=[*key, "chunk", "first", "last", "fresh", "times", "exits"])

    chunks = placed.select(*key, "t__", "order__", "block__").groupBy("block__").applyInPandas(summarise, T.StructType([*keys, *longs, *arrays]))
    along = W.partitionBy(*key).orderBy("chunk")
    goes_on = F.coalesce(F.col("first") - F.col("before") < idle, F.lit(False))
    chunks = chunks.withColumn("before", F.lag("last").over(along)).withColumn("joined", goes_on)
    # A chunk with known outcome begins a chain; those that go on from it without a gap have its number.
    chain = F.when(~F.col("joined") | F.col("times").isNull(), F.col("chunk"))
    chunks = chunks.withColumn("chain", F.last(chain, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)))
    chunks = chunks.withColumn("place", F.row_number().over(W.partitionBy("chain").orderBy("chunk")) - 2)
    chunks = materialise(chunks, "chunks")
    functions = chunks.filter("place >= 0").select("chain", F.col("place").cast("long").alias("place"), "first", "times", "exits")
    levels = [functions]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) >= fan:
        levels.append(materialise(_composed(levels[-1], age, fan), "steps"))
    known = chunks.filter("place = -1").select("chain", F.lit(0).cast("long").alias("place"), F.col("fresh").alias("start"))
    for level in reversed(levels):
        fed = _fed(level, known, age, fan)
        known = fed.select("chain", "place", "start")
    outcome = chunks.join(fed.select("chain", "place", "outcome"), ["chain", "place"], "left")
    outcome = outcome.withColumn("open_start", F.lag(F.coalesce("outcome", "fresh")).over(along))
    joined = outcome.filter("joined").select(F.floor(F.col("chunk") / 2).cast("int").alias("block__"), "open_start", F.col("before").alias("open_last"))
    return joined


def _steps(rows: pd.DataFrame) -> list[Steps]:
    rows = rows.sort_values("place")
    return [Steps(np.asarray(t, np.int64), np.asarray(e, np.int64)) for t, e in zip(rows["times"], rows["exits"])]


def _composed(level: DataFrame, age: int, fan: int) -> DataFrame:
    """The functions of ``fan`` neighbours of a chain as one, numbered anew."""

    columns = level.columns

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, *rest = _steps(pdf)
        for later in rest:
            whole = whole.then(later, age)
        first = int(pdf["first"].min())
        whole = whole.before(first + age)
        return pd.DataFrame([(pdf["chain"].iloc[0], pdf["place"].min() // fan, first, whole.times, whole.exits)], columns=columns)

    return level.groupBy("chain", F.floor(F.col("place") / fan)).applyInPandas(compose, level.schema)


def _fed(level: DataFrame, known: DataFrame, age: int, fan: int) -> DataFrame:
    """(chain, place, start, outcome) of each function, from the start that is known for each ``fan`` of them."""

    def feed(functions: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(functions):
            now = np.asarray([given["start"].iloc[0]], np.int64)
            for place, steps in zip(sorted(functions["place"]), _steps(functions)):
                then = steps(now, age)
                out.append((functions["chain"].iloc[0], place, int(now[0]), int(then[0])))
                now = then
        return pd.DataFrame(out, columns=["chain", "place", "start", "outcome"])

    grouped = level.groupBy("chain", F.floor(F.col("place") / fan).alias("g"))
    return grouped.cogroup(known.groupBy("chain", F.col("place").alias("g"))).applyInPandas(
        feed, "chain long, place long, start long, outcome long"
    )


def flow_features(marked: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    """One row for each flow: duration, packets, and statistics of a value and of the gaps.

    The same columns, from the same sums, as the streaming form. Values that are NULL or NaN are left out.
    """
    v, gap = F.col(value).cast("double"), F.col("iat")
    v = F.when(~F.isnan(v), v)
    return marked.groupBy(*key, "flow_start").agg(
        F.max(ts).alias("flow_end"),
        all_rows().alias("packets"),
        F.sum(v).alias("value_sum"),
        F.avg(v).alias("value_mean"),
        F.stddev_samp(v).alias("value_std"),
        F.min(v).alias("value_min"),
        F.max(v).alias("value_max"),
        F.avg(gap).alias("iat_mean"),
        F.min(gap).alias("iat_min"),
        F.max(gap).alias("iat_max"),
    ).withColumn("duration_us", micros("flow_end") - micros("flow_start"))


def assemble_flows(
    packets: DataFrame,
    key: list[str],
    ts: str,
    value: str,
    idle_seconds: float = IDLE_SECONDS,
    age_seconds: float = AGE_SECONDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    rows = packets.select(*key, ts, value)
    return flow_features(mark_flows(rows, key, ts, idle_seconds, age_seconds, block_rows), key, ts, value)
