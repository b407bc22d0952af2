"""Flow assembly on a stream: keyed state with event-time timers, and what is still open at the end."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowsieve.operators.flows import AGE_SECONDS, IDLE_SECONDS, NEVER, _starts_after

STATE = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("start", T.LongType()),
            ("last", T.LongType()),
            ("packets", T.LongType()),
            ("valued", T.LongType()),
            ("total", T.DoubleType()),
            ("squares", T.DoubleType()),
            ("center", T.DoubleType()),
            ("low", T.DoubleType()),
            ("high", T.DoubleType()),
            ("iat_low", T.LongType()),
            ("iat_high", T.LongType()),
        )
    ]
)
STATE_NAMES = [f.name for f in STATE.fields]
FRACTIONS = {f.name for f in STATE.fields if isinstance(f.dataType, T.DoubleType)}
STATE_VARIABLE, BUFFER_VARIABLE, KEY_VARIABLE = "flow", "pieces", "key"
NAME = T.StructField("name", T.StringType())
#: Open flows of a lane as columns, in parts of bounded size.
PART_KEY = T.StructType([T.StructField("part", T.LongType())])
PART = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in (NAME, *STATE.fields)])
PIECE_KEY = T.StructType([T.StructField("first", T.LongType()), T.StructField("number", T.LongType())])
PIECE = T.StructType(
    [
        T.StructField("times", T.ArrayType(T.LongType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
        T.StructField("codes", T.ArrayType(T.IntegerType())),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)
#: Packets of a piece of the reorder buffer, and open flows of a part.
PIECE_ROWS = 2048
#: Pieces whose packets are walked together.
WALK_PIECES = 16
#: Groups of keys, each with one state and one call in a micro-batch.
LANES = 128


def key_name(df: DataFrame, key: list[str]) -> Column:
    """One text for the columns of a key, from which ``named_key`` has them back."""

    def text(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"a key of flows is of plain columns; {name!r} is {kind.simpleString()}")
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(c).cast("string")
        if isinstance(kind, T.BinaryType):
            return F.hex(c)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (c + F.lit(0.0).cast(kind)).cast("string")  # -0.0 and 0.0 are one key
        return c.cast("string")

    return F.to_json(F.struct(*[text(k).alias(f"k{i}") for i, k in enumerate(key)]))


def named_key(name: str, fields: list[T.StructField]) -> list[Column]:
    """The columns of a key from its text."""
    texts = F.from_json(name, ", ".join(f"k{i} string" for i in range(len(fields))))

    def column(i: int, kind: T.DataType) -> Column:
        c = texts[f"k{i}"]
        if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(c.cast("long"))
        return F.unhex(c) if isinstance(kind, T.BinaryType) else c.cast(kind)

    return [column(i, f.dataType).alias(f.name) for i, f in enumerate(fields)]


def _least(*values):
    return min((v for v in values if v is not None), default=None)


def _most(*values):
    return max((v for v in values if v is not None), default=None)


def joined(flow: list, more: list) -> list:
    """An open flow with what follows in it; both have their sums around the same center."""
    sums = [a + b for a, b in zip(flow[2:6], more[2:6])]
    center = more[6] if flow[6] is None else flow[6]
    return [flow[0], more[1], *sums, center, _least(flow[7], more[7]), _most(flow[8], more[8]), _least(flow[9], more[9]), _most(flow[10], more[10])]


def walk(flows: dict[int, list], codes: np.ndarray, times: np.ndarray, values: np.ndarray, idle: int, age: int) -> list[tuple[int, list]]:
    """(code, flow) of the flows that packets of many keys close; ``flows`` has the open one of each key and is brought up to date.

    The packets are in time order, none of them before the last one of its key's open flow. The keys are laid one after
    the other on one time line, far enough apart that no flow goes on, and all flows are measured together.
    """
    n = len(codes)
    if not n:
        return []
    order = np.argsort(codes, kind="stable")
    codes, times, values = codes[order], times[order], values[order]
    heads = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
    apart = max(idle, age)
    if len(heads) > 1 and len(heads) * apart + n * idle > NEVER // 2:
        half = heads[len(heads) // 2]
        parts = (slice(None, half), slice(half, None))
        return [c for p in parts for c in walk(flows, codes[p], times[p], values[p], idle, age)]
    steps = np.diff(times, prepend=times[0])
    moves = np.minimum(steps, apart)
    moves[heads] = apart
    line = np.cumsum(moves)
    following = _starts_after(line, idle, age).tolist()
    gaps = np.flatnonzero(np.diff(line) >= idle) + 1
    stretches = np.append(gaps, n)[np.searchsorted(gaps, heads, side="right")].tolist()
    at_line, begins, carried = line.tolist(), [], {}
    for a, b, code, first, stretch in zip(heads.tolist(), [*heads[1:].tolist(), n], codes[heads].tolist(), times[heads].tolist(), stretches):
        flow, at = flows.get(code), a
        if flow is not None and first - flow[1] < idle and first < flow[0] + age:
            carried[len(begins)] = flow
            begins.append(a)
            at = min(stretch, bisect_left(at_line, at_line[a] + flow[0] + age - first, a, b))
        while at < b:
            begins.append(at)
            at = following[at]
    s = np.asarray(begins)
    counts = np.diff(s, append=n)
    valid = ~np.isnan(values)
    first = np.minimum.reduceat(np.where(valid, np.arange(n), n), s)
    center = np.where(first < n, values[np.minimum(first, n - 1)], np.nan)
    near, far = steps.copy(), steps.copy()
    near[s], far[s] = NEVER, -NEVER
    for j, flow in carried.items():
        center[j] = center[j] if flow[6] is None else flow[6]
        near[s[j]] = far[s[j]] = times[s[j]] - flow[1]
    with np.errstate(invalid="ignore"):
        d = np.where(valid, values - np.repeat(center, counts), 0.0)
    fractions = [np.add.reduceat(d, s), np.add.reduceat(d * d, s)]
    valued = np.add.reduceat(valid.astype(np.int64), s)
    some = valued > 0
    missing = [np.where(some, x, None).tolist() for x in (center, np.fmin.reduceat(values, s), np.fmax.reduceat(values, s))]
    reach = [np.where(np.abs(x) < NEVER, x, None).tolist() for x in (np.minimum.reduceat(near, s), np.maximum.reduceat(far, s))]
    columns = [times[s].tolist(), times[s + counts - 1].tolist(), counts.tolist(), valued.tolist(), *[x.tolist() for x in fractions], *missing, *reach]
    closed = []
    for j, (code, *flow) in enumerate(zip(codes[s].tolist(), *columns)):
        if j in carried:
            flow = joined(carried[j], flow)
        elif code in flows:
            closed.append((code, flows[code]))
        flows[code] = flow
    return closed


class FlowAssembler(StatefulProcessor):
    """A reorder buffer and the open flows of a lane: of all keys whose hash is the same number.

    A call has a fixed price, so a lane has many keys, and their flows are walked together. Packets wait in the state
    until the watermark has passed them: then all that are not late have arrived, in whatever order, and they enter
    their flows in time order. The buffer is a map of sorted pieces of bounded size, named by
    their first time. Frames of a micro-batch become pieces one by one, and a release merges only the pieces that overlap
    in time, so neither a lane's micro-batch nor its buffer is ever one frame. A flow is running sums. A timer at the
    first packet that waits, or at the earliest idle or age limit, goes on when no packet comes.
    Packets without a value (NULL or NaN) count as packets and for the gaps; sums and extremes are over the others.
    """

    def __init__(self, key: T.StructType, idle_us: int, age_us: int, piece_rows: int = PIECE_ROWS):
        self.key = key
        self.idle = idle_us
        self.age = age_us
        self.piece_rows = piece_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState(STATE_VARIABLE, PART_KEY, PART)
        self.pieces = handle.getMapState(BUFFER_VARIABLE, PIECE_KEY, PIECE)
        # never written: its schema tells a reader of the state the types of the key
        handle.getValueState(KEY_VARIABLE, self.key)

    def _opened(self, names: dict[str, int]) -> tuple[dict[int, list], int]:
        """The open flows by the code of their key, and the number of parts they are stored in."""
        flows, parts = {}, [int(part) for (part,) in self.parts.keys()]
        for part in parts:
            for name, *flow in zip(*self.parts.getValue((part,))):
                flows[names.setdefault(name, len(names))] = flow
        return flows, len(parts)

    def _keep(self, flows: dict[int, list], names: dict[str, int], parts: int) -> None:
        texts, rows = list(names), list(flows.items())
        for part in range(max(parts, -(-len(rows) // self.piece_rows))):
            chunk = [(texts[code], *flow) for code, flow in rows[part * self.piece_rows : (part + 1) * self.piece_rows]]
            if chunk:
                self.parts.updateValue((part,), tuple(list(x) for x in zip(*chunk)))
            else:
                self.parts.removeKey((part,))

    def _store(self, waiting: list[tuple[int, int]], times: np.ndarray, values: np.ndarray, texts: np.ndarray) -> None:
        """Packets in time order as pieces, each with a number of its own."""
        number = max((n for _, n in waiting), default=-1)
        for at in range(0, len(times), self.piece_rows):
            number += 1
            name, part = (int(times[at]), number), slice(at, at + self.piece_rows)
            codes, names = pd.factorize(texts[part])
            self.pieces.updateValue(name, (times[part].tolist(), values[part].tolist(), codes.tolist(), names.tolist()))
            waiting.append(name)

    def _released(
        self, waiting: list[tuple[int, int]], moment: int, names: dict[str, int]
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, times, values) of the packets up to ``moment`` in time order, as runs; ``waiting`` keeps the pieces that stay."""
        waiting.sort()
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        runs, rows = [], 0
        while waiting and waiting[0][0] <= moment:
            t, v, c, texts = self.pieces.getValue(waiting[0])
            self.pieces.removeKey(waiting.pop(0))
            own = np.asarray([names.setdefault(x, len(names)) for x in texts], np.int64)
            piece = (own[np.asarray(c, np.int64)], np.asarray(t, np.int64), np.asarray(v, float))
            held = tuple(np.append(a, b) for a, b in zip(held, piece))
            order = np.argsort(held[1], kind="stable")
            held = tuple(a[order] for a in held)
            ready = int(np.searchsorted(held[1], min(moment, waiting[0][0] if waiting else moment), side="right"))
            if ready:
                runs.append(tuple(a[:ready] for a in held))
                held, rows = tuple(a[ready:] for a in held), rows + ready
            if rows >= WALK_PIECES * self.piece_rows:
                yield tuple(np.concatenate(a) for a in zip(*runs))
                runs, rows = [], 0
        if runs:
            yield tuple(np.concatenate(a) for a in zip(*runs))
        codes, times, values = held
        if len(times):
            self._store(waiting, times, values, np.asarray(list(names), object)[codes])

    def _advance(self, moment: int, frames: Iterator[pd.DataFrame] = iter(())) -> Iterator[pd.DataFrame]:
        """Flows that are closed at ``moment``; then the frames are stored and the next timer is set."""
        names: dict[str, int] = {}
        flows, parts = self._opened(names)
        waiting = [(int(first), int(number)) for first, number in self.pieces.keys()]
        changed = False
        for run in self._released(waiting, moment, names):
            changed = True
            closed = walk(flows, *run, self.idle, self.age)
            if closed:
                yield self._frame(closed, names)
        over = [(code, flow) for code, flow in flows.items() if self._limit(flow) <= moment]
        if over:
            changed = True
            yield self._frame(over, names)
            for code, _ in over:
                del flows[code]
        if changed:
            self._keep(flows, names, parts)
        for frame in frames:
            order = np.argsort(frame["t"].to_numpy(), kind="stable")
            self._store(waiting, frame["t"].to_numpy()[order], frame["v"].to_numpy(dtype=float)[order], frame["name"].to_numpy()[order])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = _least(min((first for first, _ in waiting), default=None), min(map(self._limit, flows.values()), default=None))
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def _limit(self, flow: list) -> int:
        return min(flow[1] + self.idle, flow[0] + self.age)

    def _frame(self, closed: list[tuple[int, list]], names: dict[str, int]) -> pd.DataFrame:
        texts = list(names)
        frame = pd.DataFrame([(texts[code], *flow) for code, flow in closed], columns=[NAME.name, *STATE_NAMES])
        return frame.assign(closed=pd.to_datetime(frame["last"], unit="us"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs() * 1000, rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000)

    def close(self) -> None:
        pass


def assemble_stream(
    packets: DataFrame,
    key: str | list[str],
    ts: str,
    value: str,
    idle_seconds: float = IDLE_SECONDS,
    age_seconds: float = AGE_SECONDS,
    lateness: str = "5 seconds",
    piece_rows: int = PIECE_ROWS,
    lanes: int = LANES,
) -> DataFrame:
    """Closed flows of a packet stream as raw sums; ``finish_flows`` turns them into features.

    The lateness of the watermark takes the part of a periodic sweep: flows close when event time has
    passed their limit by it. Packets that come out of order, but within the lateness, are put in their place; those
    that come later are dropped and counted by Spark. The state belongs in a RocksDB store (see ``rocksdb_state``).
    ``remaining_flows`` has what a stopped stream still holds. Keys are dealt to ``lanes`` by hash: a task holds the
    open flows of a lane, so more keys at a time want more lanes. The number is part of a checkpoint.
    """
    key = [key] if isinstance(key, str) else list(key)
    name = key_name(packets, key)
    ready = (
        packets.withColumn("ts__", F.col(ts).cast("timestamp"))
        .withWatermark("ts__", lateness)
        .select(name.alias("name"), "ts__", F.unix_micros("ts__").alias("t"), F.col(value).cast("double").alias("v"))
        .withColumn("lane", F.pmod(F.xxhash64("name"), F.lit(lanes)).cast("int"))
    )
    fields = [T.StructField(k, packets.schema[k].dataType) for k in key]
    closed = ready.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=FlowAssembler(T.StructType(fields), int(idle_seconds * 1e6), int(age_seconds * 1e6), piece_rows),
        outputStructType=T.StructType([NAME, *STATE.fields, T.StructField("closed", T.TimestampType())]),
        outputMode="Append",
        timeMode="EventTime",
    )
    return closed.select(*named_key("name", fields), *STATE_NAMES, "closed")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remaining_flows(
    spark: SparkSession, checkpoint: str, key: str | list[str], idle_seconds: float = IDLE_SECONDS, age_seconds: float = AGE_SECONDS
) -> DataFrame:
    """The final drain: flows that a stopped query holds, as raw sums, with ``followed``: whether a later one has begun.

    The open flows and the packets that wait are read from the state store, sorted by key and time, and walked as they
    come; a key is never one frame.
    """
    keys = [key] if isinstance(key, str) else list(key)
    idle, age = int(idle_seconds * 1e6), int(age_seconds * 1e6)
    opened, waiting, typed = [
        spark.read.format("statestore").option("stateVarName", v).load(checkpoint) for v in (STATE_VARIABLE, BUFFER_VARIABLE, KEY_VARIABLE)
    ]
    kinds = typed.schema["value"].dataType
    flow = F.explode(F.arrays_zip(*[f"user_map_value.{n}" for n in ("name", *STATE_NAMES)])).alias("f")
    opened = opened.select(flow).select("f.*")
    texts = F.transform("user_map_value.codes", lambda i: F.get("user_map_value.names", i)).alias("texts")
    columns = waiting.select("user_map_value.times", "user_map_value.values", texts)
    packets = columns.select(F.explode(F.arrays_zip("times", "values", "texts")).alias("p"))
    packets = packets.select(F.col("p.texts").alias("name"), F.col("p.times").alias("t__"), F.col("p.values").alias("v__"))
    rows = opened.unionByName(packets, allowMissingColumns=True)
    schema = T.StructType([NAME, *STATE.fields, T.StructField("followed", T.BooleanType())])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, flow = None, None
        for batch in batches:
            if not len(batch):
                continue
            codes, names = pd.factorize(batch["name"])
            out, flows = [], {}
            if flow is not None:
                if here == names[0]:
                    flows[0] = flow
                else:
                    out.append((here, *flow, False))
            whole = batch["t__"].isna().to_numpy()
            for code, values in zip(codes[whole].tolist(), batch.loc[whole, STATE_NAMES].itertuples(index=False)):
                flows[code] = [None if pd.isna(x) else float(x) if n in FRACTIONS else int(x) for n, x in zip(STATE_NAMES, values)]
            rest = batch.loc[~whole]
            closed = walk(flows, codes[~whole], rest["t__"].to_numpy(dtype=np.int64), rest["v__"].to_numpy(dtype=float), idle, age)
            here = names[-1]
            flow = flows.pop(len(names) - 1, None)
            out += [(names[c], *f, True) for c, f in closed] + [(names[c], *f, False) for c, f in flows.items()]
            yield pd.DataFrame(out, columns=schema.names)
        if flow is not None:
            yield pd.DataFrame([(here, *flow, False)], columns=schema.names)

    order = ["name", F.asc_nulls_first("t__")]
    left = rows.repartition("name").sortWithinPartitions(*order).mapInPandas(finish, schema)
    return left.select(*named_key("name", [kinds[k] for k in keys]), *STATE_NAMES, "followed")


def finish_flows(raw: DataFrame, key: str | list[str]) -> DataFrame:
    """Raw sums to the same columns as the batch form; a flow without values has none to report."""
    steps, n = F.col("packets").cast("double"), F.nullif(F.col("valued").cast("double"), F.lit(0.0))
    spread = (F.col("squares") - F.col("total") * F.col("total") / n) / F.nullif(n - 1, F.lit(0.0))
    moment = {c: F.timestamp_micros(c) for c in ("start", "last")}
    return raw.select(
        *([key] if isinstance(key, str) else key),
        moment["start"].alias("flow_start"),
        moment["last"].alias("flow_end"),
        "packets",
        (F.col("total") + n * F.col("center")).alias("value_sum"),
        (F.col("total") / n + F.col("center")).alias("value_mean"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("value_std"),
        F.col("low").alias("value_min"),
        F.col("high").alias("value_max"),
        ((F.col("last") - F.col("start")) / F.nullif(steps - 1, F.lit(0.0))).alias("iat_mean"),
        F.col("iat_low").alias("iat_min"),
        F.col("iat_high").alias("iat_max"),
        (F.col("last") - F.col("start")).alias("duration_us"),
    )
