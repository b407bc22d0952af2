"""Oversampling: targets for small classes, exact neighbours within a class, interpolated rows."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.hashing import HASH_BITS as KEY_BITS
from flowsieve.functions.hashing import seeded_hash, unit
from flowsieve.functions.values import all_rows, everything
from flowsieve.operators.profile import class_counts, class_sizes
from flowsieve.operators.sample import mark_stratified
from flowsieve.session import materialise

BLOCK_ROWS = 8192
#: Points of a leaf: inside a block only leaves near a query are measured.
LEAF_ROWS = 256
#: Queries that meet a block of points in one task, in blocks.
ASKING_BLOCKS = 4
#: Points that choose the cuts of a class: for each cell that is wanted, and at most.
CUT_POINTS, MAX_CUT_POINTS = 16, 1 << 16
_PLACE = 1 << 32  # cells are numbered above the blocks inside them
QUERY_CHUNK = 256
#: Distances that a search measures at a time: a handful of such matrices is what a worker holds.
CHUNK_CELLS = 1 << 18
EXPLODE_ROWS = 10_000
#: Sorted orders of the hashed search, and signs that make one.
HASH_TABLES, HASH_BITS = 8, 48


def second_largest(df: DataFrame, label: str) -> DataFrame:
    rank = F.row_number().over(W.orderBy(F.desc("n"), "class"))
    return class_counts(df, label).withColumn("rank__", rank).filter("rank__ = 2").drop("rank__")


def oversampling_targets(
    df: DataFrame, label: str, strategy: str = "dynamic", shares: dict[str, float] | None = None, share: float = 0.03
) -> DataFrame:
    """(class, n, target, extra) of the classes to enlarge.

    ``dynamic`` moves classes below the second largest halfway up to it, ``tiered`` gives named classes
    a share of all rows, ``uniform`` gives every class the same share.
    """
    counts = class_counts(df, label)
    total = F.sum("n").over(everything())
    if strategy == "dynamic":
        rank = F.row_number().over(W.orderBy(F.desc("n"), "class"))
        ranked = counts.withColumn("rank", rank)
        reference = F.max(F.when(F.col("rank") == 2, F.col("n"))).over(everything())
        goal = F.when(F.col("n") < reference, F.floor(F.col("n") + (reference - F.col("n")) / 2))
        counts = ranked.withColumn("target", goal)
    elif strategy == "tiered":
        table = F.create_map(*[F.lit(x) for pair in (shares or {}).items() for x in pair])
        counts = counts.withColumn("target", F.floor(total * F.try_element_at(table, F.col("class"))))
    elif strategy == "uniform":
        counts = counts.withColumn("target", F.floor(total * F.lit(share)))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return counts.filter(F.col("target") > F.col("n")).select(
        "class", "n", F.col("target").cast("long").alias("target"), (F.col("target") - F.col("n")).cast("long").alias("extra")
    )


def _class(c):
    """A class as Spark names it: pandas turns NULL into NaN."""
    return None if pd.isna(c) else c


def _rows_by_class(batch: pd.DataFrame):
    """(class, places of its rows) for each class of a batch."""
    codes, names = pd.factorize(batch["c"], use_na_sentinel=False)
    for i, c in enumerate(names):
        yield _class(c), np.flatnonzero(codes == i)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _nearest_block(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest points of each query in one block, ties by point id."""
    asking = _matrix(queries["v"]), queries["id"].to_numpy()
    return _nearest_points(*asking, _matrix(points["v"]), points["id"].to_numpy(), points["copies"].to_numpy(), k)


def _nearest_points(
    asking: np.ndarray, asking_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int
) -> pd.DataFrame:
    """The k nearest points of each query, ties by point id."""
    row, col, d = _nearest_pairs(asking, asking_ids, x, ids, k)
    return pd.DataFrame({"id": asking_ids[row], "neighbour": ids[col], "distance": d, "copies": copies[col]})


def _no_pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(p) for p in zip(_no_pairs(), *parts))


def _first_of_each(row: np.ndarray, col: np.ndarray, d: np.ndarray, names: np.ndarray, k: int) -> tuple:
    """The k nearest pairs of each query in order, ties by the names of the points."""
    order = np.lexsort((names[col], d, row))
    row, col, d = row[order], col[order], d[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first], d[first]


def _nearest_pairs(
    asking: np.ndarray, asking_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of queries, places of points, distances): the k nearest points of each query, ties by point id.

    Squared distances by the dot-product expansion only preselect; every pair that rounding could bring
    into the first k is measured again from the differences. One product, a row for each point, gives upper bounds
    of a chunk, without the query's own square, which all its pairs share. Where ``bound`` is known for all queries
    of a chunk, points farther away are left out, and no k-th smallest value is looked for.
    """
    if not len(x) or not len(asking):
        return _no_pairs()
    parts = []
    by_id = np.argsort(ids, kind="stable")
    names = np.argsort(by_id, kind="stable")
    norms = (x * x).sum(axis=1)
    bad = np.flatnonzero(~np.isfinite(norms))
    slack = 1e-9 * norms + 1e-12
    terms = np.column_stack([-2.0 * x, norms + slack])
    terms[bad], slack[bad] = 0.0, 0.0
    widest = slack.max()
    chunk = max(1, min(QUERY_CHUNK, CHUNK_CELLS // len(x)))
    for start in range(0, len(asking), chunk):
        q, qid = asking[start : start + chunk], asking_ids[start : start + chunk]
        own = (q * q).sum(axis=1)
        upper = terms @ np.column_stack([q, np.ones(len(q))]).T
        upper[bad] = np.inf
        upper[:, ~np.isfinite(own)] = np.inf
        upper[_same_ids(qid, ids, by_id)] = np.inf
        limit = np.full(len(q), np.inf) if bound is None else bound[start : start + chunk] ** 2 - own
        if not np.isfinite(limit).all():
            limit = np.fmin(limit, _kth_bound(upper, k))
        limit = limit + 2e-9 * own
        col, row = np.divmod(np.flatnonzero(upper <= limit + 2 * widest), len(q))
        at = upper[col, row]
        kept = np.isfinite(at) & (at - 2 * slack[col] <= limit[row])
        row, col = row[kept], col[kept]
        d = np.sqrt(((x[col] - q[row]) ** 2).sum(axis=1))
        row, col, d = _first_of_each(row, col, d, names, k)
        parts.append((row + start, col, d))
    return _joined(parts)


def _leaves(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """The places of the points in halves of halves along the axis of most variance, of at most ``rows``."""
    done, rest = [], [np.arange(len(x))]
    while rest:
        places = rest.pop()
        if len(places) <= rows:
            done.append(places)
            continue
        half = len(places) // 2
        order = np.argpartition(x[places, x[places].var(axis=0).argmax()], half)
        rest += [places[order[:half]], places[order[half:]]]
    return done


def _boxes_in_reach(x: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box: whether the box holds a place within the query's bound."""
    apart = np.zeros((len(x), len(low)))
    for axis in range(x.shape[1]):
        at = x[:, axis, None]
        apart += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0.0) ** 2
    return apart <= (bound * bound * (1 + 1e-9) + 1e-300)[:, None]


def _nearest_in_leaves(
    asking: np.ndarray, asking_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_nearest_pairs`` within ``bound``, measuring only the leaves of the points whose boxes are in reach of a query.

    Without a bound, a query gets one from the leaf that is nearest to it.
    """
    if not len(x) or not len(asking):
        return _no_pairs()
    leaves = _leaves(x, LEAF_ROWS)
    low, high = np.stack([x[p].min(axis=0) for p in leaves]), np.stack([x[p].max(axis=0) for p in leaves])
    names = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    if bound is None:
        bound, nearest = np.full(len(asking), np.inf), np.zeros(len(asking), dtype=int)
        for start in range(0, len(asking), QUERY_CHUNK):
            q = asking[start : start + QUERY_CHUNK]
            apart = sum(np.maximum(np.maximum(low[:, a] - q[:, a, None], q[:, a, None] - high[:, a]), 0.0) ** 2 for a in range(x.shape[1]))
            nearest[start : start + QUERY_CHUNK] = apart.argmin(axis=1)
        for i, places in enumerate(leaves):
            own = np.flatnonzero(nearest == i)
            row, _, d = _nearest_pairs(asking[own], asking_ids[own], x[places], ids[places], k)
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            bound[own[row[last]]] = d[last]
    found = []
    chunk = max(QUERY_CHUNK, CHUNK_CELLS // len(leaves) // 4)
    for start in range(0, len(asking), chunk):
        near = _boxes_in_reach(asking[start : start + chunk], bound[start : start + chunk], low, high)
        parts = []
        for i, places in enumerate(leaves):
            own = np.flatnonzero(near[:, i]) + start
            row, col, d = _nearest_pairs(asking[own], asking_ids[own], x[places], ids[places], k, bound[own])
            parts.append((own[row], places[col], d))
        found.append(_first_of_each(*_joined(parts), names, k))
    return _joined(found)


def _cuts(sample: np.ndarray, share: float, rows: float) -> list:
    """A tree of (axis, cut, tree below, tree from the cut on): each leaf, [], stands for at most ``rows`` points.

    Each point of the sample stands for ``share`` points; a cut needs eight of them.
    """
    spread = sample.var(axis=0) if len(sample) >= 8 and len(sample) * share > rows else np.zeros(0)
    if not spread.size or not spread.max() > 0:
        return []
    axis = int(spread.argmax())
    values = np.sort(sample[:, axis])
    cut = values[len(values) // 2]
    cut = values[values > values[0]][0] if cut == values[0] else cut
    below = sample[:, axis] < cut
    return [axis, cut, _cuts(sample[below], share, rows), _cuts(sample[~below], share, rows)]


def _cell_numbers(x: np.ndarray, tree: list) -> np.ndarray:
    """The number of the leaf of each point, in the order of the tree."""
    cell, number, rest = np.zeros(len(x), dtype=int), 0, [(tree, np.arange(len(x)))]
    while rest:
        node, places = rest.pop()
        if node:
            axis, cut, low, high = node
            below = x[places, axis] < cut
            rest += [(high, places[~below]), (low, places[below])]
        else:
            cell[places] = number
            number += 1
    return cell


def _same_ids(qid: np.ndarray, ids: np.ndarray, by_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of points, places of queries) of the pairs of the same id; ``by_id`` sorts the ids."""
    first = np.searchsorted(ids, qid, "left", sorter=by_id)
    many = np.searchsorted(ids, qid, "right", sorter=by_id) - first
    row = np.repeat(np.arange(len(qid)), many)
    col = by_id[np.arange(len(row)) + np.repeat(first - (np.cumsum(many) - many), many)]
    equal = ids[col] == qid[row]  # a missing id is found, but equals none
    return col[equal], row[equal]


def _kth_bound(values: np.ndarray, k: int) -> np.ndarray:
    """For each column a number that at least k of its values do not exceed, close to the smallest such number.

    The k smallest of many values mostly lie in different groups of rows, so the least of each group are enough.
    """
    groups = 32 * k
    many = len(values) // groups
    if many >= 4:
        values = values[: many * groups].reshape(many, groups, -1).min(axis=0)
    kth = min(k, len(values)) - 1
    return np.partition(values, kth, axis=0)[kth]


def distinct_points(df: DataFrame, label: str, key: str, features: list[str]) -> DataFrame:
    """(c, v, id, copies): equal rows of a class as one point, named by their smallest key."""
    v = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return (
        df.select(F.col(f"`{label}`").alias("c"), v.alias("v"), F.col(key).alias("id"))
        .groupBy("c", "v")
        .agg(F.min("id").alias("id"), all_rows().alias("copies"))
        .withColumn("asks", F.lit(True))
    )


def nearest_in_class(points: DataFrame, k: int, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(c, id, neighbour, distance, copies, rank): exact k nearest other points of the same class.

    Every point may be a neighbour; those with ``asks`` are given theirs.

    A class is cut into cells along the axes, at medians of a hashed sample, and cells that are still large into blocks
    of bounded size. Each query gets a first bound from its own block. Then a cell is searched only if its bounding box
    has a place within that bound, and in it only such leaves (a k-d tree of two levels). The cuts decide the work, not
    the result. The queries of a block of points come in lanes of at most about ``ASKING_BLOCKS`` blocks, so a task
    holds no more of them, and a block of points is sent once for each lane.
    """
    sizes = class_sizes(points, "c")
    id_type = points.schema["id"].dataType
    class_type = points.schema["c"].dataType
    result = T.StructType(
        [
            T.StructField("c", class_type),
            T.StructField("id", id_type),
            T.StructField("neighbour", id_type),
            T.StructField("distance", T.DoubleType()),
            T.StructField("copies", T.LongType()),
        ]
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=result.names)
        asking, asking_ids = _matrix(left["v"]), left["id"].to_numpy()
        ids, copies = np.asarray(right["ids"].iat[0]), np.asarray(right["copies"].iat[0])
        x = np.asarray(right["flat"].iat[0]).reshape(len(ids), -1)
        row, col, d = _nearest_in_leaves(asking, asking_ids, x, ids, k, left["bound"].to_numpy())
        near = {"c": left["c"].iat[0], "id": asking_ids[row], "neighbour": ids[col], "distance": d, "copies": copies[col]}
        return pd.DataFrame(near, columns=result.names)

    # Not the hash that a split of the rows by their keys is made of, or a part would hold none of the sample.
    order = seeded_hash([F.col("id"), F.lit("cuts")], seed)
    wanted = {c: min(n, CUT_POINTS * ceil(n / block_rows), MAX_CUT_POINTS) for c, n in sizes.items() if n > block_rows}
    trees: dict = {c: [] for c in sizes}
    if wanted:
        chosen = [F.col("c").eqNullSafe(F.lit(c)) & (order < F.lit(int(wanted[c] / sizes[c] * (1 << KEY_BITS)))) for c in wanted]

        def cut(drawn: pd.DataFrame) -> pd.DataFrame:
            c = _class(drawn["c"].iat[0])
            x = _finite(_matrix(drawn["v"]))[0]
            # A fifth less than a block, because a sample is not exact.
            tree = _cuts(x, sizes[c] / max(1, len(x)), 0.8 * block_rows)
            return pd.DataFrame({"c": drawn["c"].iloc[:1], "tree": json.dumps(tree)})

        # The sample of a class is one task; only its cuts come to the driver.
        cut_type = T.StructType([T.StructField("c", class_type), T.StructField("tree", T.StringType())])
        drawn = points.filter(reduce(or_, chosen)).select("c", "v")
        for r in drawn.groupBy("c").applyInPandas(cut, cut_type).collect():
            trees[r["c"]] = json.loads(r["tree"])

    celled = T.StructType(points.schema.fields + [T.StructField("cell", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            for c, rows in _rows_by_class(batch):
                # what has no finite square is nobody's neighbour and has none
                x, finite = _finite(_matrix(batch["v"].iloc[rows]))
                yield batch.iloc[rows[finite]].assign(cell=_cell_numbers(x, trees[c]))

    placed = materialise(points.mapInPandas(assign, celled), "knn-cells")
    axes = range(placed.agg(F.max(F.size("v"))).first()[0] or 1)
    box = [F.array(*[f(F.get("v", F.lit(i))) for i in axes]).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    made = placed.groupBy("c", "cell").agg(all_rows().alias("n"), *box)
    made = materialise(made.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "knn-cell-boxes")
    by_class: dict = {}
    for r in made.collect():
        by_class.setdefault(r["c"], []).append((r["cell"], r["blocks"], r["low"], r["high"]))
    cells = {
        c: ([np.arange(n) + cell * _PLACE for cell, n, _, _ in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        for c, rows in by_class.items()
    }
    spread = seeded_hash(["id"], seed + 1)
    sized = made.select(F.col("c").alias("c__"), F.col("cell").alias("cell__"), "blocks")
    place_of = F.col("cell").cast("long") * _PLACE + spread % F.col("blocks")
    blocked = placed.join(sized, F.col("c").eqNullSafe(F.col("c__")) & (F.col("cell") == F.col("cell__")))
    blocked = blocked.select("c", "id", "v", "copies", "asks", place_of.alias("place"))

    bounded = T.StructType([*(points.schema[f] for f in ("c", "id", "v")), T.StructField("bound", T.DoubleType())])

    def first_bound(group: pd.DataFrame) -> pd.DataFrame:
        asking = np.flatnonzero(group["asks"])
        x, ids, bound = _matrix(group["v"]), group["id"].to_numpy(), np.full(len(asking), np.inf)
        row, _, d = _nearest_in_leaves(x[asking], ids[asking], x, ids, k)
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
        bound[row[last]] = d[last]
        return group.iloc[asking][["c", "id", "v"]].assign(bound=bound)

    queries = blocked.groupBy("c", "place").applyInPandas(first_bound, bounded)

    def targets(batches):
        for batch in batches:
            for c, rows in _rows_by_class(batch):
                blocks, low, high = cells[c]
                for start in range(0, len(rows), QUERY_CHUNK):
                    part = batch.iloc[rows[start : start + QUERY_CHUNK]]
                    hits = np.empty(len(part), dtype=object)
                    for at, row in enumerate(_boxes_in_reach(_matrix(part["v"]), part["bound"].to_numpy(), low, high)):
                        hits[at] = np.concatenate([blocks[j] for j in np.flatnonzero(row)])
                    # the lists of a few queries at a time: they grow with the class
                    yield part.assign(hits=hits)

    asked = T.StructType(bounded.fields + [T.StructField("hits", T.ArrayType(T.LongType()))])
    # Written, because the searches are read twice; finding them costs a search of every own block.
    aimed = materialise(queries.mapInPandas(targets, asked), "knn-searches")
    searches = aimed.select("c", "id", "v", "bound", F.explode("hits").alias("place"))
    lanes = F.ceil(all_rows() / (ASKING_BLOCKS * block_rows)).alias("lanes")
    # Written, so that Spark sees how small it is and moves no rows for it.
    needed = materialise(searches.groupBy(F.col("c").alias("c__"), F.col("place").alias("place__")).agg(lanes), "knn-lanes")
    met = F.col("c").eqNullSafe(F.col("c__")) & (F.col("place") == F.col("place__"))
    lane = (seeded_hash(["id"], seed + 2) % F.col("lanes")).alias("lane")
    searches = searches.join(needed, met).select("c", "id", "v", "bound", "place", lane)
    # A block is sent to all lanes that ask it, as one row.
    packed = blocked.groupBy("c", "place").agg(F.collect_list(F.struct("id", "copies", "v")).alias("p"))
    stores = packed.join(needed, met).select(
        "c", "place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"),
        F.col("p.id").alias("ids"), F.col("p.copies").alias("copies"), F.flatten("p.v").alias("flat"),
    )
    place = ["c", "place", "lane"]
    found = searches.groupBy(*place).cogroup(stores.groupBy(*place)).applyInPandas(search, result)
    return _ranked(found, k)


def _finite(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the rows whose sum of squares is finite, their places)."""
    with np.errstate(over="ignore", invalid="ignore"):
        places = np.flatnonzero(np.isfinite((x * x).sum(axis=1)))
    return x[places], places


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what the searches found for each point; no list of all that was found is made."""
    order = W.partitionBy("c", "id").orderBy("distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("c", "id", "neighbour", "distance", "copies", "rank")


def hashed_neighbours(
    points: DataFrame, k: int, seed: int = 42, block_rows: int = BLOCK_ROWS, tables: int = HASH_TABLES
) -> DataFrame:
    """(c, id, neighbour, distance, copies, rank): k near other points of the same class, by hashed order.

    For classes too large for the exact search of ``nearest_in_class``: work grows with the rows, not their square.
    Each table sorts the points of a class by the signs of random directions around the class mean, so that near
    points tend to stand together, and compares runs of ``block_rows`` points that overlap by half. Distances are
    exact; some nearest points may be missed. ``tables`` raises recall, at proportional cost. Runs begin where Spark's
    range partitions do, so another partitioning may find others. Points with ``asks`` ask, and all of them get ``k``.
    """
    id_type, class_type = points.schema["id"].dataType, points.schema["c"].dataType
    at = F.posexplode("v").alias("axis", "x")
    means = points.select("c", at).groupBy("c", "axis").agg(F.avg("x").alias("mean"))
    centre = materialise(
        means.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "mean"))), lambda m: m["mean"]).alias("centre")),
        "hash-centres",
    ).withColumnRenamed("c", "c__")
    placed = points.join(centre, F.col("c").eqNullSafe(F.col("c__"))).drop("c__")
    coded_schema = T.StructType(points.schema.fields + [T.StructField("part", T.IntegerType()), T.StructField("code", T.LongType())])

    def encode(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["v"]) - _matrix(batch["centre"])
            for part in range(tables):
                directions = np.random.default_rng([seed, part]).normal(size=(x.shape[1], HASH_BITS))
                code = (x @ directions > 0) @ (1 << np.arange(HASH_BITS, dtype=np.int64)[::-1])
                yield batch.drop(columns="centre").assign(part=part, code=code)

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _nearest_block(rows[rows["asks"]], rows, k).assign(c=key[1])[["c", "id", "neighbour", "distance", "copies"]]

    def compare(batches):
        here, held = None, None
        for batch in batches:
            for (part, c), rows in batch.groupby(["part", "c"], dropna=False, sort=False):
                if (part, _class(c)) != here:
                    if held is not None:
                        yield search(here, held)
                    here, held = (part, _class(c)), rows
                else:
                    held = pd.concat([held, rows], ignore_index=True)
                while len(held) > block_rows:
                    yield search(here, held.iloc[:block_rows])
                    held = held.iloc[block_rows // 2 :]
        if held is not None:
            yield search(here, held)

    result = T.StructType(
        [
            T.StructField("c", class_type),
            T.StructField("id", id_type),
            T.StructField("neighbour", id_type),
            T.StructField("distance", T.DoubleType()),
            T.StructField("copies", T.LongType()),
        ]
    )
    sorted_points = (
        placed.mapInPandas(encode, coded_schema)
        .repartitionByRange("part", "c", "code", "id")
        .sortWithinPartitions("part", "c", "code", "id")
    )
    found = materialise(_ranked(sorted_points.mapInPandas(compare, result).distinct(), k), "hashed-neighbours")
    # A point alone in its runs, as at the edge of a partition, is asked again exactly.
    due = points.groupBy(F.col("c").alias("c__")).agg(F.least(F.count(F.lit(1)) - 1, F.lit(k)).alias("due"))
    got = found.groupBy(F.col("id").alias("id__")).agg(all_rows().alias("got"))
    counted = points.join(due, F.col("c").eqNullSafe(F.col("c__"))).join(got, F.col("id") == F.col("id__"), "left")
    short = F.col("asks") & (F.coalesce("got", F.lit(0)) < F.col("due"))
    rest = materialise(counted.select(*[c for c in points.columns if c != "asks"], short.alias("asks")), "hashed-rest")
    if rest.filter("asks").isEmpty():
        return found
    again = nearest_in_class(rest, k, seed, block_rows)
    return found.join(rest.filter("asks").select("id"), "id", "left_anti").select(*again.columns).unionAll(again)


def synthetic_rows(
    df: DataFrame,
    label: str,
    key: str,
    features: list[str],
    extra: dict,
    k: int = 5,
    seed: int = 42,
    portable: bool = False,
    block_rows: int = BLOCK_ROWS,
    neighbours: Callable[..., DataFrame] = nearest_in_class,
) -> DataFrame:
    """Exactly ``extra[class]`` rows x + g (y - x), y one of the k nearest neighbours of x in its class.

    Every row of a class is a seed equally often, the remainder going to rows in hash order; the
    neighbour and the gap g come from hashes of the seed and its repetition. A copy of the seed is a
    neighbour at distance 0. ``neighbours`` is the search: exact, or ``hashed_neighbours`` for very large classes.
    """
    if not extra:
        raise ValueError("no class to enlarge")
    sizes = class_sizes(df, label)
    for c in extra:
        if sizes.get(c, 0) <= k:
            raise ValueError(f"class {c!r} has {sizes.get(c, 0)} rows; {k} neighbours need more than {k}")
    small = df.filter(F.col(f"`{label}`").isin(list(extra)))
    every = {c: n // sizes[c] for c, n in extra.items()}
    rest = {c: n % sizes[c] for c, n in extra.items()}
    marked = mark_stratified(small, label, [key], rest, seed, portable)

    base = F.create_map(*[x for c, n in every.items() for x in (F.lit(c), F.lit(n).cast("long"))])
    v = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    weighted = marked.select(
        F.col(f"`{label}`").alias("c"), v.alias("v"), F.col(key).alias("id"),
        (F.try_element_at(base, F.col(f"`{label}`")) + F.col("picked").cast("long")).alias("quota"),
    )
    points = materialise(
        weighted.groupBy("c", "v").agg(
            F.min("id").alias("id"), all_rows().alias("copies"), F.sum("quota").alias("quota")
        ),
        "smote-points",
    )
    asking = points.select("c", "v", "id", "copies", (F.col("quota") > 0).alias("asks"))
    near = neighbours(asking, k, seed, block_rows)
    ladder = near.groupBy("c", "id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbour", "copies"))).alias("ladder")
    )
    # A point with many copies is a seed many times: its repetitions are dealt out in bounded runs.
    runs = points.join(ladder, ["c", "id"], "left").select(
        "c", "id", "v", "quota", "copies", "ladder",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / EXPLODE_ROWS))).alias("run"),
    ).filter("quota > 0").repartition("c", "id", "run")
    first = F.col("run") * EXPLODE_ROWS
    draws = runs.select(
        "c", "id", "v", "copies", "ladder",
        F.explode(F.sequence(first + 1, F.least(first + EXPLODE_ROWS, F.col("quota")))).alias("draw"),
    )
    nth = seeded_hash(["id", "draw"], seed + 1, portable) % k
    # Ranks 0 .. copies-2 are the seed's own copies; further ranks walk up the ladder of neighbours.
    beyond = nth - (F.col("copies") - 1)
    step = F.aggregate(
        F.coalesce(F.col("ladder"), F.array()),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(points.schema["id"].dataType).alias("hit")),
        lambda a, n: F.struct(
            (a["seen"] + n["copies"]).alias("seen"),
            F.when((a["hit"].isNull()) & (F.col("beyond") < a["seen"] + n["copies"]), n["neighbour"]).otherwise(a["hit"]).alias("hit"),
        ),
    )["hit"]
    chosen = draws.withColumn("beyond", beyond).select(
        "c", "id", "v", "draw",
        F.when(F.col("beyond") < 0, F.col("id")).otherwise(step).alias("neighbour"),
        unit(seeded_hash(["id", "draw"], seed + 2, portable)).alias("gap"),
    )
    ends = points.select("c", F.col("id").alias("neighbour"), F.col("v").alias("w"))
    mixed = chosen.join(ends, ["c", "neighbour"]).select(
        F.col("c").alias(label), F.col("id").alias("seed_id"), "draw", "neighbour", "gap",
        F.zip_with("v", "w", lambda a, b: a + F.col("gap") * (b - a)).alias("row__"),
    )
    return mixed.select(
        label, "seed_id", "draw", "neighbour", "gap", *[F.get("row__", F.lit(i)).alias(f) for i, f in enumerate(features)]
    )


def oversample(
    train: DataFrame,
    label: str,
    key: str,
    features: list[str],
    strategy: str = "dynamic",
    k: int = 5,
    seed: int = 42,
    neighbours: Callable[..., DataFrame] = nearest_in_class,
    **rule,
) -> DataFrame:
    """The training rows with their synthetic ones; ``synthetic`` tells them apart.

    ``neighbours`` is the search: exact, or ``neighbour_graph`` for classes so large that work must be linear in them.
    The key becomes text: a synthetic row is named by its seed and its number among the seed's rows.
    """
    extra = {r["class"]: r["extra"] for r in oversampling_targets(train, label, strategy, **rule).collect()}
    columns = [F.col(f"`{label}`"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features]]
    real = train.select(F.col(key).cast("string").alias(key), *columns, F.lit(False).alias("synthetic"))
    if not extra:
        return real
    made = synthetic_rows(train, label, key, features, extra, k, seed, neighbours=neighbours)
    name = F.concat_ws("#", F.col("seed_id").cast("string"), F.col("draw").cast("string"))
    return real.unionByName(made.select(name.alias(key), *columns, F.lit(True).alias("synthetic")))
