"""Near neighbours within large classes: a graph of bounded lists, refined by neighbours of neighbours.

The published idea (NN-descent): a neighbour of a neighbour is likely to be a neighbour. Lists start from a few sorted
hash orders and are then improved in rounds. In a round every point brings the points that name it, or that it names,
together; each pair of them that is new is measured, and enters the lists that it improves. All steps are keyed by the
data: places in the hash orders are exact ranks, reverse lists are chosen by seeded hashes. Neither the number of
partitions nor their order has any influence on the result. Work is linear in the points: a fixed number of pairs each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.functions.hashing import seeded_hash
from flowsieve.functions.values import all_rows
from flowsieve.operators.balance import _matrix, _nearest_block
from flowsieve.operators.running import running_sums
from flowsieve.session import materialise

#: Sorted orders and the signs that make one; points of a run; longest refinement; share of changed entries that ends it.
TABLES, SIGNS, RUN_ROWS, ROUNDS, SETTLED = 4, 48, 512, 6, 0.002
#: Entries of a list, for each neighbour that is asked for, and the least number.
WIDTH_FACTOR, LEAST_WIDTH = 2, 12
SALTS = 64
BATCH_NODES = 256


def neighbour_graph(
    points: DataFrame,
    k: int,
    seed: int = 42,
    run_rows: int = RUN_ROWS,
    tables: int = TABLES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(c, id, neighbour, distance, copies, rank): ``k`` near other points of the same class, at their true distances.

    ``points`` are distinct (c, v, id, copies, asks) as ``distinct_points`` gives them, ids unique; every point may be a
    neighbour, those with ``asks`` are given theirs, ``k`` each or all others of a smaller class. A class of at most
    ``run_rows`` points is searched exactly. In a larger one some nearest points may be missed; ``tables`` and ``rounds``
    raise recall at proportional cost. Ties go to the smaller id.
    """
    width = max(WIDTH_FACTOR * k, LEAST_WIDTH)
    run_rows = max(run_rows, 4 * width)
    sizes = points.groupBy(F.col("c").alias("c__")).agg(all_rows().alias("n__"))
    points = materialise(points.join(sizes, F.col("c").eqNullSafe(F.col("c__"))).drop("c__"), "graph-points")
    graph = materialise(_best(_started(points, width, seed, run_rows, tables), width), "graph")
    large = points.filter(F.col("n__") > run_rows)
    total = large.count()
    for at in range(rounds if total else 0):
        met = _measured(graph, large, width, seed + at)
        before = graph.drop("rank").withColumn("fresh", F.lit(False))
        graph = materialise(_best(before.unionByName(met), width), "graph")
        if graph.filter(F.col("fresh") & (F.col("rank") <= k)).count() <= SETTLED * k * total:
            break
    asking = points.filter("asks").select(F.col("id").alias("id__"))
    other = points.select(F.col("id").alias("other__"), "copies")
    found = graph.filter(F.col("rank") <= k).join(asking, F.col("id") == F.col("id__")).join(other, F.col("neighbour") == F.col("other__"))
    return found.select("c", "id", "neighbour", "distance", "copies", "rank")


def _best(found: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest of the pairs of each point; a pair that was known before is not fresh."""
    pairs = found.groupBy("c", "id", "neighbour").agg(F.min("distance").alias("distance"), F.every("fresh").alias("fresh"))
    order = W.partitionBy("c", "id").orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= width)


def _pair_schema(points: DataFrame) -> T.StructType:
    kind = points.schema["id"].dataType
    fields = [("c", points.schema["c"].dataType), ("id", kind), ("neighbour", kind), ("distance", T.DoubleType()), ("fresh", T.BooleanType())]
    return T.StructType([T.StructField(*f) for f in fields])


def _started(points: DataFrame, width: int, seed: int, run_rows: int, tables: int) -> DataFrame:
    """The nearest points inside runs of several sorted orders, each run overlapping its neighbours by half.

    An order sorts a class by the signs of random directions around the class mean. A class of one run has one order.
    """
    axis = F.posexplode("v").alias("axis", "x")
    means = points.select("c", axis).groupBy("c", "axis").agg(F.avg("x").alias("mean"))
    centres = means.groupBy(F.col("c").alias("c__")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("axis", "mean"))), lambda m: m["mean"]).alias("centre")
    )
    placed = points.join(materialise(centres, "graph-centres"), F.col("c").eqNullSafe(F.col("c__"))).drop("c__", "asks", "copies")
    coded = T.StructType([*(placed.schema[f] for f in ("c", "id", "v", "n__")), T.StructField("part", T.IntegerType()), T.StructField("code", T.LongType())])

    def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, large = _matrix(batch["v"]) - _matrix(batch["centre"]), (batch["n__"] > run_rows).to_numpy()
            for part in range(tables):
                directions = np.random.default_rng([seed, part]).normal(size=(x.shape[1], SIGNS))
                code = (x @ directions > 0) @ (1 << np.arange(SIGNS, dtype=np.int64)[::-1])
                kept = large | (part == 0)
                yield batch.drop(columns="centre").assign(part=part, code=code)[kept][coded.names]

    codes = placed.mapInPandas(encode, coded).select("*", F.struct("code", "id").alias("order__"), F.lit(1).alias("one"))
    ranked = running_sums(materialise(codes, "graph-codes"), ["part", "c"], "order__", ["one"])
    half = run_rows // 2
    here = F.floor((F.col("run_one") - 1) / half)
    last = F.greatest(F.ceil(F.col("n__") / half) - 2, F.lit(0))
    runs = F.array_distinct(F.array(F.greatest(here - 1, F.lit(0)), F.least(here, last)))
    dealt = ranked.select("part", "c", "id", "v", F.lit(1).cast("long").alias("copies"), F.explode(runs).alias("run"))

    result = _pair_schema(points)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _nearest_block(pdf, pdf, width)
        return near.assign(c=pdf["c"].iat[0], fresh=True)[result.names]

    return dealt.groupBy("part", "c", "run").applyInPandas(search, result)


def _measured(graph: DataFrame, points: DataFrame, width: int, seed: int) -> DataFrame:
    """Pairs that meet at a common neighbour, one of them there for the first time, and improve a list."""
    own = graph.join(points.select(F.col("id").alias("id__")), F.col("id") == F.col("id__")).drop("id__")
    own = own.select("c", "id", "neighbour", "distance", "fresh", "rank")
    forward = own.select("c", F.col("id").alias("node"), F.col("neighbour").alias("other"), "fresh")
    backward = own.select("c", F.col("neighbour").alias("node"), F.col("id").alias("other"), "fresh")
    # A point that very many name keeps ``width`` of them, fresh ones first: picked by hash, in salted parts before the whole.
    lot = seeded_hash(["other"], seed)
    order = (F.desc("fresh"), F.col("lot"), F.col("other"))
    backward = backward.withColumns({"lot": lot, "salt": F.pmod(lot, F.lit(SALTS))})
    for part in (["node", "salt"], ["node"]):
        backward = backward.withColumn("at", F.row_number().over(W.partitionBy(*part).orderBy(*order))).filter(F.col("at") <= width)
    lists = forward.unionByName(backward.select("c", "node", "other", "fresh")).groupBy("c", "node", "other").agg(F.max("fresh").alias("fresh"))
    bound = own.groupBy(F.col("id").alias("id__")).agg(F.max(F.when(F.col("rank") == width, F.col("distance"))).alias("bound"))
    vectors = points.select(F.col("id").alias("other__"), "v").join(bound, F.col("other__") == F.col("id__"), "left").drop("id__")
    members = lists.join(vectors, F.col("other") == F.col("other__")).select("c", "node", "other", "fresh", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    schema = _pair_schema(points)
    out = to_arrow_schema(schema)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            starts = _starts(table.column("node"))
            rest = table.slice(starts[-1])
            yield from _meetings(table, starts, out)
        if rest is not None:
            yield from _meetings(rest, [0, len(rest)], out)

    return members.repartition("node").sortWithinPartitions("node", "other").mapInArrow(meet, schema)


def _starts(nodes: pa.ChunkedArray) -> list[int]:
    """Where each node's rows begin."""
    change = pc.not_equal(nodes.slice(1), nodes.slice(0, len(nodes) - 1)).to_numpy()
    return [0, *(np.flatnonzero(change) + 1).tolist()]


def _meetings(table: pa.Table, starts: list[int], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs of the nodes that begin at ``starts``, but for the last start, which is the end."""
    for a in range(0, len(starts) - 1, BATCH_NODES):
        edges = np.asarray(starts[a : a + BATCH_NODES + 1])
        part = table.slice(edges[0], edges[-1] - edges[0]).combine_chunks()
        lengths = np.diff(edges)
        longest, dims = int(lengths.max()), len(part.column("v")[0])
        values = part.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        fresh = part.column("fresh").to_numpy()
        bound = part.column("bound").to_numpy()
        row = np.arange(longest)[None, :] + (edges[:-1] - edges[0])[:, None]
        real = np.arange(longest)[None, :] < lengths[:, None]
        row = np.where(real, row, 0)
        x = values[row]
        norms = (x * x).sum(2)
        scale = norms[:, :, None] + norms[:, None, :]
        rough = scale - 2.0 * (x @ x.transpose(0, 2, 1))
        wanted = real[:, :, None] & real[:, None, :] & (fresh[row][:, :, None] | fresh[row][:, None, :])
        wanted &= ~np.eye(longest, dtype=bool)[None]
        limit = bound[row][:, :, None]
        wanted &= rough - (1e-9 * scale + 1e-12) <= limit * limit
        node, i, j = np.nonzero(wanted)
        first, second = row[node, i], row[node, j]
        distance = np.sqrt(((values[second] - values[first]) ** 2).sum(1))
        better = distance <= bound[first]
        first, second, distance = first[better], second[better], distance[better]
        names = part.column("other").combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [
                part.column("c").combine_chunks().take(pa.array(first)),
                names.take(pa.array(first)),
                names.take(pa.array(second)),
                pa.array(distance),
                pa.array(np.ones(len(first), bool)),
            ],
            schema=out,
        )
