"""Nearest neighbours by cosine through collision-counting hashing with query-centred windows.

Vectors are dealt to shards of bounded size. A shard keeps, for each of many random projections, its vectors in a
sorted array. A query opens a window around its own projection in every array; virtual rehashing widens all windows
with the search radius. A vector that collides with the query in enough
arrays is verified with its exact cosine. A query is done in a shard once it has enough verified vectors within the
radius; beyond the largest radius all vectors left are verified. There is no limit on candidates. Queries visit the
shards in blocks; the best of all shards are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Projections, half a window per unit of radius, first radius and its growth, vectors of a shard.
PROJECTIONS, HALF_WINDOW, FIRST_RADIUS, GROWTH, SHARD_ROWS = 128, 0.76, 0.5, 1.25, 2048
#: Collisions needed lie so many standard deviations below the mean for a vector at the radius.
SLACK = 1.5
QUERY_BLOCK = 256


class Shard:
    """Sorted projection arrays of a bounded number of vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seed: int = 3):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.directions = np.random.default_rng(seed).normal(size=(PROJECTIONS, vectors.shape[1]))
        values = ((vectors / self.norms[:, None]) @ self.directions.T).T
        order = np.argsort(values, axis=1)
        self.values = np.take_along_axis(values, order, axis=1)
        # The place of each vector in each sorted array: a window is an interval of places.
        self.places = np.empty(values.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)
        chance = math.erf(HALF_WINDOW / math.sqrt(2))
        self.needed = max(1, int(PROJECTIONS * chance - SLACK * math.sqrt(PROJECTIONS * chance * (1 - chance))))

    def cosines(self, query: np.ndarray, norm: float, rows: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * query).sum(1) / (norm * self.norms[rows])

    def search(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, ids, cosines) of its best vectors here, best first, its own left out."""
        norms = np.sqrt((queries * queries).sum(1))
        centre = (queries / norms[:, None]) @ self.directions.T
        open_ = [self.ids != i for i in ids]  # not yet verified
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
        active, radius = list(range(len(ids))), FIRST_RADIUS
        while active:
            last = radius >= 2
            if not last:
                half = HALF_WINDOW * radius
                near = list(zip(self.values, centre[active].T))
                low = np.stack([np.searchsorted(v, c - half, "left") for v, c in near], axis=1).astype(self.places.dtype)
                high = np.stack([np.searchsorted(v, c + half, "right") for v, c in near], axis=1).astype(self.places.dtype)
                width = high - low
            still = []
            for at, q in enumerate(active):
                if last:
                    rows = np.flatnonzero(open_[q])
                else:
                    # Unsigned: a place below the window wraps around and is outside, too.
                    inside = self.places - low[at][:, None] < width[at][:, None]
                    collisions = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)  # fewer than 256 arrays
                    rows = np.flatnonzero(open_[q] & (collisions >= self.needed))
                open_[q][rows] = False
                found[q] = (np.append(found[q][0], rows), np.append(found[q][1], self.cosines(queries[q], norms[q], rows)))
                if not last and (found[q][1] >= 1 - radius * radius / 2).sum() < self.k:
                    still.append(q)
            active, radius = still, radius * GROWTH
        for q, (rows, scores) in enumerate(found):
            best = np.lexsort((self.ids[rows], -scores))[: self.k]
            yield q, self.ids[rows[best]], scores[best]


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them present and finite, and one that is not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors found nearest to each query by cosine, ties to the smaller id.

    A query's own id is no candidate. Vectors that are NULL, empty, zero, or hold a NULL or a value that is not finite
    take no part, nor do rows with a NULL id. Vectors meet those of their own length only. An id stands for one query;
    repeated rows are candidates each. With fewer than ``k`` candidates all are returned; an empty table gives none.
    """
    own = vectors.select(
        vectors[vec_id].cast("long").alias("id"),
        F.when(usable(vectors[vector]), vectors[vector].cast("array<double>")).alias("v"),
        is_query.alias("q"),
    ).filter("v IS NOT NULL AND id IS NOT NULL")
    own = own.withColumn("dim", F.size("v"))
    # one number for each length of vector, as an expression: a join on the length would be a join on one hot key
    sizes = own.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")).collect()
    shards = F.create_map(*[F.lit(x) for r in sizes for x in (r["dim"], r["shards"])]) if sizes else F.create_map().cast("map<int,int>")
    own = own.withColumn("shards", F.try_element_at(shards, F.col("dim")))
    data = own.select("dim", F.pmod(F.xxhash64("id", "v"), "shards").cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v")
    queries = own.filter("q").dropDuplicates(["id"])
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    dealt = data.unionAll(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        here, shard = None, None
        for part in _runs(batches):
            key = part.column("dim")[0].as_py(), part.column("shard")[0].as_py()
            if key != here:
                here, shard, held = key, None, []
            ids = part.column("id").to_numpy()
            values = part.column("v")
            block = values.values.slice(values.offsets[0].as_py(), len(ids) * key[0]).to_numpy().reshape(len(ids), key[0])
            if part.column("kind")[0].as_py() == 0:
                held.append((ids, block))
                continue
            shard = shard or (Shard(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k) if held else None)
            for a in range(0, len(ids) if shard else 0, QUERY_BLOCK):
                for q, near, scores in shard.search(ids[a : a + QUERY_BLOCK], block[a : a + QUERY_BLOCK]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(near), ids[a + q])), pa.array(near), pa.array(scores)], names=["query_id", "vec_id", "score"]
                    )

    best = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the length, the shard or the kind changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "shard", "kind")])
        cuts = (np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
