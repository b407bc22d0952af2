"""Centroid clustering of integer vectors: Lloyd's rounds with equal-average equal-variance nearest neighbour search.

The centroids are sorted by the sum of their components. A vector starts at its own sum and scans outwards on both
sides, the closer side first. For vectors of d components with sums S and deviations V (the norm of what is left when
the mean is taken off), (S - S')^2 / d + (V - V')^2 is at most the squared distance. The first part alone ends the scan,
for it only grows outwards; both together reject a centroid without looking at its components. What is left is
compared in whole numbers, ties to the smaller number. The bounds are rounded towards zero, so rounding rejects nothing.

A round is one pass over the written vectors. Each task adds up its vectors by centroid, Spark adds the tasks' sums, and
the driver sees one number for each centroid and component. Sums travel in digits of 32 bits, so nothing overflows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.session import materialise

#: Components up to this size have squared distances of 1024 components or fewer that fit 64 bits.
NARROW = 1 << 25
BLOCK_ROWS = 8192
#: By how much, relatively, bounds in floating point are taken down.
MARGIN = 1e-9
LARGEST = (1 << 63) - 1


class Centroids:
    """Centroids of one dimension, sorted by their sums for the outward scan."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.dim = len(rows[0])
        self.narrow = self.dim <= 1024 and all(abs(x) <= NARROW for row in rows for x in row)
        #: Exact comparisons made, for tests.
        self.compared = 0
        if self.narrow:
            table = np.array(rows, np.int64)
            sums = table.sum(1)
            self.order = np.lexsort((np.arange(len(rows)), sums))
            self.table, self.sums = table[self.order], sums[self.order]
            self.spread = _deviation(self.table, self.sums)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of narrow vectors."""
        n, k = len(vectors), len(self.sums)
        sums = vectors.sum(1)
        spread = _deviation(vectors, sums)
        best, number = np.full(n, LARGEST), np.full(n, k)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        scan = np.arange(n)
        while len(scan):
            below = np.where(low >= 0, sums[scan] - self.sums[low], LARGEST)
            above = np.where(high < k, self.sums[np.minimum(high, k - 1)] - sums[scan], LARGEST)
            down = below <= above
            gap = np.minimum(below, above)
            by_mean = gap.astype(float) ** 2 / self.dim
            on = (gap < LARGEST) & (by_mean * (1 - MARGIN) <= best[scan])
            scan, low, high, down, by_mean = scan[on], low[on], high[on], down[on], by_mean[on]
            at = np.where(down, low, high)
            apart = np.abs(spread[scan] - self.spread[at]) - MARGIN * (spread[scan] + self.spread[at])
            bound = by_mean + np.maximum(apart, 0) ** 2
            close = np.flatnonzero(bound * (1 - MARGIN) <= best[scan])
            rows, here = scan[close], at[close]
            gaps = vectors[rows] - self.table[here]
            exact = np.einsum("ij,ij->i", gaps, gaps)
            self.compared += len(rows)
            names = self.order[here]
            better = (exact < best[rows]) | ((exact == best[rows]) & (names < number[rows]))
            best[rows[better]], number[rows[better]] = exact[better], names[better]
            low, high = low - down, high + ~down
        return number, best

    def nearest_wide(self, vector: list[int]) -> tuple[int, int]:
        """The same for a vector or centroids of any size, in unbounded integers."""
        distance, number = min((sum((a - b) ** 2 for a, b in zip(vector, row)), i) for i, row in enumerate(self.rows))
        return number, distance


def _deviation(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    rest = vectors - (sums / vectors.shape[1])[:, None]
    return np.sqrt(np.einsum("ij,ij->i", rest, rest))


def whole(value: float, scale: int) -> int:
    """floor(scale * value), exactly, for values whose product a double cannot hold, too."""
    product = scale * value
    return math.floor(product) if abs(product) < 2.0**62 else math.floor(value) * scale


def _blocks(batches: Iterable[pa.RecordBatch], dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray | list[list[int]]]]:
    """Slices of batches with their vectors: an array if all are narrow, else lists of integers."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(a, BLOCK_ROWS)
            values = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            if np.abs(values).max() * scale < NARROW:
                yield part, np.floor(values * scale).astype(np.int64)
            else:
                yield part, [[whole(x, scale) for x in row] for row in values.tolist()]


def _assign(centroids: Centroids, vectors: np.ndarray | list[list[int]]) -> tuple[Iterable[int], Iterable[int]]:
    if centroids.narrow and isinstance(vectors, np.ndarray):
        return centroids.nearest(vectors)
    rows = vectors.tolist() if isinstance(vectors, np.ndarray) else vectors
    return tuple(zip(*map(centroids.nearest_wide, rows)))


def _digits(value: int) -> list[int]:
    """Base 2^32 digits of a number, lowest first, all of its sign."""
    sign, rest, out = (-1 if value < 0 else 1), abs(value), []
    while rest:
        rest, digit = divmod(rest, 1 << 32)
        out.append(sign * digit)
    return out


def _sums(kept: DataFrame, centroids: Centroids, scale: int) -> dict[tuple[int, int], int]:
    """Exact sums by (centroid, component) over its vectors; component -1 counts them."""
    dim = centroids.dim

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, vectors in _blocks(batches, dim, scale):
            numbers = np.asarray(_assign(centroids, vectors)[0])
            for c in np.unique(numbers).tolist():
                mine = np.flatnonzero(numbers == c)
                own = vectors[mine].sum(0).tolist() if isinstance(vectors, np.ndarray) else [sum(x) for x in zip(*(vectors[i] for i in mine))]
                total[c] = [a + b for a, b in zip(total.get(c, [0] * (dim + 1)), [*own, len(mine)])]
        out = [(c, -1 if j == dim else j, p, d) for c, row in total.items() for j, x in enumerate(row) for p, d in enumerate(_digits(x))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["c", "dim", "place", "digit"])

    partial = kept.select("v").mapInArrow(add, "c long, dim long, place long, digit long")
    sums: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("c", "dim", "place").agg(F.sum("digit").alias("digit")).collect():
        sums[r.c, r.dim] = sums.get((r.c, r.dim), 0) + (r.digit << 32 * r.place)
    return sums


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, all of them present and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, fine), F.lit(False))


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    dim: int = 64,
    k: int = 8,
    rounds: int = 10,
    scale: int = 1024,
    salt: str = "3:",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector under the last centroids, and those centroids.

    Components are floor(scale * x). The first centroids are the ``k`` vectors with the smallest SHA-256 of salt and id;
    of repeated ids the one with the smaller components comes first, NULL ids come last. In each round every vector
    goes to its nearest centroid, and a centroid that has vectors becomes the floor of their mean; one without stays.
    Rounds that would change nothing any more are not run. Vectors that are NULL, of another length, or hold a NULL or
    a value that is not finite take no part; vectors of zeros and repeated rows do, each. With fewer than ``k`` vectors
    there are as many centroids; without any the result is empty. A distance too large for a long is NULL.
    Columns other than id and vector are not read. The usable vectors are written once and read in every round.
    """
    if min(dim, k, rounds + 1, scale) < 1:
        raise ValueError("dim, k and scale are 1 at least, rounds 0")
    own = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("v")).filter(usable(F.col("v"), dim))
    kept = materialise(own, "vectors")
    first = kept.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)), "v").limit(k)
    rows = [[whole(float(x), scale) for x in r.v] for r in first.collect()]
    schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema), rows
    for _ in range(rounds):
        sums = _sums(kept, Centroids(rows), scale)
        moved = [[sums.get((c, j), 0) // sums[c, -1] for j in range(dim)] if (c, -1) in sums else row for c, row in enumerate(rows)]
        if moved == rows:
            break
        rows = moved
    last, out = Centroids(rows), to_arrow_schema(schema)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, dim, scale):
            numbers, distances = _assign(last, block)
            fits = [d if d <= LARGEST else None for d in map(int, distances)]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(numbers, pa.int32()), pa.array(fits, pa.int64())], schema=out)

    return kept.mapInArrow(place, schema), rows


def cluster_digest(placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector.

    Sums that do not fit a long, or hold a distance that does not, are NULL. The placed vectors are written first.
    """
    placed = materialise(placed, "placed")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = placed.groupBy("cluster").agg(total, (F.count("*") == F.count("distance")).alias("known")).collect()
    inertia = {r.cluster: int(r.total) if r.known else None for r in sums}
    whole_sum = None if None in inertia.values() else sum(inertia.values())
    fits = lambda x: F.lit(x if x is not None and x <= LARGEST else None).cast("long")
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids]
    pick = lambda cells: F.get(F.array(*cells), F.col("cluster")) if cells else F.lit(None)
    return placed.select(
        "vec_id",
        "cluster",
        "distance",
        pick([fits(inertia.get(c)) for c in range(len(names))]).cast("long").alias("cluster_inertia"),
        fits(whole_sum).alias("inertia"),
        pick([F.lit(n) for n in names]).cast("string").alias("centroid_sha256"),
    )


def clusters_sql(dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> str:
    """The same result in DuckDB, every centroid compared."""
    near = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS c, v FROM kept
    ORDER BY sha256('{salt}' || vec_id) LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, c, d, v FROM (SELECT a.r, a.vec_id, a.v, b.c, {near} AS d,
      row_number() OVER (PARTITION BY a.r ORDER BY {near}, b.c) AS pos FROM kept a CROSS JOIN c{i} b) WHERE pos = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT c, j, sum(x) AS s, count(*) AS n
      FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
    c{i + 1} AS MATERIALIZED (SELECT p.c, coalesce(CAST(m.v AS BIGINT[]), p.v) AS v FROM c{i} p LEFT JOIN m{i} m ON m.c = p.c)"""
            )
    return f"""WITH {", ".join(steps)} SELECT a.vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(b.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} b ON a.c = b.c"""
