"""Best-fit packing of texts into bins of fixed capacity, under conflicts.

Bins are kept ordered by what is left in them. Each carries a bitmap of the sources and one of the duplicate clusters
it holds. A piece, longest first, looks up the first bin that has room for it and goes on to the next larger rest until
it finds one with neither its source nor its cluster: the tightest compatible bin. Documents are dealt to groups of
bounded size by a hash of their id, so every source and every cluster is spread over all groups, and each group is
packed by itself. Rows that are alike in all of this are numbered first and dealt by their number, too.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CAPACITY = 2048
GROUP_ROWS = 2048
#: Repeats of a row that are numbered in one piece.
RUN_ROWS = 10_000


def words(text: Column) -> Column:
    """Number of words between ASCII white space; NULL has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece (length, source bit, cluster bit), in the given order."""
    rests: list[tuple[int, int]] = []  # (what is left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        at = bisect_left(rests, (length, -1))
        while at < len(rests) and (sources[rests[at][1]] & source or clusters[rests[at][1]] & cluster):
            at += 1
        if at < len(rests):
            rest, here = rests.pop(at)
        else:
            rest, here = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[here] |= source
        clusters[here] |= cluster
        out.append((here, capacity - rest))
        if rest > length:
            insort(rests, (rest - length, here))
    return out


def pack(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: Column | None = None,
    length: Column | None = None,
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_offset: where each piece of each document row lies.

    A document longer than ``capacity`` is cut into pieces of ``capacity`` and a rest; nothing is left out. Two pieces
    of one source, or of one duplicate cluster (by default: equal texts), never share a bin; NULL sources and NULL
    texts conflict with nothing. Documents without tokens are one piece of length 0 and offset 0, in a bin of their
    group that has room. Repeated rows are packed each. ``length`` is the number of words unless given. Bins are named
    group:number. The groups' number follows the number of rows, so the memory of a task does not.
    """
    n = F.coalesce(length if length is not None else words(documents[text]), F.lit(0)).cast("long")
    alike = cluster if cluster is not None else F.when(documents[text].isNotNull(), F.sha2(documents[text], 256))
    rows = documents.select(
        documents[doc_id].alias("doc_id"), n.alias("n"), documents[source].cast("string").alias("source"), alike.cast("string").alias("cluster")
    )
    groups = max(1, math.ceil(documents.count() / group_rows))
    alike_rows = rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count("*").alias("times"))
    runs = alike_rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN_ROWS))))
    first = F.col("run") * RUN_ROWS
    each = runs.withColumn("copy", F.explode(F.sequence(first, F.least(first + RUN_ROWS, F.col("times")) - 1)))
    dealt = each.select("doc_id", "n", "source", "cluster", F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(groups)).alias("group"))
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("piece", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("bin_id", T.StringType()),
            T.StructField("bin_offset", T.LongType()),
        ]
    )

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "n", "source", "cluster"))):
                if row[0] != here:
                    yield from _packed(here, held, capacity, out)
                    here, held = row[0], []
                held.append(row[1:])
        yield from _packed(here, held, capacity, out)

    out = to_arrow_schema(schema)
    return dealt.repartition("group").sortWithinPartitions("group", F.desc("n"), "doc_id", "cluster", "source").mapInArrow(fill, schema)


def _packed(group: int | None, rows: list[tuple], capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One group, its rows longest first. Whole bins come from long documents, rests are packed with the others."""
    if group is None:
        return
    bits: tuple[dict, dict] = ({}, {})
    full, parts = [], []
    for doc, n, source, cluster in rows:
        marks = [0 if v is None else 1 << seen.setdefault(v, len(seen)) for v, seen in zip((source, cluster), bits)]
        whole, rest = divmod(n, capacity)
        full += [(doc, p, capacity) for p in range(whole)]
        if rest or not whole:
            parts.append((doc, whole, rest, *marks))
    parts.sort(key=lambda p: -p[2])
    places = best_fit([p[2:] for p in parts], capacity)
    begun = max((b for b, _ in places), default=-1) + 1
    out = [(d, p, n, f"{group}:{begun + i}", 0) for i, (d, p, n) in enumerate(full)]
    out += [(p[0], p[1], p[2], f"{group}:{b}", o) for p, (b, o) in zip(parts, places)]
    columns = list(zip(*out))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types)], schema=schema)
