"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits that differ in at most three bits differ in at most one bit in one half of 32. Each half is
covered by the anchors of a perfect code of radius one: the Hamming code of 31 bits, times the free last bit. Every
half lies within one bit of its anchor (the covering radius), and a half that differs from it in one bit (the
threshold) lies within two bits of the same anchor. So each distinct fingerprint is sent to all anchors within two
bits of each of its halves, about 17 for each half, and any two linked fingerprints meet at an anchor. There are
2^27 anchors for each half, so an anchor's group stays small; within a group only links that join two so far separate
parts are put out, never all pairs. Documents with one fingerprint are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.components import components
from flowsieve.llm.text import raw_texts, slices, space_words
from flowsieve.session import materialise

SEED = 42
MAX_BITS = 3
#: Parity of each bit of the place number over 31 places: the syndrome of a word names the bit to flip.
_PLACES = np.arange(1, 32, dtype=np.uint32)


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """A bit is set where more than half of the hashes of the word shingles, repeats included, have it set."""
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 50_000):
        part = hashes[at : at + 50_000]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long): one row per document row; NULL and empty texts have fingerprint 0."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = np.array([fingerprint(space_words(raw)) for raw in raw_texts(part, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("fp", T.LongType())])
    return documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text")).mapInArrow(sketch, schema)


def home_anchor(halves: np.ndarray) -> np.ndarray:
    """The anchor within one bit of each 32-bit value: its low 31 bits corrected to a code word, bit 31 as it is."""
    syndrome = np.zeros(len(halves), np.uint32)
    for place in _PLACES:
        syndrome ^= ((halves >> (place - np.uint32(1))) & np.uint32(1)) * place
    flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1).astype(np.uint32) - np.uint32(1)), np.uint32(0))
    return halves ^ flip


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within two bits of each 32-bit value."""
    rows, found = [], []
    at = np.arange(len(halves))
    for flips in [0, *(1 << p for p in range(32))]:
        moved = halves ^ np.uint32(flips)
        home = home_anchor(moved)
        ok = np.bitwise_count(home ^ halves) <= 2
        rows.append(at[ok])
        found.append(home[ok])
    both = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(32)) | np.concatenate(found).astype(np.uint64))
    return (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)


def group_links(fps: np.ndarray, limit: int = MAX_BITS) -> Iterator[tuple[int, int]]:
    """Links that span the parts of a group of distinct fingerprints: fewer than its size.

    A part is grown from one fingerprint by the linked ones not yet reached, which then leave the rest; so in a
    dense group each step leaves little to compare, and no table of all pairs is made.
    """
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= limit
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                queue.extend(reached)
                yield from ((int(here), int(r)) for r in reached)


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A forest with the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    kept = []
    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for half in (0, 1):
            rows, anchor = anchors((fp >> np.uint64(32 * half)).astype(np.uint32))
            key = (anchor | np.uint64(half << 32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows].view(np.int64))], names=["anchor", "fp"])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each anchor's group; rows come sorted by anchor. A task's links go out as a forest, bit by bit."""

    def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        e = np.array(spanning(edges), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    edges: list[tuple[int, int]] = []
    kept = (np.empty(0, np.int64), np.empty(0, np.uint64))
    for batch in batches:
        key = np.concatenate((kept[0], batch.column("anchor").to_numpy()))
        fp = np.concatenate((kept[1], batch.column("fp").to_numpy().view(np.uint64)))
        cuts = np.flatnonzero(np.diff(key)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        starts = np.concatenate(([0], cuts[:-1])) if len(cuts) else np.empty(0, np.int64)
        for a, b in zip(starts[np.diff(np.append(starts, last)) > 1].tolist(), cuts[np.diff(np.append(starts, last)) > 1].tolist()):
            edges.extend(group_links(fp[a:b]))
        kept = (key[last:], fp[last:])
        if len(edges) > 200_000:
            yield out(edges)
            edges = []
    edges.extend(group_links(kept[1]))
    yield out(edges)


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """a, b: links between different fingerprints that connect all that lie within three bits, directly or by others."""
    meet = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    grouped = meet.repartition("anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(_compare, "a long, b long")


def fingerprint_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row per document row, with the smallest id reachable by links of fingerprints.

    NULL, empty and white-space texts have fingerprint 0 and are linked like any other. Repeated rows stay. A NULL id
    is never the smallest; a group of nothing but NULL ids has component NULL. Only the two named columns are read.
    """
    sketched = materialise(fingerprints(documents, doc_id, text), "fingerprints")
    distinct = sketched.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(linked_fingerprints(distinct))
    joined = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    joined = materialise(joined, "fingerprint-groups")
    least = materialise(joined.groupBy("root").agg(F.min("first").alias("component_id")), "fingerprint-roots")
    classes = joined.join(least, "root").select("fp", "component_id")
    return sketched.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """Documents with one row kept of each group of linked fingerprints; all columns.

    The row with the smallest id stays; NULL ids come last, and rows of one id are told apart by a hash of 128 bits of
    all their columns. So rows of one id with different texts are documents of their own, and rows without an id are
    dealt with like any others.
    """
    names = [F.col(f"`{c}`") for c in documents.columns]
    cells = [x for c in names for x in (c, c.isNull())]
    row = F.struct(*[F.xxhash64(F.lit(seed), *cells).alias(f"h{seed}") for seed in (1, 2)])
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row.alias("row"))
    groups = fingerprint_groups(documents.select(place.alias("doc_id"), "text"))
    kept = groups.select(F.col("component_id.row.h1").alias("h1__"), F.col("component_id.row.h2").alias("h2__")).distinct()
    hashed = documents.select(row["h1"].alias("h1__"), row["h2"].alias("h2__"), F.struct(*names).alias("row__"))
    one = hashed.join(kept, ["h1__", "h2__"], "left_semi").groupBy("h1__", "h2__").agg(F.any_value("row__").alias("row__"))
    return one.select(*[F.col("row__")[c].alias(c) for c in documents.columns])
