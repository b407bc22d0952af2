"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Documents are partitioned by size, in powers of two. A partition's signature cuts the hash space into eight buckets
per shingle of its largest document and keeps the smallest hash of each bucket; an item has one signature per
partition. An item and a document that share a bucket's smallest hash are a candidate. Because buckets grow with
the document, the chance that a shared shingle is not its bucket's smallest stays below 6 % for any length, so an
item goes unseen only if all its shared shingles are hidden; where an item has so few that this is likelier than
``miss``, the search is repeated under other hash orders. Every candidate is verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.llm.text import plain_words, raw_texts, shingle_hashes, slices

#: Bytes of items that go to the tasks at once; more items take further passes over the documents.
BLOCK_BYTES = 6_000_000
_BUCKETS_PER_SHINGLE = 8
#: Chance that one shared shingle is not the smallest of its bucket, at that many buckets.
_HIDDEN = 0.06
WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shingles(words: list[bytes], width: int) -> set[bytes]:
    """Distinct runs of ``width`` words; the whole sequence, if it is shorter; none without words."""
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def size_class(n: int) -> int:
    """log2 of the buckets for documents of ``n`` shingles."""
    return max(6, math.ceil(math.log2(_BUCKETS_PER_SHINGLE * max(n, 1))))


def bucket_minima(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The smallest hash of each bucket that has one; the upper bits name the bucket."""
    h = np.sort(hashes)
    bucket = h >> np.uint64(64 - bits)
    return h[np.concatenate(([True], bucket[1:] != bucket[:-1]))] if len(h) else h


class ItemIndex:
    """Signatures of a bounded block of items, by size partition."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, threshold: float, miss: float):
        self.width, self.threshold = width, threshold
        words = [(i, plain_words(raw)) for i, raw in items]
        self.items = [(i, shingles(w, width), np.unique(shingle_hashes(w, width))) for i, w in words if w]
        need = min((math.ceil(threshold * len(s) - 1e-9) for _, s, _ in self.items), default=1)
        repeats = max(1, math.ceil(math.log(miss) / (max(1, need) * math.log(_HIDDEN))))
        rng = np.random.default_rng(11)
        self.orders = [np.uint64(1), *(rng.integers(1, 1 << 63, repeats - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]
        self.by_class: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def signatures(self, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each hash order: the items' bucket minima, sorted, and the items they belong to."""
        if bits not in self.by_class:
            out = []
            for order in self.orders:
                minima = [bucket_minima(h * order, bits) for _, _, h in self.items]
                values = np.concatenate([np.empty(0, np.uint64), *minima])
                owner = np.repeat(np.arange(len(minima)), [len(m) for m in minima])
                by = np.argsort(values, kind="stable")
                out.append((values[by], owner[by]))
            self.by_class[bits] = out
        return self.by_class[bits]

    def search(self, raw: bytes) -> list[tuple[int, int, int, float]]:
        """(item, its shingles, shared ones, containment) for each item contained in the text."""
        words = plain_words(raw)
        hashes = shingle_hashes(words, self.width)
        bits = size_class(len(hashes))
        candidates: set[int] = set()
        for order, (values, owner) in zip(self.orders, self.signatures(bits)):
            minima = bucket_minima(hashes * order, bits)
            low, high = np.searchsorted(values, minima, "left"), np.searchsorted(values, minima, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist()):
                candidates.update(owner[a:b].tolist())
        if not candidates:
            return []
        have = shingles(words, self.width)
        found = []
        for c in sorted(candidates):
            item, own, _ = self.items[c]
            shared = len(own & have)
            if shared >= self.threshold * len(own) - 1e-9:
                found.append((item, len(own), shared, shared / len(own)))
        return found


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    miss: float = 1e-6,
) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: one row for each document row and item row it contains.

    Containment is the share of an item's distinct shingles (``width`` words of letters, digits and non-ASCII
    characters, A-Z lowered) that the document has. A shorter text is one shingle, its whole word sequence; texts
    that are NULL or have no words contain and are contained in nothing. Repeated documents and repeated items give
    a row each; ids may be NULL. Only the named columns are read. Documents stay where they are: items go to the
    tasks in blocks of about ``BLOCK_BYTES`` bytes, whatever stands between their words.
    """
    spark = documents.sparkSession
    docs = documents.select(documents[doc_id].alias("doc_id"), documents[text].alias("text"))
    own = items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[doc_id].dataType),
            T.StructField("item_id", items.schema[item_id].dataType),
            T.StructField("n_item", T.LongType()),
            T.StructField("n_shared", T.LongType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
    parts = [docs.mapInArrow(_searcher(rows, width, threshold, miss, schema), schema) for rows in _blocks(own)]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about ``BLOCK_BYTES`` bytes, each small enough to go to every task."""
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for block in range(blocks):
        yield [(r[0], (r[1] or "").encode()) for r in items.filter(key == block).collect()]


def _searcher(rows: list[tuple[int, bytes]], width: int, threshold: float, miss: float, schema: T.StructType):
    out = to_arrow_schema(schema)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(rows, width, threshold, miss)
        for part in slices(batches, "text"):
            at, found = [], []
            for i, raw in enumerate(raw_texts(part, "text")):
                hits = index.search(raw)
                at.extend([i] * len(hits))
                found.extend(hits)
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, out.types[1:]))],
                    names=out.names,
                )

    return search


def without_leaks(
    documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8, miss: float = 1e-6
) -> DataFrame:
    """Documents that contain no item, with all their columns, by the same search; rows stay in their partitions."""
    for rows in _blocks(items.select(items[item_id].alias("item_id"), items[item_text].alias("text"))):

        def keep(batches: Iterable[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(rows, width, threshold, miss)
            for part in slices(batches, text):
                yield part.filter(pa.array([not index.search(raw) for raw in raw_texts(part, text)], pa.bool_()))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents


def leaks_sql(width: int = 5, threshold: float = 0.8) -> str:
    """The same rows in SQL."""
    words = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}')"
    runs = (
        f"list_distinct(list_transform(range(1, greatest(len(w) - {width} + 2, 2)), "
        f"lambda i: array_to_string(w[i : i + {width} - 1], ' ')))"
    )
    return f"""
        WITH d AS (SELECT rid, doc_id, unnest({runs}) AS s
                   FROM (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents) WHERE len(w) > 0),
        i AS (SELECT iid, item_id, n_item, unnest(s) AS s FROM (
                  SELECT iid, item_id, {runs} AS s, len({runs}) AS n_item
                  FROM (SELECT row_number() OVER () AS iid, item_id, {words} AS w FROM benchmark) WHERE len(w) > 0))
        SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
        FROM d JOIN i USING (s) GROUP BY rid, doc_id, iid, item_id, n_item
        HAVING count(*) >= {threshold} * n_item - 1e-9"""
