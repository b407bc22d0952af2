"""Clusters of near copies: word-shingle sets at a Jaccard similarity, and the components of their links.

Texts with one set of shingles are one node. Sets meet in a band if four minima of seeded hashes agree; with 26 bands a
pair at 0.8 is missed by a chance of about 1e-6, one of more likeness by less. Most sets meet no other: only the bands
that two share are followed, and only the sets that meet another one are cut from their texts again, once for each set.

Those sets get 512 more minima of which one bit each is kept. A task goes through a band's sets and grows parts from
one set by those that differ in few enough bits (at 0.8 one in ten differs, more than 86 by a chance below 1e-6), so a
band gives a forest of possible links, never its pairs. The sets connected by possible links are compared in one place:
each with the others whose bits are near, until it is linked to their part by the shingles themselves. Again a forest comes
out, so no set is sent more than once for a group that fits a task. Larger groups are cut into blocks by hash, and each pair of
blocks is a task, so memory is bounded, no link is lost, and only there a set is sent more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsieve.llm.components import components
from flowsieve.llm.simhash import spanning
from flowsieve.llm.text import mixed, raw_texts, shingle_hashes, slices, space_words
from flowsieve.session import materialise

WIDTH = 5
#: Jaccard similarity from which sets are near copies, as a fraction.
LEAST, OF = 4, 5
BANDS, ROWS = 26, 4
#: Minima of which a bit is kept, and the bits in which a pair may differ.
SKETCH, MOST_BITS = 512, 86
#: Sets of a band, and bytes of sets of a group, that one block holds.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 32 << 20
#: What is asked for is told from most of the rest by a table of so many bits.
FILTER_BITS = 1 << 25
#: Texts that a task remembers.
SEEN = 1_000_000
_rng = np.random.default_rng(11)
_FLIPS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_FACTORS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_ORDER = np.arange(BANDS * ROWS, dtype=np.uint64)
_MORE_FLIPS = _rng.integers(0, 1 << 32, (SKETCH, 1), np.uint32)
_MORE_FACTORS = _rng.integers(0, 1 << 32, (SKETCH, 1), np.uint32) | np.uint32(1)
_MORE_ORDER = np.arange(SKETCH, dtype=np.uint64)
_PIECE = 512


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer than five words are one shingle."""
    return np.unique(shingle_hashes(words, WIDTH))


def set_key(own: np.ndarray, raw: bytes) -> int:
    """A name of a set as a signed long; a text without words is named by its bytes."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes() if len(own) else raw)).view(np.int64))


def _minima(own: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of a set under each seeded hash."""
    least = np.full(len(flips), np.iinfo(np.uint32).max, np.uint32)
    high = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), _PIECE):
        hashed = high[None, at : at + _PIECE] ^ flips
        hashed *= factors
        np.minimum(least, hashed.min(1), out=least)
    return least


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set that is not empty: one value for each band, as signed longs."""
    least = np.stack([_minima(own, _FLIPS, _FACTORS) for own in sets]) if sets else np.empty((0, BANDS * ROWS), np.uint32)
    least = mixed(least.astype(np.uint64) + (_ORDER << np.uint64(32))).reshape(-1, BANDS, ROWS)
    value = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), least.shape[:2])
    for row in range(ROWS):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + least[:, :, row])
    return value.view(np.int64)


def sketch_bits(own: np.ndarray) -> bytes:
    """A bit for each of further minima of a set."""
    least = mixed(_minima(own, _MORE_FLIPS, _MORE_FACTORS).astype(np.uint64) + (_MORE_ORDER << np.uint64(32)))
    return np.packbits((least >> np.uint64(63)).astype(np.uint8)).tobytes()


def sketches(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, n (words), key, size (of the set), bands, hash (of the text): one row per document row; NULL texts have no key."""

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, keys, sets = [], [], []
            for raw, known in zip(raw_texts(part, "text"), part.column("text").is_valid().to_pylist()):
                words = space_words(raw)
                sets.append(shingle_set(words))
                n.append(len(words))
                keys.append(set_key(sets[-1], raw) if known else None)
            sizes = np.array([len(own) for own in sets], np.int64)
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands([own for own in sets if len(own)]).ravel()))
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes), found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), *made, part.column("hash")],
                names=["doc_id", "source", "n", "key", "size", "bands", "hash"],
            )

    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("source", T.StringType())])
    schema = schema.add("n", T.LongType()).add("key", T.LongType()).add("size", T.LongType()).add("bands", T.ArrayType(T.LongType()))
    rows = documents.select(
        documents[doc_id].alias("doc_id"), documents[text].alias("text"), documents[source].cast("string").alias("source"), F.xxhash64(documents[text]).alias("hash")
    )
    return rows.mapInArrow(sketch, schema.add("hash", T.LongType()))


class Asked:
    """Tells the hashes that are asked for from most others, by a table of bits of a fixed size, whatever is asked."""

    def __init__(self, asked: DataFrame, column: str):
        place = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))
        words = asked.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        table = np.zeros(FILTER_BITS // 64, np.int64)
        table[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.table = asked.sparkSession.sparkContext.broadcast(table)

    def drop(self) -> None:
        """Frees the table on all executors; what was read by it must be written."""
        self.table.destroy()

    def among(self, values: np.ndarray) -> np.ndarray:
        at = values & (FILTER_BITS - 1)
        return (self.table.value[at >> 6] >> (at & 63)) & 1 == 1


def _met(nodes: DataFrame, asked: Asked | None = None) -> DataFrame:
    """key, band: the bands of the sets, those that are asked for and a few others."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                band = batch.column("bands").flatten().to_numpy()
                key = np.repeat(batch.column("key").to_numpy(), BANDS)
                on = asked.among(band)
                yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(band[on])], names=["key", "band"])

    if asked is None:
        return nodes.select("key", F.explode("bands").alias("band"))
    return nodes.select("key", "bands").mapInArrow(explode, "key long, band long")


def _asked_sets(documents: DataFrame, text: str, wanted: Asked, schema: str, columns: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``columns`` of the sets of the texts with words whose ``hash`` is asked for, and of a few others.

    A text comes at most once from a stretch of rows that a task reads, so thousands of copies are a row for each task.
    """

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text"):
            part = part.filter(pa.array(wanted.among(part.column("hash").to_numpy())))
            out = []
            for raw, name in zip(raw_texts(part, "text"), part.column("hash").to_pylist()):
                if name not in seen:
                    seen.add(name)
                    own = shingle_set(space_words(raw))
                    if len(own):
                        out.append((set_key(own, b""), *columns(own)))
            if len(seen) > SEEN:
                seen = set()
            fields = to_arrow_schema(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(fields), fields)], schema=fields)

    rows = documents.select(documents[text].alias("text"), F.xxhash64(documents[text]).alias("hash"))
    kinds = T.StructType.fromDDL(schema)
    return rows.mapInArrow(collect, kinds)


def _packed(own: np.ndarray) -> bytes:
    """A sorted set as the upper 40 bits of its hashes: two of a pair's shingles agree by chance in a pair of a million."""
    return own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    cells = np.zeros((len(raw) // 5, 8), np.uint8)
    cells[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return cells.view("<u8").ravel()


def _in_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Rows for each pair of the blocks that their group is cut into; a group of one block has one."""
    own = F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks__"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks__") - 1), lambda b: (F.col("blocks__") == 1) | (b != F.col("own__")))
    out = rows.withColumn("blocks__", blocks.cast("long")).withColumn("own__", own).withColumn("other__", F.explode(other))
    task = [F.least("own__", "other__").alias("low__"), F.greatest("own__", "other__").alias("high__")]
    out = out.select(*rows.columns, *task)
    return out.repartition(group, "low__", "high__").sortWithinPartitions(group, "low__", "high__", "key")


def _grouped(batches: Iterable[pa.RecordBatch], group: str) -> Iterator[list[pa.RecordBatch]]:
    """The batches of each task of ``_in_blocks``."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (group, "low__", "high__")])
        cuts = (np.flatnonzero((np.diff(names, axis=1) != 0).any(0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            here = names[:, a].tolist()
            if here != before and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            before = here
    if held:
        yield held


def _columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sizes, bits as rows of longs) of a group."""
    keys, sizes = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("key", "size"))
    bits = np.frombuffer(b"".join(x for p in parts for x in p.column("bits").to_pylist()), np.uint64).reshape(len(keys), -1)
    return keys, sizes, bits


def _near(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sets may be near copies of one, by their sizes and bits."""
    lengths = (OF * size >= LEAST * sizes) & (OF * sizes >= LEAST * size)
    return lengths & (np.bitwise_count(others ^ bits).sum(1) <= MOST_BITS)


def possible_links(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """A forest over the sets that may be near copies: parts are grown from one set by the near ones not yet reached."""
    rest = np.arange(len(keys))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = _near(sizes[here], bits[here], sizes[rest], bits[rest])
            if near.any():
                reached = rest[near].tolist()
                rest = rest[~near]
                queue.extend(reached)
                yield from ((int(keys[here]), int(keys[r])) for r in reached)


def exact_links(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A forest over the sets that are near copies: a set is compared with near ones of other parts until it joins them."""
    part = np.arange(len(keys))
    for here in range(1, len(keys)):
        left = np.flatnonzero(_near(sizes[here], bits[here], sizes[:here], bits[:here]))
        while len(left):
            left = left[part[left] != part[here]]
            for at, other in enumerate(left.tolist()):
                shared = _shared(sets[here], sets[other])
                if OF * shared >= LEAST * (sizes[here] + sizes[other] - shared):
                    part[part == part[other]] = part[here]
                    yield int(keys[here]), int(keys[other])
                    left = left[at + 1 :]
                    break
            else:
                break


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(links: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    kept = spanning(list(links))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], schema=_LINKS)


def _possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for parts in _grouped(batches, "band"):
        held += possible_links(*_columns(parts))
        if len(held) > 100_000:
            yield _forest(held)
            held = []
    yield _forest(held)


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _grouped(batches, "root"):
        sets = [_unpacked(x) for p in parts for x in p.column("own").to_pylist()]
        yield _forest(exact_links(*_columns(parts), sets))


def near_copy_clusters(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, n, cluster: one row per document row, with the number of words and the cluster of near copies.

    Texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least 0.8; clusters
    are connected by them. A text that stands alone has a cluster of its own. NULL texts have none; texts without
    words are alike only if equal. Ids may be NULL or repeated, repeated rows stay, an empty table gives an empty one;
    columns other than the three named are not read. A text is held whole, with its set, in one task.
    """
    rows = materialise(sketches(documents, doc_id, text, source), "near-sketches")
    nodes = rows.filter("size > 0").groupBy("key").agg(F.min_by(F.struct("bands", "hash"), "hash").alias("r")).select("key", "r.*")
    nodes = materialise(nodes, "near-nodes")
    common = materialise(_met(nodes).groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "near-bands")
    asked = Asked(common, "band")
    shared = materialise(_met(nodes, asked).join(common, "band"), "near-shared")
    asked.drop()
    asked = Asked(nodes.join(shared.select("key").distinct(), "key", "left_semi"), "hash")
    sketched = _asked_sets(documents, text, asked, "key long, size long, bits binary", lambda own: (len(own), sketch_bits(own)))
    sketched = materialise(sketched.dropDuplicates(["key"]), "near-bits")
    asked.drop()

    tasks = _in_blocks(shared.join(sketched, "key"), "band", F.ceil(F.col("n") / BLOCK_ROWS))
    possible = materialise(tasks.select("band", "low__", "high__", "key", "size", "bits").mapInArrow(_possible, "a long, b long").distinct(), "near-possible")
    groups = components(possible).withColumnsRenamed({"node": "key"}).join(sketched, "key")
    sums = groups.groupBy("root").agg(F.sum("size").alias("shingles"))
    groups = materialise(groups.join(sums, "root"), "near-groups")
    asked = Asked(nodes.join(groups, "key", "left_semi"), "hash")
    sets = _asked_sets(documents, text, asked, "key long, own binary", lambda own: (_packed(own),)).dropDuplicates(["key"])
    tasks = _in_blocks(sets.join(groups, "key"), "root", F.ceil(F.col("shingles") * 8 / BLOCK_BYTES))
    links = materialise(tasks.select("root", "low__", "high__", "key", "size", "bits", "own").mapInArrow(_exact, "a long, b long"), "near-links")
    asked.drop()
    alike = components(links)
    return rows.join(alike, rows["key"] == alike["node"], "left").select("doc_id", "source", "n", F.coalesce("root", "key").alias("cluster"))
