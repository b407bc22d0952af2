"""Shards of near equal bytes by a k-d tree over the metadata of the rows.

A node of the tree is split along the dimension in which its rows lie farthest apart, at the weighted median of their
bytes (at the fitting quantile, if its bytes make an odd number of shards), until every leaf is down to the target.

Each dimension gives a row a place in 24 bits: numbers by their position between the least and the largest one, texts
by a hash, so that rows of one source stay next to each other. Rows at one place are ordered by a hash of their other
columns and then by their number, so a place that holds a third of all rows is cut like any other. The median is found
without sorting: bytes are added up by the next 12 bits of the order, for all nodes of a level in one pass, and only the
bucket that holds the median is looked at under 12 more bits, until it is a single row. A pass shuffles 4,096 sums for a
node at most, and the driver learns one bucket of each node. All of it is SQL expressions over a table without texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.session import materialise

DIGIT = 12
PLACE_BITS, HASH_BITS, NUMBER_BITS = 2 * DIGIT, 5 * DIGIT, 5 * DIGIT
KEY_BITS = PLACE_BITS + HASH_BITS + NUMBER_BITS
#: monotonically_increasing_id counts the rows of a partition in this many bits.
PARTITION_SHIFT = 33


@dataclass
class Node:
    """Rows of ``leaves`` future shards; once split, the dimension, the key of the first row to the right, the halves."""

    leaves: int
    first: int
    dim: int = 0
    cut: int = 0
    children: list[Node] = field(default_factory=list)


@dataclass
class KdTree:
    """The nodes of each level, the places of a dimension, and the range of each numeric one."""

    names: list[str]
    ranges: dict[str, tuple[float, float] | None]
    levels: list[list[Node]]

    def places(self) -> list[Column]:
        """A row's place in each dimension, 0 to 2^24 - 1; NULL, NaN and infinite values are at 0."""
        out = []
        for name in self.names:
            if name not in self.ranges:
                at = F.shiftrightunsigned(F.crc32(F.col(name).cast("string").cast("binary")), 32 - PLACE_BITS)
            elif self.ranges[name] is None:
                at = F.lit(None)
            else:
                low, high = self.ranges[name]
                share = (F.col(name).cast("double") - low) / (high - low) if high > low else F.lit(0.0)
                at = F.floor(share * ((1 << PLACE_BITS) - 1))
                at = F.when(_finite(F.col(name)), F.least(F.greatest(at, F.lit(0)), F.lit((1 << PLACE_BITS) - 1)))
            out.append(F.coalesce(at.cast("long"), F.lit(0).cast("long")))
        return out

    def descend(self, rows: DataFrame, level: int) -> DataFrame:
        """``node__``, the number of a row's node in a level, replaced by that in the next level."""
        nodes = self.levels[level]
        keys = [(n.cut >> KEY_BITS - PLACE_BITS, n.cut >> NUMBER_BITS & (1 << HASH_BITS) - 1, n.cut & (1 << NUMBER_BITS) - 1) for n in nodes]
        at_place, at_hash, at_number = (_pick(list(k), "long") for k in zip(*keys))
        place = F.get("places__", _pick([n.dim for n in nodes], "int"))
        after = (F.col("hash__") > at_hash) | ((F.col("hash__") == at_hash) & (F.col("number__") >= at_number))
        right = (place > at_place) | ((place == at_place) & after)
        firsts = list(accumulate((max(1, len(n.children)) for n in nodes), initial=0))[:-1]
        split = _pick([len(n.children) == 2 for n in nodes], "boolean")
        return rows.withColumn("node__", _pick(firsts, "int") + F.when(split & right, 1).otherwise(0))


def _finite(x: Column) -> Column:
    return F.abs(x.cast("double")) < float("inf")


def _pick(values: list, kind: str) -> Column:
    """The value of a row's node."""
    return F.get(F.lit(values).cast(f"array<{kind}>"), F.col("node__"))


def _digits() -> list[Column]:
    """The order of the rows of a node along its dimension, 12 bits each, highest first."""
    of = lambda c, bits: [F.shiftrightunsigned(c, s).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long")) for s in range(bits - DIGIT, -1, -DIGIT)]
    return of(F.col("place__"), PLACE_BITS) + of(F.col("hash__"), HASH_BITS) + of(F.col("number__"), NUMBER_BITS)


def _cut(rows: DataFrame, nodes: list[Node], size: str, asked: dict[int, int]) -> None:
    """Sets the cut of the nodes in ``asked``: as near as can be to so many bytes on its left.

    ``rows`` have their node and its dimension's place.
    """
    digits = _digits()
    prefix = {i: 0 for i in asked}
    rest = dict(asked)
    for depth, digit in enumerate(digits):
        if not rest:
            break
        known = [_pick([prefix[i] >> DIGIT * (depth - 1 - d) & ((1 << DIGIT) - 1) if i in rest else None for i in range(len(nodes))], "long") for d in range(depth)]
        held = _pick([i in rest for i in range(len(nodes))], "boolean")
        for d, value in enumerate(known):
            held = held & (digits[d] == value)
        sums = rows.filter(held).groupBy("node__", digit.alias("digit")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("bytes").over(W.partitionBy("node__").orderBy("digit"))
        reached = sums.withColumn("upto", upto).filter(F.col("upto") >= _pick([rest.get(i) for i in range(len(nodes))], "long"))
        first = reached.groupBy("node__").agg(F.min_by(F.struct("digit", "bytes", "upto", "n"), "digit").alias("b")).select("node__", "b.*")
        final = depth == len(digits) - 1
        for r in first.collect():
            i, before = r["node__"], r.upto - r.bytes
            prefix[i] = prefix[i] << DIGIT | r.digit
            rest[i] -= before
            if r.n == 1 or final:
                # One row is left: it goes to the side that comes nearer to what was asked.
                inclusive = abs(r.bytes - rest[i]) <= abs(rest[i])
                nodes[i].cut = (prefix[i] + inclusive) << KEY_BITS - DIGIT * (depth + 1)
                del rest[i]


def kd_shards(
    rows: DataFrame, size: str, dims: list[str], tie: list[str], shards: int | None = None, target_bytes: int | None = None
) -> tuple[DataFrame, KdTree]:
    """The rows with ``shard`` int and ``slot`` long (gapless from 0 in each shard), and the tree.

    Give either the number of shards or the bytes that a shard should have. ``dims`` are numeric or text columns;
    ``tie`` are the columns that order rows at one place. Shards differ by few rows: each cut is next to the row that
    holds the asked number of bytes. One row larger than a shard's share is a shard that large. NULL sizes count as
    none; if no row has bytes, rows are counted instead. Rows that are alike in all columns are dealt one by one. Slots follow
    the order in which Spark reads the rows. Columns named ``shard`` or ``slot`` are replaced; an empty table gives none.
    The rows are written once for each level, so leave out columns, such as texts, that need not come along.
    """
    if (shards is None) == (target_bytes is None) or (shards or target_bytes or 0) < 1 or not dims:
        raise ValueError("give the number of shards or their bytes, 1 at least, and a dimension")
    weight = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    own = materialise(rows.withColumn("number__", F.monotonically_increasing_id()), "shard-rows")
    numeric = [d for d in dims if isinstance(own.schema[d].dataType, T.NumericType)]
    bounds = [f(F.when(_finite(F.col(d)), F.col(d).cast("double"))) for d in numeric for f in (F.min, F.max)]
    found = own.agg(F.sum(weight), *bounds).head()
    total = found[0] or 0
    if not total:
        weight = F.lit(1).cast("long")
    leaves = shards or max(1, -(-total // target_bytes))
    ranges = {d: (found[1 + 2 * i], found[2 + 2 * i]) if found[1 + 2 * i] is not None else None for i, d in enumerate(numeric)}
    tree = KdTree(list(dims), ranges, [[Node(leaves, 0)]])
    placed = own.select(
        *[F.col(f"`{c}`") for c in kept],
        weight.alias("weight__"),
        F.array(*tree.places()).alias("places__"),
        F.shiftrightunsigned(F.xxhash64(*tie), 64 - HASH_BITS).alias("hash__"),
        "number__",
        F.lit(0).alias("node__"),
    )
    while any(n.leaves > 1 for n in tree.levels[-1]):
        nodes = tree.levels[-1]
        here = placed.filter(_pick([n.leaves > 1 for n in nodes], "boolean"))
        width = [F.max(F.col("places__")[d]) - F.min(F.col("places__")[d]) for d in range(len(dims))]
        asked = {}
        for r in here.groupBy("node__").agg(F.sum("weight__").alias("bytes"), F.array(*width).alias("width")).collect():
            node = nodes[r["node__"]]
            node.dim = max(range(len(dims)), key=lambda d: (r.width[d], -d))
            left = node.leaves // 2
            asked[r["node__"]] = r.bytes // node.leaves * left + r.bytes % node.leaves * left // node.leaves
            node.cut = 1 << KEY_BITS
        _cut(here.withColumn("place__", F.get("places__", _pick([n.dim for n in nodes], "int"))), nodes, "weight__", asked)
        for n in nodes:
            left = n.leaves // 2
            n.children = [Node(left, n.first), Node(n.leaves - left, n.first + left)] if left else []
        tree.levels.append([c for n in nodes for c in (n.children or [n])])
        placed = materialise(tree.descend(placed, len(tree.levels) - 2), "shard-level")
    last = tree.levels[-1]
    dealt = placed.withColumns({"shard": _pick([n.first for n in last], "int"), "part__": F.shiftright("number__", PARTITION_SHIFT)})
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part__").rowsBetween(W.unboundedPreceding, -1))
    counts = dealt.groupBy("shard", "part__").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part__", F.coalesce(before, F.lit(0)).alias("before__"))
    inside = F.row_number().over(W.partitionBy("shard", "part__").orderBy("number__")) - 1
    numbered = dealt.withColumn("slot", inside).join(starts, ["shard", "part__"])
    slot = (F.col("slot") + F.col("before__")).cast("long").alias("slot")
    return numbered.select(*[F.col(f"`{c}`") for c in kept], "shard", slot), tree


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document: shards of near equal bytes.

    Sizes are UTF-8 bytes plus 1; NULL texts have size 1 and the CRC-32 of no bytes. The tree's dimensions are the id,
    the logarithm of the size, the language and the source; equal texts are next to each other where those agree. Ids of
    any type that SQL orders; repeated rows stay.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = (F.octet_length(raw) + 1).cast("long")
    rows = documents.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), "lang", "source")
    rows = rows.withColumn("magnitude", F.log2("size"))
    dealt, _ = kd_shards(rows, "size", ["doc_id", "magnitude", "lang", "source"], ["text_crc32", "doc_id"], shards=shards)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
