"""K-d shards against a tree that sorts each node."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowsieve.llm import kd_shards as kd
from flowsieve.llm.queries import op13_kd_shards

SF = "/root/testdata/sf0.001"


def split(rows, leaves, first, out):
    """rows: (places, key after the place, bytes, name)."""
    if leaves == 1 or not rows:
        out.update({name: first for *_, name in rows})
        return
    dims = range(len(rows[0][0]))
    width = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in dims]
    dim = width.index(max(width))
    rows = sorted(rows, key=lambda r: (r[0][dim], r[1]))
    left, total = leaves // 2, sum(r[2] for r in rows)
    asked, before, cut = total * left // leaves, 0, len(rows)
    for i, r in enumerate(rows):
        if before + r[2] >= asked:
            cut = i + (abs(before + r[2] - asked) <= abs(before - asked))
            break
        before += r[2]
    split(rows[:cut], left, first, out)
    split(rows[cut:], leaves - left, first + left, out)


def plain(df, tree, size, tie, leaves):
    placed = df.withColumns({"places__": F.array(*tree.places()), "hash__": F.shiftrightunsigned(F.xxhash64(*tie), 4)})
    rows = [(r.places__, r.hash__, max(0, r[size] or 0), i) for i, r in enumerate(placed.collect())]
    out = {}
    split(rows, leaves, 0, out)
    return out


@pytest.mark.parametrize("leaves", [16, 5, 1])
def test_tree_of_the_table(spark, leaves):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.octet_length("text"))
    df = docs.select("doc_id", "size", "lang", "source", "n_chars").repartition(4).cache()
    dealt, tree = kd.kd_shards(df, "size", ["doc_id", "source", "n_chars", "lang"], ["doc_id"], shards=leaves)
    got = {r.doc_id: r.shard for r in dealt.collect()}
    want = plain(df, tree, "size", ["doc_id"], leaves)
    assert got == {r.doc_id: want[i] for i, r in enumerate(df.collect())}
    assert dealt.columns == [*df.columns, "shard", "slot"]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_kd_shards(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()
    }
    assert len(rows) == len(docs) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    totals, counts = Counter(), Counter(r.shard for r in rows)
    for r in rows:
        totals[r.shard] += r["size"]
    assert set(counts) == set(range(16))
    assert max(totals.values()) - min(totals.values()) <= max(r["size"] for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s, n in counts.items() for i in range(n))


def test_hot_places_and_repeated_rows_are_cut(spark):
    hot = spark.range(3_000).select(F.lit(None).cast("long").alias("id"), F.lit("copy").alias("source"), F.lit(10).alias("size"), F.lit(0).alias("slot"))
    rest = spark.range(6_000).select("id", F.concat(F.lit("s"), F.col("id") % 7).alias("source"), (F.col("id") % 19).cast("int").alias("size"), F.lit(0).alias("slot"))
    both = hot.unionAll(rest).repartition(5)
    dealt, tree = kd.kd_shards(both, "size", ["source", "id"], ["source", "id"], shards=16)
    sums = dealt.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert max(r.s for r in sums) - min(r.s for r in sums) <= 40 and len(sums) == 16
    assert all(r.n == r.d == r.m + 1 for r in sums)
    assert dealt.columns == ["id", "source", "size", "shard", "slot"] and dealt.count() == 9_000
    assert len(tree.levels) == 5


def test_bytes_of_a_shard(spark):
    df = spark.range(1_000).select("id", F.lit(7).alias("size"))
    dealt, tree = kd.kd_shards(df, "size", ["id"], ["id"], target_bytes=700)
    got = dealt.groupBy("shard").agg(F.min("id"), F.max("id"), F.count("*")).orderBy("shard").collect()
    assert [tuple(r) for r in got] == [(s, 100 * s, 100 * s + 99, 100) for s in range(10)]
    for wrong in ({}, {"shards": 2, "target_bytes": 3}, {"shards": 0}):
        with pytest.raises(ValueError):
            kd.kd_shards(df, "size", ["id"], ["id"], **wrong)


def test_odd_documents(spark):
    schema = "doc_id string, text string, lang string, source string, shard string, size string"
    texts = [None, "", "x", "é" * 40_000, "same", "same", None]
    rows = [(None if i % 3 == 0 else f"d{i}", t, None, None, "no", None) for i, t in enumerate(texts)]
    rows += [rows[4]] * 20
    got = kd.shard_documents(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    shards = Counter(r.shard for r in got)
    assert set(shards) <= set(range(16)) and sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, n in shards.items() for i in range(n))
    assert kd.shard_documents(spark.createDataFrame([], schema)).count() == 0
    nothing = spark.createDataFrame([(None,) * 6] * 3, schema)
    assert [(r["size"], r.text_crc32) for r in kd.shard_documents(nothing).collect()] == [(1, 0)] * 3


def test_sizes_and_numbers_that_are_none(spark):
    data = [(1.0, None), (float("nan"), 5), (float("inf"), -4), (None, 6), (2.0, 0), (-1e308, 7), (1e308, 3)]
    df = spark.createDataFrame(data, "x double, bytes long")
    dealt, _ = kd.kd_shards(df, "bytes", ["x"], ["x", "bytes"], shards=3)
    assert sorted(str(tuple(r)[:2]) for r in dealt.collect()) == sorted(map(str, data))
    none, _ = kd.kd_shards(df.withColumn("bytes", F.lit(0)), "bytes", ["x"], ["x"], shards=4)
    assert sorted(Counter(r.shard for r in none.collect()).values()) == [1, 2, 2, 2]


def test_plan_is_native(spark, capsys):
    op13_kd_shards(spark, SF).explain()
    assert "Python" not in (out := capsys.readouterr().out) and "Arrow" not in out and "Cartesian" not in out
