"""The pipeline's stages on a planted table, and the registered queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowsieve.llm import queries as numbered
from tests.llm import brute
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(numbered.oracle_sql()))
def test_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, numbered.queries()[name], numbered.oracle_sql()[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(numbered.queries()) - set(numbered.oracle_sql()) - {"pipeline"}))
def test_one_row_per_document(spark, name):
    rows = numbered.queries()[name](spark, SF)
    table = "embeddings" if name.startswith("op3_") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name.startswith("op3_"):
        assert rows.count() == 5 * -(-n // 50)
    elif name.startswith("op9_"):
        assert rows.select("doc_id").distinct().count() == n
    else:
        assert rows.count() == n


def test_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = items.orderBy("item_id").head().text
    planted = [(90_000, "### 123", "en"), (90_001, f"Before. {item} After that.", "en"), (90_002, "We keep token = abcdefgh12 in here today for you", "en")]
    more = spark.createDataFrame(planted, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    source.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((before, docs))
        if name != "packing":
            assert docs.columns == source.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(seen[0][0]) - ids(seen[0][1]) == {90_000}
    rows = seen[1][0].select("doc_id", "text").collect()
    fps = [brute.fingerprint(r.text) for r in rows]
    root = brute.groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert ids(seen[1][1]) == {min(rows[j].doc_id for j in range(len(rows)) if root[j] == r) for r in set(root)}
    rows = seen[2][0].select("doc_id", "text").collect()
    gone = {d for d, *_ in brute.leaks([tuple(r) for r in rows], [(r.item_id, r.text) for r in items.collect()])}
    assert 90_001 in gone and ids(seen[2][1]) == ids(seen[2][0]) - gone
    before = {r.doc_id: r.text for r in seen[3][0].collect()}
    after = {r.doc_id: r.text for r in seen[3][1].collect()}
    assert before.keys() == after.keys() and after[90_002] == "We keep [secret] in here today for you"
    assert all((before[i] == after[i]) == (not brute.secret_base(before[i])) for i in before)
    assert ids(docs) == after.keys()
    assert docs.agg(F.sum("n_tokens")).head()[0] == sum(len(brute.space_words(t)) for t in after.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"]
