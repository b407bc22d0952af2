"""Every operator on tables whose columns hold nothing but NULL, and on ids that are not longs."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import language_model, languages
from flowsieve.llm.collision_search import nearest
from flowsieve.llm.leaks import find_leaks, without_leaks
from flowsieve.llm.licences import licence_digest, scan_licences
from flowsieve.llm.packing import pack
from flowsieve.llm.pii import find_pii, pii_digest
from flowsieve.llm.secrets import mask_secrets, scan_history, span_digest
from flowsieve.llm.simhash import fingerprint_groups, one_of_each
from flowsieve.llm.token_counts import count_tokens
from flowsieve.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "Write to ann@mail.org, token = abcdefgh12, under the MIT License."
TABLES = {
    "null ids": [(None, TEXT, "en", "s", 3, 1), (None, TEXT, "en", "s", 3, 1)],
    "hardly a text": [("a", None, "en", None, None, None), ("b", None, None, "s", None, 2), ("c", "12 34", "en", "s", 5, 1), ("d", "", "en", "s", 0, 1)],
    "nothing": [(None, None, None, None, None, None)] * 3,
}


@pytest.mark.parametrize("name, kind", [("null ids", "int"), ("hardly a text", "int"), ("nothing", "string")])
def test_documents(spark, name, kind):
    rows = TABLES[name]
    schema = "doc_id string, text string, lang string, source string, n_chars long, spans int"
    docs = spark.createDataFrame(rows, schema)
    if kind == "int":
        docs = docs.withColumn("doc_id", F.ascii("doc_id").cast("int"))
    items = spark.createDataFrame([(None, None), (1, ""), (2, "no such words in any of the texts")], "item_id int, text string")
    train = F.col("doc_id").isNull() | F.col("doc_id").isNotNull()
    model = languages.train(docs)
    found = [
        language_model.score_texts(docs, train),
        language_model.score_texts(docs, F.lit(False)),
        count_tokens(docs, TOKENIZER),
        fingerprint_groups(docs),
        licence_digest(scan_licences(docs)),
        span_digest(scan_history(docs, scratch_path(spark, "ledger"))),
        mask_secrets(docs, scratch_path(spark, "ledger")),
        languages.identify(docs, model),
        pii_digest(find_pii(docs)),
        pack(docs),
        without_leaks(docs, items),
    ]
    assert [df.count() for df in found] == [len(rows)] * len(found)
    for df in found:
        df.write.format("noop").mode("overwrite").save()
    assert find_leaks(docs, items).count() == 0
    assert one_of_each(docs).columns == docs.columns and one_of_each(docs).count() >= 1
    letters = sum(bool(r[1]) and any(c.isalpha() for c in r[1]) for r in rows)
    assert languages.keep_identified(docs, model).count() == (letters if model.languages else 0)


@pytest.mark.parametrize("kind", ["array<double>", "array<float>", "array<int>"])
def test_vectors(spark, kind):
    vectors = spark.createDataFrame([(None, None), (1, None), (None, [1])], "vec_id int, embedding array<int>")
    vectors = vectors.withColumn("embedding", F.col("embedding").cast(kind))
    assert nearest(vectors, F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1, 2], 9), (2, [2, 4], 9)], "vec_id int, embedding array<int>, shard int")
    got = nearest(two.withColumn("embedding", F.col("embedding").cast(kind)), F.col("vec_id") == 1).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(1, 1, 2)]
