"""What op1's model says of texts it has not seen, against the unigram score."""

from pyspark.sql import functions as F

from flowsieve.llm import queries as numbered


def test_held_out_texts_score_above_their_words_alone(spark):
    scored = numbered.op1_log_bilinear_scores(spark, "/root/testdata/sf0.01").filter("held_out")
    total = scored.agg(F.sum("n_tokens").alias("n"), F.sum("score").alias("own"), F.sum("base_score").alias("base")).head()
    assert total.n > 10_000 and (total.own - total.base) / total.n > 0.03
