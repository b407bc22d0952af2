"""Flow-shaped tables derived from the given ones, each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators.score import add_ranking
from flowsieve.plans.registry import table
from flowsieve.schema import FIVE_CLASSES, FlowSchema

CLASSES = list(FIVE_CLASSES.classes)
FLOW_SCHEMA = FlowSchema(ts="ts", key=("event_id",), drop=("event_id", "Flow ID", "Src IP", "ts"))
FLOW_FEATURES = ["value", "k", "hr"]

FLOWS = r"""
flows AS (
  SELECT event_id, ts, user_id,
    'F-' || CAST(event_id AS VARCHAR) AS "Flow ID",
    '10.0.0.' || CAST(user_id AS VARCHAR) AS "Src IP",
    CASE WHEN event_id % 101 = 0 THEN 'n/a' ELSE CAST((user_id * 37) % 65536 AS VARCHAR) END AS "Dst Port",
    CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 17 ELSE 6 END AS "Protocol",
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN event_id % 89 = 0 THEN CAST('Infinity' AS DOUBLE)
         WHEN event_id % 83 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
    CAST(hour(ts) AS DOUBLE) AS hr,
    CASE event_type
      WHEN 'view' THEN CASE WHEN event_id % 10 = 1 THEN 'Bot' ELSE 'Benign' END
      WHEN 'click' THEN CASE WHEN event_id % 10 = 0 THEN 'FTP-BruteForce' ELSE 'BENIGN' END
      WHEN 'signup' THEN 'DDOS attack-HOIC'
      WHEN 'purchase' THEN CASE WHEN event_id % 10 = 5 THEN 'Unlisted' ELSE 'DoS attacks-Hulk' END
      ELSE CASE event_id % 4 WHEN 0 THEN 'SQL Injection' WHEN 1 THEN 'Infilteration'
                             WHEN 2 THEN 'Infiltration' ELSE 'Label' END
    END AS "Label"
  FROM events)"""

MAPPED = """
mapped AS (
  SELECT *, CASE "Label"
      WHEN 'BENIGN' THEN 'Benign' WHEN 'Bot' THEN 'Botnet' WHEN 'FTP-BruteForce' THEN 'Brute Force'
      WHEN 'DDOS attack-HOIC' THEN 'DDoS' WHEN 'DoS attacks-Hulk' THEN 'DoS'
      WHEN 'Infiltration' THEN 'Infilteration' WHEN 'SQL Injection' THEN '__DROP__' ELSE "Label" END AS cls
  FROM flows)"""

SHOWN_SQL = "CASE WHEN value IS NULL OR isnan(value) THEN -1.0 WHEN isinf(value) THEN -2.0 ELSE value END"


def shown() -> Column:
    """``value`` with a plain number for NULL and NaN (-1) and for infinity (-2)."""
    v = F.col("value")
    return F.when(v.isNull() | F.isnan(v), -1.0).when(F.abs(v) == float("inf"), -2.0).otherwise(v)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    benign = F.when(n % 10 == 1, "Bot").otherwise("Benign")
    click = F.when(n % 10 == 0, "FTP-BruteForce").otherwise("BENIGN")
    purchase = F.when(n % 10 == 5, "Unlisted").otherwise("DoS attacks-Hulk")
    error = (
        F.when(n % 4 == 0, "SQL Injection")
        .when(n % 4 == 1, "Infilteration")
        .when(n % 4 == 2, "Infiltration")
        .otherwise("Label")
    )
    kind = F.col("event_type")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("F-"), n.cast("string")).alias("Flow ID"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("Src IP"),
        F.when(n % 101 == 0, "n/a").otherwise(((F.col("user_id") * 37) % 65536).cast("string")).alias("Dst Port"),
        F.when(n % 5 == 0, 0).when(n % 5 == 1, 17).otherwise(6).alias("Protocol"),
        F.when(n % 97 == 0, F.lit(None))
        .when(n % 89 == 0, F.lit(float("inf")))
        .when(n % 83 == 0, F.lit(float("nan")))
        .otherwise(F.col("value"))
        .alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hr"),
        F.when(kind == "view", benign)
        .when(kind == "click", click)
        .when(kind == "signup", "DDOS attack-HOIC")
        .when(kind == "purchase", purchase)
        .otherwise(error)
        .alias("Label"),
    )


SCORED = """
labelled AS (
  SELECT event_id, ts, user_id,
    CASE event_type WHEN 'view' THEN 'Benign' WHEN 'click' THEN 'Benign'
                    WHEN 'signup' THEN 'DDoS' WHEN 'purchase' THEN 'DoS' END AS actual
  FROM events),
weighed AS (
  SELECT event_id, ts, user_id, actual,
    (event_id*31 + user_id*7) % 1000 + 200 + CASE WHEN actual = 'Benign' AND event_id % 10 < 7 THEN 900 ELSE 0 END AS w0,
    (event_id*37 + user_id*11) % 300 + 1 AS w1,
    (event_id*41 + user_id*13) % 300 + 1 AS w2,
    (event_id*43 + user_id*17) % 600 + 1 + CASE WHEN actual = 'DDoS' AND event_id % 10 < 7 THEN 900 ELSE 0 END AS w3,
    (event_id*47 + user_id*19) % 600 + 1 + CASE WHEN actual = 'DoS' AND event_id % 10 < 7 THEN 900 ELSE 0 END AS w4
  FROM labelled),
probs AS (
  SELECT *, w0+w1+w2+w3+w4 AS s FROM weighed),
long AS (
  SELECT event_id, u.idx, u.class, u.w, CAST(u.w AS DOUBLE)/s AS p
  FROM probs, LATERAL (VALUES (0,'Benign',w0),(1,'Botnet',w1),(2,'Brute Force',w2),(3,'DDoS',w3),(4,'DoS',w4)) AS u(idx,class,w)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY w DESC, idx) AS rn FROM long),
tops AS (
  SELECT event_id,
    max(CASE WHEN rn=1 THEN class END) AS c1, max(CASE WHEN rn=1 THEN p END) AS q1,
    max(CASE WHEN rn=2 THEN class END) AS c2, max(CASE WHEN rn=2 THEN p END) AS q2,
    max(CASE WHEN rn=3 THEN class END) AS c3, max(CASE WHEN rn=3 THEN p END) AS q3
  FROM ranked GROUP BY event_id),
scored AS (
  SELECT l.*, c1, q1, c2, q2, c3, q3,
    CASE WHEN c1 <> 'Benign' THEN 'RED' WHEN c2 <> 'Benign' AND q2 >= 0.25 THEN 'YELLOW' ELSE 'GREEN' END AS level
  FROM labelled l JOIN tops t USING (event_id))"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, actual_label and an array of five class probabilities from integer weights.

    Error events are flows without a label: scored like the others, counted where no label is needed.
    """
    return weigh(table(spark, sf_dir, "events"))


def weigh(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    actual = (
        F.when(kind.isin("view", "click"), "Benign").when(kind == "signup", "DDoS").when(kind == "purchase", "DoS")
    )
    e, u = F.col("event_id"), F.col("user_id")

    def weight(a: int, b: int, m: int, base: int, favoured: str | None) -> Column:
        w = (e * a + u * b) % m + base
        if favoured is None:
            return w
        return w + F.when((F.col("actual_label") == favoured) & (e % 10 < 7), 900).otherwise(0)

    weights = F.array(
        weight(31, 7, 1000, 200, "Benign"),
        weight(37, 11, 300, 1, None),
        weight(41, 13, 300, 1, None),
        weight(43, 17, 600, 1, "DDoS"),
        weight(47, 19, 600, 1, "DoS"),
    )
    rows = events.select("event_id", "ts", "user_id", actual.alias("actual_label"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        rows.withColumn("w", weights)
        .withColumn("total", total)
        .select(
            "event_id", "ts", "user_id", "actual_label",
            F.transform("w", lambda x: x.cast("double") / F.col("total").cast("double")).alias("probabilities"),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_ranking(probabilities(spark, sf_dir), CLASSES)


WIDE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2", "net", "gross"]
WIDE = """
wide AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity*2 AS q2,
    l_extendedprice*(1-l_discount) AS net,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN CAST('Infinity' AS DOUBLE)
         ELSE l_extendedprice*(1+l_tax) END AS gross
  FROM lineitem)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    gross = (
        F.when(F.col("l_linenumber") == 7, F.lit(None))
        .when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A"), F.lit(float("inf")))
        .otherwise(price * (1 + F.col("l_tax")))
    )
    return li.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * 2).alias("q2"), (price * (1 - F.col("l_discount"))).alias("net"), gross.alias("gross"),
    )


IMPORTANCES = """
importances AS (
  SELECT feature, share / sum(share) OVER () AS importance FROM (
    SELECT p_brand AS feature, sum(l_extendedprice) * sum(l_extendedprice) AS share
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand))"""


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table of the right shape: brands weighted by the square of their sales."""
    from pyspark.sql import Window as W

    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sales = (
        li.join(parts, li.l_partkey == parts.p_partkey)
        .groupBy(F.col("p_brand").alias("feature"))
        .agg((F.sum("l_extendedprice") * F.sum("l_extendedprice")).alias("share"))
    )
    return sales.select("feature", (F.col("share") / F.sum("share").over(W.partitionBy())).alias("importance"))


TRIALS = """
trials AS (
  SELECT o_orderpriority AS max_depth, o_orderstatus AS max_features,
    avg(o_totalprice) / 1000000 AS mean_score, stddev_pop(o_totalprice) / 1000000 AS std_score, count(*) AS fits
  FROM orders GROUP BY 1, 2)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of search results: order priorities and states as parameters, prices as scores."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("max_depth"), F.col("o_orderstatus").alias("max_features")).agg(
        (F.avg("o_totalprice") / 1000000).alias("mean_score"),
        (F.stddev_pop("o_totalprice") / 1000000).alias("std_score"),
        F.count(F.lit(1)).alias("fits"),
    )
