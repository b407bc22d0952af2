"""From a flow table to a trained scorer, and the learning queries (E)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.hashing import seeded_hash
from flowsieve.functions.values import everything
from flowsieve.operators import clean, encode, evaluate, learn, sample
from flowsieve.operators.balance import distinct_points, hashed_neighbours, nearest_in_class, oversample, oversampling_targets, synthetic_rows
from flowsieve.operators.correlate import correlated_features_to_drop, correlation_pairs
from flowsieve.operators.neighbour_graph import neighbour_graph
from flowsieve.operators.score import Scorer
from flowsieve.plans.fixtures import FLOWS, MAPPED, flows
from flowsieve.plans.registry import query, rounded, table
from flowsieve.schema import FIVE_CLASSES, Variant, numeric_columns
from flowsieve.session import materialise, scratch_path


@dataclass(frozen=True)
class Prepared:
    """Model-ready tables and what was learnt on the way."""

    train: DataFrame
    test: DataFrame
    classes: list[str]
    scaler: list
    features: list[str]
    correlated: list[str]


def prepare(
    raw: DataFrame,
    key: str,
    label: str = "Label",
    drop: tuple[str, ...] = (),
    variant: Variant = FIVE_CLASSES,
    seed: int = 42,
    balance: bool = True,
) -> Prepared:
    """Clean, consolidate, encode, split, scale, oversample and drop correlated features.

    Equal rows are removed before a key is needed again, so the surviving copy keeps its smallest key.
    Each stage table that later steps scan more than once is written to the shared folder.
    """
    rows = clean.drop_identifiers(raw, drop)
    rows = rows.filter(~F.col(f"`{label}`").eqNullSafe(F.lit("Label")))
    rows = clean.drop_infinite_rows(clean.drop_missing_rows(rows))
    columns = [c for c in rows.columns if c != key]
    rows = rows.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.min(key).alias(key))
    rows = clean.drop_classes(clean.consolidate(clean.standardise_port_protocol(rows), label), label, variant)
    # Written before the protocols are looked up, or all rows would be grouped twice.
    rows = materialise(rows, "clean")
    rows = encode.one_hot_all(rows) if "Protocol" in rows.columns else rows

    classes = encode.class_list(rows, label)
    coded = encode.encode_label(rows, classes, label, "y")
    features = numeric_columns(coded, (key, "y", label))
    train, test = sample.stratified_split(coded, "y", [key], 0.2, seed)
    scaler = encode.scaler_rows(encode.fit_scaler(train, features))
    keep = [F.col(f"`{c}`") for c in (key, "y", *features)]
    train = materialise(encode.apply_scaler(train, scaler).select(*keep), "train")
    test = encode.apply_scaler(test, scaler).select(*keep)

    correlated = correlated_features_to_drop(correlation_pairs(train, features))
    left = [f for f in features if f not in correlated]
    if balance:
        full = oversample(train, "y", key, features, "dynamic", seed=seed)
        train = materialise(full.select(key, "y", *[F.col(f"`{f}`") for f in left], "synthetic"), "balanced")
    return Prepared(train, test, classes, scaler, left, correlated)


def train_scorer(
    prepared: Prepared,
    key: str,
    importance: learn.ForestParams = learn.ForestParams(),
    final: learn.ForestParams = learn.ForestParams(n_estimators=150, max_depth=20, min_samples_split=5),
    smallest: int = 40,
    largest: int = 45,
) -> tuple[Scorer, DataFrame]:
    """(scorer, importances): importance selection and the final fit, both on the whole training table."""
    importances, chosen = learn.select_by_importance(
        prepared.train, prepared.features, "y", [key], importance, smallest=smallest, largest=largest
    )
    model = learn.fit_forest(prepared.train, chosen, "y", final)
    return Scorer(prepared.scaler, chosen, prepared.classes, model), importances


LINE_FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SMALL = learn.ForestParams(n_estimators=10, max_depth=6)


KEPT = """kept AS (SELECT DISTINCT user_id, "Dst Port", "Protocol", value, k, hr, cls, "Label" FROM mapped
      WHERE "Label" <> 'Label' AND NOT (value IS NULL OR isnan(value) OR isinf(value)) AND "Dst Port" <> 'n/a' AND cls NOT IN ('__DROP__', 'Infilteration'))"""
SPLIT = f"""{KEPT}, per AS (SELECT cls, count(*) AS n FROM kept GROUP BY 1),
    total AS (SELECT CAST(ceil(0.2 * sum(n)) AS BIGINT) AS t, CAST(sum(n) AS BIGINT) AS s FROM per),
    parts AS (SELECT cls, n, (n * t) // s AS q, (n * t) % s AS rest, t FROM per, total),
    split AS (SELECT cls, n, CAST(q + CASE WHEN row_number() OVER (ORDER BY rest DESC, cls) <= t - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS test FROM parts)"""
# The port is a multiple of the user id until it wraps; while the two are correlated, the second goes.
TWINS = """twins AS (SELECT abs(corr(user_id, CAST("Dst Port" AS DOUBLE))) >= 0.99 AS gone FROM kept)"""
TRAINED = f"WITH {FLOWS}, {MAPPED}, {SPLIT} SELECT CAST(sum(n - test) AS BIGINT) AS training_rows"


def twice(rows: DataFrame, key: str, name: str) -> DataFrame:
    """For each key, whether its two rows are equal."""
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n__"))
    return same.groupBy(key).agg((F.min("n__") == 2).alias(name))


def small_prepared(spark, d, balance=True):
    rows = flows(spark, d).drop("ts")
    return prepare(rows, "event_id", drop=("Flow ID", "Src IP"), balance=balance)


VECTORS = "vectors AS (SELECT vec_id, label, embedding FROM embeddings)"
NEAR = """near AS (SELECT a.label AS c, a.vec_id AS id, b.vec_id AS neighbour,
      list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY distance, neighbour) AS rank FROM near)"""


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])


AXES = [f"x{i}" for i in range(64)]


@query("e4_nearest_in_class", f"""WITH {NEAR} SELECT c, id, neighbour, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5""")
def _(spark, d):
    near = nearest_in_class(distinct_points(vectors(spark, d), "label", "vec_id", AXES), 5)
    return rounded(near.select("c", "id", "neighbour", "distance", F.col("rank").cast("long").alias("rank")))


@query("e4_hashed_neighbours")
def _(spark, d):
    """Five other points of the same class for every point, from runs of 128 points."""
    near = hashed_neighbours(distinct_points(vectors(spark, d), "label", "vec_id", AXES), 5, block_rows=128)
    return rounded(near.select("c", "id", "neighbour", "distance", F.col("rank").cast("long").alias("rank")))


@query("e4_hashed_neighbours_invariants", """SELECT label AS c, count(*) AS points, 5 * count(*) AS pairs, true AS measured FROM embeddings GROUP BY 1""")
def _(spark, d):
    """How many pairs there are, and whether all of them are of one class and at their true distance."""
    points = distinct_points(vectors(spark, d), "label", "vec_id", AXES)
    near = hashed_neighbours(points, 5, block_rows=128)
    own = points.select(F.col("c").alias("kind"), "id", F.col("v").alias("own"))
    other = points.select(F.col("c").alias("other_kind"), F.col("id").alias("neighbour"), F.col("v").alias("other"))
    square = F.aggregate(F.zip_with("own", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    true_one = (F.abs(F.sqrt(square) - F.col("distance")) < 1e-9) & (F.col("kind") == F.col("other_kind")) & (F.col("id") != F.col("neighbour"))
    checked = near.join(own, "id").join(other, "neighbour").withColumn("true_one", true_one)
    return checked.groupBy("c").agg(
        F.count_distinct("id").alias("points"), F.count_distinct("id", "neighbour").alias("pairs"), F.every("true_one").alias("measured")
    )


@query("e4_neighbour_graph")
def _(spark, d):
    """Five near points of the same class for every point; runs of 64 points make the classes large."""
    near = neighbour_graph(distinct_points(vectors(spark, d), "label", "vec_id", AXES), 5, run_rows=64)
    return rounded(near.select("c", "id", "neighbour", "distance", F.col("rank").cast("long").alias("rank")))


@query("e4_neighbour_graph_recall", """SELECT label AS c, count(*) AS points, 5 * count(*) AS pairs, true AS recall_95 FROM embeddings GROUP BY 1""")
def _(spark, d):
    """The graph against the exact neighbours, by class: at least 95 of 100 are found."""
    points = distinct_points(vectors(spark, d), "label", "vec_id", AXES)
    exact = nearest_in_class(points, 5).select(F.col("id").alias("i"), F.col("neighbour").alias("n"))
    near = neighbour_graph(points, 5, run_rows=64)
    both = near.join(exact, (F.col("id") == F.col("i")) & (F.col("neighbour") == F.col("n")), "left")
    found = F.count("i") >= 0.95 * F.count(F.lit(1))
    return both.groupBy("c").agg(F.count_distinct("id").alias("points"), F.count(F.lit(1)).alias("pairs"), found.alias("recall_95"))


MD5 = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"


@query("e4_synthetic_rows", f"""WITH {NEAR}, counts AS (SELECT label AS c, count(*) AS n FROM embeddings GROUP BY 1),
    second AS (SELECT n AS reference FROM (SELECT n, row_number() OVER (ORDER BY n DESC, c) AS rn FROM counts) WHERE rn = 2),
    wanted AS (SELECT c, n, CAST(floor(n + (reference - n) / 2.0) AS BIGINT) - n AS extra FROM counts, second WHERE n < reference),
    seeds AS (SELECT e.label AS c, e.vec_id AS id, e.embedding AS v, w.extra // w.n +
        CASE WHEN row_number() OVER (PARTITION BY e.label ORDER BY {MD5.format("CAST(e.vec_id AS VARCHAR) || '|42'")}, e.vec_id) <= w.extra % w.n THEN 1 ELSE 0 END AS quota
      FROM embeddings e JOIN wanted w ON w.c = e.label WHERE w.extra > 0),
    draws AS (SELECT c, id, v, unnest(range(1, quota + 1)) AS draw FROM seeds),
    picks AS (SELECT *, {MD5.format("CAST(id AS VARCHAR) || '|' || CAST(draw AS VARCHAR) || '|43'")} % 5 AS nth,
      {MD5.format("CAST(id AS VARCHAR) || '|' || CAST(draw AS VARCHAR) || '|44'")} / 1152921504606846976.0::DOUBLE AS gap FROM draws)
    SELECT p.c AS label, p.id AS seed_id, p.draw, r.neighbour, round(p.gap, 6) AS gap,
      {", ".join(f"round(CAST(p.v[{i + 1}] AS DOUBLE) + p.gap * (CAST(b.embedding[{i + 1}] AS DOUBLE) - CAST(p.v[{i + 1}] AS DOUBLE)), 6) AS x{i}" for i in range(64))}
    FROM picks p JOIN ranked r ON r.id = p.id AND r.rank = p.nth + 1 JOIN embeddings b ON b.vec_id = r.neighbour""")
def _(spark, d):
    rows = vectors(spark, d)
    extra = {r["class"]: r["extra"] for r in oversampling_targets(rows, "label").collect()}
    made = synthetic_rows(rows, "label", "vec_id", AXES, extra, portable=True)
    return rounded(made.select("label", "seed_id", "draw", "neighbour", "gap", *AXES))


@query("e4_balanced_class_sizes", f"""WITH {FLOWS}, {MAPPED}, base AS (SELECT cls, count(*) AS n FROM mapped GROUP BY 1),
    second AS (SELECT n AS reference FROM (SELECT n, row_number() OVER (ORDER BY n DESC, cls) AS rn FROM base) WHERE rn = 2)
    SELECT cls AS "Label", n AS rows, CAST(CASE WHEN n < reference THEN floor(n + (reference - n) / 2.0) - n ELSE 0 END AS BIGINT) AS synthetic_rows
    FROM base, second""")
def _(spark, d):
    rows = clean.consolidate(flows(spark, d))
    full = oversample(rows, "Label", "event_id", ["k", "hr"], "dynamic")
    return full.groupBy("Label").agg(
        F.count_if(~F.col("synthetic")).alias("rows"), F.count_if("synthetic").alias("synthetic_rows")
    )


def small_importances(spark, d):
    p = small_prepared(spark, d, balance=False)
    return learn.select_by_importance(p.train, p.features, "y", ["event_id"], SMALL, smallest=3, largest=5)


@query("e6_forest_importances")
def _(spark, d):
    """Importance of each feature, and whether it is selected."""
    importances, chosen = small_importances(spark, d)
    return importances.select("feature", "importance", F.col("feature").isin(*chosen).alias("selected"))


@query("e6_forest_importances_invariants", f"""WITH {FLOWS}, {MAPPED}, {KEPT}, {TWINS}, names AS (
      SELECT unnest(['Dst Port', 'Protocol_0', 'Protocol_17', 'Protocol_6', 'hr', 'k', 'user_id', 'value']) AS feature)
    SELECT feature, true AS in_range, true AS sum_is_one FROM names, twins WHERE NOT (gone AND feature = 'Dst Port')""")
def _(spark, d):
    importances, _ = small_importances(spark, d)
    total = F.sum("importance").over(everything())
    return importances.select("feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(total - 1) < 1e-9).alias("sum_is_one"))


SPACE = {"n_estimators": [5, 10], "max_depth": [4, 6], "min_samples_leaf": [1, 4], "max_features": ["sqrt"]}


def small_search(spark, d):
    p = small_prepared(spark, d, balance=False)
    return p, learn.randomised_search(p.train, p.features, "y", ["event_id"], SPACE, n_iter=3, folds=3, fraction=0.5)[0]


@query("e7_randomised_search")
def _(spark, d):
    """The drawn parameters with their mean macro-F1 over the folds."""
    results = small_search(spark, d)[1]
    return results.select("trial", *[F.col("params")[k].alias(k) for k in SPACE], "mean_score", "std_score", "failure")


@query("e7_randomised_search_invariants", f"""WITH {FLOWS}, {MAPPED}, {SPLIT} SELECT unnest([0, 1, 2]) AS trial, (SELECT count(*) FROM split) AS classes,
    true AS in_space, true AS in_range, true AS fitted""")
def _(spark, d):
    p, results = small_search(spark, d)
    drawn = reduce(and_, [F.col("params")[k].isin(*map(str, v)) for k, v in SPACE.items()])
    fair = (F.col("mean_score") > 0) & (F.col("mean_score") <= 1) & (F.col("std_score") >= 0)
    kinds = F.lit(len(p.classes)).cast("long").alias("classes")
    return results.select("trial", kinds, drawn.alias("in_space"), fair.alias("in_range"), F.col("failure").isNull().alias("fitted"))


def shape_facts(shape, rows, depth):
    """What holds for any forest: its size, its depth bound, and that every inner node has two children."""
    binary = F.col("nodes") == 2 * F.col("leaves") - F.col("trees")
    return shape.select(F.lit(rows).cast("long").alias("training_rows"), "trees", (F.col("max_depth") <= depth).alias("within_depth"), binary.alias("binary"))


@query("e8_parameter_cache", f"""WITH {FLOWS}, {MAPPED}, {SPLIT}, rows AS (SELECT CAST(sum(n - test) AS BIGINT) AS n FROM split)
    SELECT unnest(['first', 'other order', 'a row less', 'other space']) AS search, unnest([n, n, n - 1, n]) AS training_rows,
      unnest([false, true, false, false]) AS stored, unnest([CAST(2 AS BIGINT), 2, 2, 1]) AS trials FROM rows""")
def _(spark, d):
    """Searches on one training table, on its rows in another order, without one of them, and over another space."""
    p = small_prepared(spark, d, balance=False)
    store, space = scratch_path(spark, "parameters"), {"n_estimators": [3], "max_depth": [2, 3]}
    first = p.train.agg(F.min("event_id")).first()[0]
    tables = [
        ("first", p.train, space),
        ("other order", p.train.repartition(7, "event_id"), space),
        ("a row less", p.train.filter(F.col("event_id") != first), space),
        ("other space", p.train, space | {"max_depth": [2]}),
    ]
    found = []
    for name, train, asked in tables:
        results, _, stored = learn.cached_search(train, p.features, "y", ["event_id"], store, asked, n_iter=2, folds=2)
        found.append((name, train.count(), stored, results.count()))
    return spark.createDataFrame(found, "search string, training_rows long, stored boolean, trials long")


def final_shape(spark, d):
    """(shape, real training rows) of a forest fitted to the balanced training table."""
    p = small_prepared(spark, d)
    return learn.forest_shape(spark, learn.fit_forest(p.train, p.features, "y", SMALL)), p.train.filter(~F.col("synthetic")).count()


@query("e8_final_fit_shape")
def _(spark, d):
    shape, rows = final_shape(spark, d)
    return shape.withColumn("training_rows", F.lit(rows).cast("long"))


@query("e8_final_fit_invariants", f"{TRAINED}, CAST(10 AS BIGINT) AS trees, true AS within_depth, true AS binary FROM split")
def _(spark, d):
    return shape_facts(*final_shape(spark, d), SMALL.max_depth)


def weighted_shape(spark, d):
    """(shape, training rows) of a forest with class weights."""
    p = small_prepared(spark, d, balance=False)
    params = learn.ForestParams(n_estimators=5, max_depth=8, class_weight="balanced_subsample")
    return learn.forest_shape(spark, learn.fit_forest(p.train, p.features, "y", params)), p.train.count()


@query("d36_forest_shape")
def _(spark, d):
    shape, rows = weighted_shape(spark, d)
    return shape.withColumn("training_rows", F.lit(rows).cast("long"))


@query("d36_forest_invariants", f"{TRAINED}, CAST(5 AS BIGINT) AS trees, true AS within_depth, true AS binary FROM split")
def _(spark, d):
    return shape_facts(*weighted_shape(spark, d), 8)


def held_out_metrics(spark, d):
    """A forest fitted to the training part and judged on the part it has not seen."""
    p = small_prepared(spark, d)
    said = learn.fit_forest(p.train, p.features, "y", SMALL).transform(p.test)
    named = encode.decode_label(encode.decode_label(said, p.classes, "y", "actual"), p.classes, "prediction", "predicted")
    return evaluate.class_metrics(evaluate.confusion_counts(named, "actual", "predicted"))


@query("d18_held_out_metrics")
def _(spark, d):
    return held_out_metrics(spark, d)


@query("d18_held_out_invariants", f"""WITH {FLOWS}, {MAPPED}, {SPLIT} SELECT cls AS class, test AS support, true AS consistent FROM split WHERE test > 0""")
def _(spark, d):
    shares = reduce(and_, [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")])
    return held_out_metrics(spark, d).select("class", "support", (shares & (F.col("correct") <= F.least("support", "predicted"))).alias("consistent"))


def small_scorer(spark, d):
    return train_scorer(small_prepared(spark, d), "event_id", SMALL, SMALL, smallest=3, largest=6)[0]


@query("e10_scored_flows")
def _(spark, d):
    scorer = small_scorer(spark, d)
    return scorer.score(flows(spark, d).drop("ts")).select("event_id", "Label", "predicted_class", "confidence", "threat_level")


@query("e10_scored_flows_invariants", f"""WITH {FLOWS} SELECT event_id, "Label", true AS scored FROM flows""")
def _(spark, d):
    scorer = small_scorer(spark, d)
    out = scorer.score(flows(spark, d).drop("ts"))
    sound = F.col("predicted_class").isin(*scorer.classes) & F.col("confidence").between(1 / len(scorer.classes), 1)
    return out.select("event_id", "Label", (sound & F.col("threat_level").isin("RED", "YELLOW", "GREEN")).alias("scored"))


def lineitem_scorer(spark, d, params=SMALL) -> Scorer:
    """A forest that tells the return flag of an order line from its numbers, trained on four orders of five."""
    rows = table(spark, d, "lineitem").filter(seeded_hash(["l_orderkey"], 42) % 5 > 0).select("l_returnflag", *LINE_FEATURES)
    classes = encode.class_list(rows, "l_returnflag")
    coded = encode.encode_label(rows, classes, "l_returnflag", "y")
    scaler = encode.scaler_rows(encode.fit_scaler(coded, LINE_FEATURES))
    model = learn.fit_forest(encode.apply_scaler(coded, scaler), LINE_FEATURES, "y", params)
    return Scorer(scaler, LINE_FEATURES, classes, model)


@query("e10_scored_lineitem")
def _(spark, d):
    """Confusion counts of all order lines, with the mean confidence of each cell."""
    out = lineitem_scorer(spark, d).score(table(spark, d, "lineitem"))
    return out.groupBy("l_returnflag", "predicted_class").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


@query("e10_scored_lineitem_invariants", "SELECT l_returnflag, count(*) AS n, true AS scored FROM lineitem GROUP BY 1")
def _(spark, d):
    scorer = lineitem_scorer(spark, d)
    sound = F.col("predicted_class").isin(*scorer.classes) & F.col("confidence").between(1 / len(scorer.classes), 1)
    out = scorer.score(table(spark, d, "lineitem"))
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.bool_and(sound).alias("scored"))
