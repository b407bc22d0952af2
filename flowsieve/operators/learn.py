"""Forest training with MLlib: importance selection, randomised search, final fit, artefacts."""

from __future__ import annotations

import hashlib
import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.storagelevel import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.hashing import seeded_hash
from flowsieve.operators.evaluate import class_metrics, confusion_counts, importance_table, overall_metrics
from flowsieve.operators.profile import class_counts
from flowsieve.operators.sample import stratified_sample
from flowsieve.operators.score import Scorer

# The search space of the published models.
SEARCH_SPACE = {
    "n_estimators": [100, 150],
    "max_depth": [20, 25, 30],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2"],
    "bootstrap": [True],
    "class_weight": ["balanced_subsample", None],
}
#: Rows that one task keeps, binned and with a count and a node for each tree, while a forest grows.
TASK_ROWS = 250_000


@dataclass(frozen=True)
class ForestParams:
    """Forest settings by their common names, translated to MLlib parameters."""

    n_estimators: int = 100
    max_depth: int = 15
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str = "sqrt"
    max_samples: float = 1.0
    class_weight: str | None = None
    bootstrap: bool = True
    max_bins: int = 64
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def classifier(self, label: str, weight: str | None = None) -> RandomForestClassifier:
        options = dict(
            labelCol=label,
            featuresCol="features__",
            numTrees=self.n_estimators,
            maxDepth=self.max_depth,
            # MLlib has no minimum for splitting; half of it is what a split must leave on each side.
            minInstancesPerNode=max(self.min_samples_leaf, ceil(self.min_samples_split / 2)),
            featureSubsetStrategy=self.max_features,
            subsamplingRate=self.max_samples,
            bootstrap=self.bootstrap,
            maxBins=self.max_bins,
            maxMemoryInMB=1024,
            cacheNodeIds=True,
            seed=self.seed,
        )
        if weight:
            options["weightCol"] = weight
        return RandomForestClassifier(**{**options, **self.extra})


def with_class_weight(df: DataFrame, label: str, out: str = "weight__") -> DataFrame:
    """rows / (classes x class rows), from one count by class, joined as a table with a row for each class."""
    counts = class_counts(df, label)
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    weights = counts.select(F.col("class").alias("class__"), (F.lit(totals["rows"]) / (F.col("n") * totals["classes"])).alias(out))
    return df.join(weights, F.col(f"`{label}`").eqNullSafe(F.col("class__")), "left").drop("class__")


def deal_rows(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows in parts of at most about ``task_rows``, if there are more than that.

    MLlib keeps the partitions that it is given, and a file of compressed numbers is many times as large in its cache.
    """
    n = rows.count()
    return rows if n <= task_rows else rows.repartition(max(ceil(n / task_rows), rows.sparkSession.sparkContext.defaultParallelism))


def fit_forest(df: DataFrame, features: list[str], label: str, params: ForestParams) -> PipelineModel:
    """Assembler and forest as one pipeline, with balanced weights where the parameters ask for them."""
    weight = None
    rows = df
    if params.class_weight:
        weight = "weight__"
        rows = with_class_weight(df, label, weight)
    rows = rows.select(
        *[F.col(f"`{f}`").cast("double").alias(f) for f in features],
        F.col(f"`{label}`").cast("double").alias(label),
        *([F.col(weight)] if weight else []),
    )
    assembler = VectorAssembler(inputCols=features, outputCol="features__", handleInvalid="error")
    stages = Pipeline(stages=[assembler, params.classifier(label, weight)])
    dealt = deal_rows(rows)
    if dealt is rows:
        return stages.fit(rows)
    # MLlib asks for its input three times and would deal the rows anew each time.
    dealt.persist(StorageLevel.DISK_ONLY)
    try:
        return stages.fit(dealt)
    finally:
        dealt.unpersist()


def forest_of(model: PipelineModel) -> RandomForestClassificationModel:
    return model.stages[-1]


def forest_importances(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    values = forest_of(model).featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values)], "feature string, importance double"
    )


def clamp_selection(importances: DataFrame, threshold: float = 0.005, smallest: int = 40, largest: int = 45) -> DataFrame:
    """The features at or above the threshold, but no fewer than ``smallest`` and no more than ``largest``."""
    ranked = importance_table(importances)
    above = ranked.agg(F.count_if(F.col("importance") >= threshold).alias("above")).first()["above"]
    keep = max(smallest, min(largest, above))
    return ranked.filter(F.col("rank") <= keep).select("feature", "importance", "rank")


def select_by_importance(
    train: DataFrame,
    features: list[str],
    label: str,
    key: list[str],
    params: ForestParams = ForestParams(),
    threshold: float = 0.005,
    smallest: int = 40,
    largest: int = 45,
) -> tuple[DataFrame, list[str]]:
    """(importances, selected features) of a forest that grows on all rows, however many there are.

    ``key`` decides nothing; it stays for callers that name it.
    """
    model = fit_forest(train, features, label, params)
    importances = forest_importances(train.sparkSession, model, features)
    chosen = clamp_selection(importances, threshold, smallest, largest).orderBy("rank").collect()
    return importances, [r.feature for r in chosen]


class MacroF1Evaluator(Evaluator):
    """Unweighted mean of the class F1 scores; 0 for a class that is never hit."""

    def __init__(self, label: str, prediction: str = "prediction"):
        super().__init__()
        self.label = label
        self.prediction = prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        counts = confusion_counts(dataset, self.label, self.prediction)
        return overall_metrics(class_metrics(counts)).first()["macro_f1"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def draw_parameters(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n distinct combinations of the space, in a seeded order."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    return random.Random(seed).sample(grid, min(n, len(grid)))


def randomised_search(
    train: DataFrame,
    features: list[str],
    label: str,
    key: list[str],
    space: dict[str, list] = SEARCH_SPACE,
    n_iter: int = 15,
    folds: int = 3,
    fraction: float = 0.2,
    max_samples: float = 0.5,
    seed: int = 42,
    parallelism: int = 4,
    extra: dict | None = None,
) -> tuple[DataFrame, dict]:
    """(results, best parameters): mean macro-F1 over folds for each drawn combination.

    Folds come from a hash of the row key. A fit that fails counts as score 0 and does not stop the
    search. Fits run side by side; each is a distributed job of its own.
    """
    rows = stratified_sample(train, label, key, fraction) if fraction < 1.0 else train
    keep = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    sample = rows.select(
        *keep, F.col(f"`{label}`").cast("double").alias(label), (seeded_hash(key, seed) % folds).alias("fold__")
    ).persist()
    evaluator = MacroF1Evaluator(label)

    def one(job: tuple[dict, int]) -> tuple[float, str | None]:
        values, fold = job
        params = ForestParams(**values, max_samples=max_samples, seed=seed, extra=extra or {})
        try:
            model = fit_forest(sample.filter(F.col("fold__") != fold), features, label, params)
            return float(evaluator.evaluate(model.transform(sample.filter(F.col("fold__") == fold)))), None
        except Exception as e:  # noqa: BLE001 - the failed fit scores 0 and its reason is reported
            return 0.0, f"{type(e).__name__}: {e}"

    draws = draw_parameters(space, n_iter, seed)
    jobs = [(values, fold) for values in draws for fold in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        outcome = list(pool.map(one, jobs))
    sample.unpersist()

    records = []
    for i, values in enumerate(draws):
        mine = outcome[i * folds : (i + 1) * folds]
        scores = [s for s, _ in mine]
        mean = sum(scores) / folds
        std = (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5
        failed = next((why for _, why in mine if why), None)
        records.append((i, {k: str(v) for k, v in values.items()}, mean, std, failed))
    results = train.sparkSession.createDataFrame(
        records, "trial int, params map<string,string>, mean_score double, std_score double, failure string"
    )
    best = max(range(len(draws)), key=lambda i: (records[i][2], -i))
    return results, draws[best]


def forest_shape(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Trees, nodes, leaves and depths of a trained forest."""
    trees = [(i, t.numNodes, t.depth) for i, t in enumerate(forest_of(model).trees)]
    return spark.createDataFrame(trees, "tree int, nodes long, depth int").agg(
        F.count(F.lit(1)).alias("trees"),
        F.sum("nodes").alias("nodes"),
        F.sum((F.col("nodes") + 1) / 2).cast("long").alias("leaves"),
        F.avg("depth").alias("mean_depth"),
        F.max("depth").alias("max_depth"),
    )


def training_metadata(
    spark: SparkSession,
    classes: list[str],
    best: dict,
    cv_score: float,
    rows: int,
    shape: DataFrame,
    importances: DataFrame,
    cv_std: float = 0.0,
    iterations: int = 0,
    folds: int = 0,
    tuning_minutes: float = 0.0,
    training_minutes: float = 0.0,
) -> DataFrame:
    """One nested row that describes a training run; its field names are fixed by the stored record."""
    s = shape.first()
    top = importance_table(importances).filter("rank <= 10").orderBy("rank").collect()
    record = [
        (
            "RandomForestClassifier",
            list(classes),
            len(classes),
            importances.count(),
            {"best_params": {k: str(v) for k, v in best.items()}, "best_cv_score": {"macro_f1": str(cv_score), "std": str(cv_std)}},
            (iterations, folds, tuning_minutes),
            (rows, s["trees"], s["nodes"], float(s["mean_depth"]), training_minutes),
            ([r["feature"] for r in top], float(sum(r["importance"] for r in top))),
        )
    ]
    return spark.createDataFrame(
        record,
        "model_type string, class_names array<string>, n_classes int, n_features long, "
        "hyperparameter_tuning map<string, map<string,string>>, search struct<n_iterations: int, cv_folds: int, tuning_time_minutes: double>, "
        "final_training struct<n_samples: long, n_estimators: long, total_nodes: long, avg_tree_depth: double, training_time_minutes: double>, "
        "feature_importances struct<top_10_features: array<string>, top_10_cumulative_importance: double>",
    ).withColumn("training_date", F.current_timestamp())


def write_importances(importances: DataFrame, path: str) -> None:
    importances.orderBy(F.desc("importance"), "feature").write.mode("overwrite").option("header", "true").csv(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance double").option("header", "true").csv(path)


def save_scorer(spark: SparkSession, scorer: Scorer, path: str) -> None:
    """Model, scaler parameters, selected features and class names below one folder."""
    scorer.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(
        [(r.ordinal, r.feature, r.center, r.scale) for r in scorer.scaler],
        "ordinal int, feature string, center double, scale double",
    ).write.mode("overwrite").parquet(f"{path}/scaler")
    for name, values in (("features", scorer.features), ("classes", scorer.classes)):
        spark.createDataFrame(list(enumerate(values)), "ordinal int, name string").write.mode("overwrite").parquet(
            f"{path}/{name}"
        )


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    def names(part: str) -> list[str]:
        return [r.name for r in spark.read.parquet(f"{path}/{part}").orderBy("ordinal").collect()]

    return Scorer(
        spark.read.parquet(f"{path}/scaler").orderBy("ordinal").collect(),
        names("features"),
        names("classes"),
        PipelineModel.load(f"{path}/model"),
    )


def content_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A name of the rows of a table, whatever their order and partitions: equal for equal rows, equally often.

    Two sums of independent 64-bit row hashes and the number of rows, from one aggregate; types and names count, too.
    """
    cells = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    sums = [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")) for seed in (1, 2)]
    known = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in columns]
    return hashlib.sha256(repr((kinds, [str(x) for x in known])).encode()).hexdigest()


def cached_search(
    train: DataFrame, features: list[str], label: str, key: list[str], store: str, space: dict[str, list] = SEARCH_SPACE, **options
) -> tuple[DataFrame, dict, bool]:
    """(results, best parameters, whether they were stored): ``randomised_search``, once for the same content.

    Results lie below ``store``, under a name made from the content of the training columns, the space and all options.
    The same rows in another order or partitioning fit nothing again; one changed value, row or option does. A search
    that was cut off left no complete results and is run again.
    """
    spark = train.sparkSession
    columns = sorted({*features, label, *key})
    asked = repr((content_fingerprint(train, columns), list(features), label, list(key), sorted(space.items()), sorted(options.items())))
    path = f"{store.rstrip('/')}/{hashlib.sha256(asked.encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/best/_SUCCESS")
    known = done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)
    if not known:
        results, best = randomised_search(train, features, label, key, space, **options)
        results.write.mode("overwrite").parquet(f"{path}/results")
        save_best_parameters(spark, best, f"{path}/best")
    results = spark.read.parquet(f"{path}/results")
    return results, load_best_parameters(spark, f"{path}/best"), known


def save_best_parameters(spark: SparkSession, best: dict, path: str) -> None:
    """Search outcome kept for later fits."""
    spark.createDataFrame([(k, repr(v)) for k, v in best.items()], "name string, value string").write.mode(
        "overwrite"
    ).json(path)


def load_best_parameters(spark: SparkSession, path: str) -> dict:
    import ast

    return {r.name: ast.literal_eval(r.value) for r in spark.read.schema("name string, value string").json(path).collect()}
