"""Per-horizon forests and boosting on area datasets, with chronological evaluation.

Training sets are DataFrames of any size; fills come from training rows only.
Only fitted models and one-row counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skywharf.functions.weather import clip
from skywharf.models.fits import side_by_side, vectors
from skywharf.operators import cleaning, labels, metrics
from skywharf.plans.dims import dimension
from skywharf.plans.ranks import attach, exact_quantiles
from skywharf.plans.timeline import number_rows
from skywharf.schema import HORIZONS
from skywharf.session import cut_lineage

# Forest size and leaf of every tree model, and the random seed.
TREES, MIN_LEAF, SEED = 80, 2, 42
#: Levels of a forest's trees. The reference sets no limit; each further level doubles what a fit may shuffle and the driver holds.
FOREST_DEPTH = 10
TRAIN_SHARE = 0.8
RAIN_CAP_MM = 200.0
EVENT_CUT = 0.5
# Sizes of the reference: rounds and depth of boosting, and of the stacked forest; folds of stacking and validation.
ROUNDS, ROUNDS_NAMED, BOOSTED_DEPTH = 100, 120, 3
STACKED_TREES, STACKED_DEPTH, FOLDS = 50, 8, 5
# The rain benchmark trains amounts on rows above this.
RAINY_MM = 0.5


def rounds(algorithm: str) -> int:
    return ROUNDS if algorithm == "gradient_boosting" else ROUNDS_NAMED


def regressor(algorithm: str, label: str, trees: int = TREES, weight: str | None = None, depth: int | None = None):
    """MLlib estimator by name; every boosting name maps to gradient-boosted trees. ``depth`` is that of a forest."""
    if algorithm == "random_forest":
        model = RandomForestRegressor(numTrees=trees, maxDepth=depth or FOREST_DEPTH, minInstancesPerNode=MIN_LEAF, seed=SEED)
    elif algorithm in ("gradient_boosting", "lightgbm", "xgboost"):
        model = GBTRegressor(maxIter=rounds(algorithm), maxDepth=BOOSTED_DEPTH, minInstancesPerNode=MIN_LEAF, seed=SEED)
    elif algorithm == "linear":
        model = LinearRegression(regParam=1.0, elasticNetParam=0.0)
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    model = model.setLabelCol(label).setFeaturesCol("features")
    return model.setWeightCol(weight) if weight else model


def chronological(df: DataFrame, keys: Sequence[str], time: str, share: float = TRAIN_SHARE, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``is_train``: the first share of each key's rows in time order."""
    numbered = number_rows(df, keys, time, tie, total="_n")
    return numbered.withColumn("is_train", F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_rn", "_n")


def train_fills(df: DataFrame, features: Sequence[str], is_train: str = "is_train") -> DataFrame:
    """One row with the exact training median of each feature, 0 where there is none."""
    long = df.filter(is_train).select(*features).unpivot([], list(features), "_feature", "_value")
    medians = exact_quantiles(long, ["_feature"], "_value", {"_median": 0.5})
    return medians.groupBy().agg(
        *[F.coalesce(F.max(F.when(F.col("_feature") == f, F.col("_median"))), F.lit(0.0)).alias(f"{f}_fill") for f in features]
    )


def filled(df: DataFrame, features: Sequence[str], fills: DataFrame) -> DataFrame:
    """Features as doubles with stored fills applied."""
    joined = attach(df, fills, [])
    return joined.withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"{f}_fill")) for f in features}).drop(*[f"{f}_fill" for f in features])


def prepare(dataset: DataFrame, keys: Sequence[str], time: str, features: Sequence[str]) -> DataFrame:
    """Split, fill and checkpoint a dataset for repeated fits."""
    tagged = cut_lineage(chronological(dataset, keys, time))
    return cut_lineage(filled(tagged, features, train_fills(tagged, features)))


def fit_pipeline(train: DataFrame, features: Sequence[str], estimator) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator]).fit(train)


def with_prediction(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", name).drop("features", "rawPrediction", "probability")


def added(model, table: DataFrame, name: str) -> DataFrame:
    """``table`` with the prediction of a model of its vectors, which it keeps for further models."""
    return model.transform(table).withColumnRenamed("prediction", name)


# --- regressors per horizon -----------------------------------------------


def train_regressors(dataset: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], targets: dict[str, str], persistence: str,
                     algorithm: str = "random_forest", trees: int = TREES) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit one model per horizon; returns the models and held-out predictions.

    ``targets`` maps horizon to label column. Predictions are long rows:
    keys, time, horizon, truth, predicted, persistence, train_mean.
    """
    prepared = prepare(dataset, keys, time, features)

    def one(label: str) -> PipelineModel:
        return fit_pipeline(prepared.filter(F.col(label).isNotNull() & F.col("is_train")), features, regressor(algorithm, label, trees))

    models = dict(zip(targets, side_by_side(dataset.sparkSession, [partial(one, label) for label in targets.values()])))
    held_out = None
    for horizon, label in targets.items():
        rows = prepared.filter(F.col(label).isNotNull())
        mean = rows.filter("is_train").agg(F.avg(label).alias("train_mean"))
        test = with_prediction(models[horizon], rows.filter("NOT is_train"), "predicted")
        part = attach(test, mean, []).select(
            *keys, time, F.lit(horizon).alias("horizon"), F.col(label).alias("truth"), "predicted", F.col(persistence).alias("persistence"), "train_mean"
        )
        held_out = part if held_out is None else held_out.unionByName(part)
    return models, held_out


def regression_report(held_out: DataFrame, groups: Sequence[str] = ("horizon",)) -> DataFrame:
    """Errors and the persistence comparison of held-out predictions."""
    scores = metrics.regression_scores(held_out, groups, "truth", "predicted")
    compared = metrics.persistence_comparison(held_out, groups, "truth", "predicted", "persistence", "train_mean")
    return scores.join(compared.select(*groups, "persistence_mae", "matches_persistence"), list(groups)).withColumn("grade", metrics.mae_grade(F.col("mae")))


# --- rain -----------------------------------------------------------------


def classifier(algorithm: str, label: str, trees: int = TREES):
    """MLlib classifier by name; every boosting name maps to gradient-boosted trees."""
    if algorithm == "random_forest":
        model = RandomForestClassifier(numTrees=trees, maxDepth=FOREST_DEPTH, minInstancesPerNode=MIN_LEAF, seed=SEED)
    elif algorithm in ("gradient_boosting", "lightgbm", "xgboost"):
        model = GBTClassifier(maxIter=rounds(algorithm), maxDepth=BOOSTED_DEPTH, minInstancesPerNode=MIN_LEAF, seed=SEED)
    else:
        raise ValueError(f"unknown classifier {algorithm}")
    return model.setLabelCol(label).setFeaturesCol("features")


def fit_event_model(train: DataFrame, features: Sequence[str], label: str, trees: int = TREES, algorithm: str = "random_forest") -> PipelineModel | float:
    """Classifier, or the constant class when training rows hold only one."""
    span = train.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if span.lo is None or span.lo == span.hi:
        return float(span.lo or 0.0)
    return fit_pipeline(train, features, classifier(algorithm, label, trees))


def event_probability(model: PipelineModel | float, df: DataFrame, name: str = "event_probability") -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(name, F.lit(model))
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def rain_amount_rows(train: DataFrame, label: str, event: str | None = None) -> DataFrame:
    return cleaning.labelled_rows(train, label, event)


def fit_amount_model(train: DataFrame, features: Sequence[str], label: str, algorithm: str = "random_forest", log1p: bool = True, trees: int = TREES) -> PipelineModel:
    target = F.log1p(F.col(label)) if log1p else F.col(label)
    return fit_pipeline(train.withColumn("_target", target), features, regressor(algorithm, "_target", trees))


def predicted_amount(model: PipelineModel, df: DataFrame, name: str = "amount", log1p: bool = True) -> DataFrame:
    raw = with_prediction(model, df, "_raw")
    value = F.expm1("_raw") if log1p else F.col("_raw")
    return raw.withColumn(name, F.greatest(F.lit(0.0), value)).drop("_raw")


def two_stage_rain(train: DataFrame, test: DataFrame, features: Sequence[str], amount: str, rain_mm: float = 0.1, cut: float = EVENT_CUT, trees: int = TREES,
                   algorithm: str = "random_forest") -> DataFrame:
    """Event classifier at ``rain_mm``, amount regressor on rainy rows, zero otherwise, clipped."""
    marked = train.withColumn("_wet", (F.col(amount) > rain_mm).cast("double"))
    events = fit_event_model(marked, features, "_wet", trees)
    rainy = marked.filter("_wet = 1")
    scored = event_probability(events, test)
    if rainy.limit(1).count() == 0:
        return scored.withColumn("predicted", F.lit(0.0))
    amounts = fit_pipeline(rainy, features, regressor(algorithm, amount, trees))
    both = with_prediction(amounts, scored, "_amount")
    return both.withColumn("predicted", F.when(F.col("event_probability") >= cut, clip(F.col("_amount"), 0.0, RAIN_CAP_MM)).otherwise(0.0)).drop("_amount")


def rain_benchmark(dataset: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], horizons: Sequence[str], algorithms: Sequence[str] = ("random_forest",),
                   trees: int = TREES) -> DataFrame:
    """Event and amount scores per algorithm and horizon on leak-free rain features.

    Each algorithm has its own classifier; its amounts are trained on rainy rows and 0 where no event is expected.
    """
    prepared = prepare(dataset, keys, time, features)

    def one(horizon: str, algorithm: str) -> DataFrame:
        event, amount = f"target_rain_event_{horizon}", f"target_nearby_precipitation_1hr_{horizon}"
        rows = prepared.filter(F.col(event).isNotNull() & F.col(amount).isNotNull())
        train = rows.filter("is_train")
        rainy = train.filter(F.col(amount) > RAINY_MM)
        scored = event_probability(fit_event_model(train, features, event, trees, algorithm), rows.filter("NOT is_train"))
        if rainy.limit(1).count() > 0:
            scored = predicted_amount(fit_amount_model(rainy, features, amount, algorithm, log1p=False, trees=trees), scored, log1p=False)
        else:
            scored = scored.withColumn("amount", F.lit(0.0))
        scored = scored.withColumn("amount", F.when(F.col("event_probability") >= EVENT_CUT, F.col("amount")).otherwise(0.0))
        scored = scored.withColumns({"horizon": F.lit(horizon), "algorithm": F.lit(algorithm)})
        groups = ["algorithm", "horizon"]
        return metrics.event_scores(scored, groups, event, "event_probability").join(
            metrics.anchor_scores(scored, groups, amount, "amount").select(*groups, "mae", "rmse", "r2"), groups
        )

    return reduce(DataFrame.unionByName, side_by_side(dataset.sparkSession, [partial(one, h, a) for h in horizons for a in algorithms]))


# --- ensembles and benchmarks ---------------------------------------------


def stacked(train: DataFrame, test: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], label: str, folds: int = FOLDS, trees: int = STACKED_TREES,
            base: Sequence[str] = ("random_forest", "gradient_boosting")) -> DataFrame:
    """Contiguous-fold out-of-fold predictions of the base models under a ridge head. All base fits run side by side."""
    numbered = number_rows(train, keys, time, total="_n").withColumn("_fold", F.floor((F.col("_rn") - 1) * folds / F.col("_n")).cast("int"))
    table = vectors(numbered, features, [*keys, time, label, "_fold"])

    def one(fold: int | None, name: str):
        rows = table if fold is None else table.filter(F.col("_fold") != fold)
        return regressor(name, label, trees, depth=STACKED_DEPTH).fit(rows)

    fits = [(fold, name) for fold in (*range(folds), None) for name in base]
    models = dict(zip(fits, side_by_side(train.sparkSession, [partial(one, *fit) for fit in fits])))

    def scored(rows: DataFrame, fold: int | None) -> DataFrame:
        for name in base:
            rows = added(models[fold, name], rows, f"_base_{name}")
        return rows.drop("features")

    columns = [f"_base_{name}" for name in base]
    out_of_fold = reduce(DataFrame.unionByName, [scored(table.filter(F.col("_fold") == fold), fold) for fold in range(folds)])
    head = fit_pipeline(out_of_fold, columns, regressor("linear", label))
    held_out = vectors(test, features, test.columns, store=False)
    return with_prediction(head, scored(held_out, None), "predicted").drop(*columns)


def benchmark(dataset: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], label: str, algorithms: Sequence[str], trees: int = TREES) -> DataFrame:
    """Scores of several algorithms on complete rows with an ordered split."""
    complete = chronological(dataset.select(*keys, time, *features, label).dropna(), keys, time)
    table = vectors(complete, features, [*keys, label, "is_train"])

    def one(algorithm: str) -> DataFrame:
        model = regressor(algorithm, label, trees).fit(table.filter("is_train"))
        scored = with_prediction(model, table.filter("NOT is_train"), "predicted").withColumn("algorithm", F.lit(algorithm))
        return metrics.regression_scores(scored, ["algorithm"], label, "predicted")

    return reduce(DataFrame.unionByName, side_by_side(dataset.sparkSession, [partial(one, a) for a in algorithms]))


def importance_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importances of a fitted tree model as a dimension-sized table."""
    values = model.stages[-1].featureImportances.toArray()
    return dimension(spark, [(f, float(x)) for f, x in zip(features, values)], "feature string, importance double")


def top_importance(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def validate_folds(dataset: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], label: str, score, n_splits: int = FOLDS, gap: int = 0,
                   algorithm: str = "random_forest", trees: int = TREES) -> DataFrame:
    """Refit per expanding fold. ``score(truth, predicted)`` returns an aggregate Column.

    Each row tells the folds that it trains or tests in two bit masks, so it is stored once however many folds there are.
    """
    complete = dataset.select(*keys, time, *features, label).dropna()
    table = vectors(labels.fold_masks(complete, keys, time, n_splits, gap=gap), features, [label, "train_folds", "test_folds"])

    def one(fold: int) -> DataFrame:
        taking = {role: table.filter(F.col(f"{role}_folds").bitwiseAND(F.lit(1 << (fold - 1))) != 0) for role in ("train", "test")}
        model = regressor(algorithm, label, trees).fit(taking["train"])
        scored = with_prediction(model, taking["test"], "predicted")
        return scored.agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("test_size"), score(F.col(label), F.col("predicted")).alias("score"))

    out = reduce(DataFrame.unionByName, side_by_side(dataset.sparkSession, [partial(one, fold) for fold in range(1, n_splits + 1)]))
    summary = out.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))
    return attach(out, summary, [])


def staged_ablation(raw: DataFrame, clean: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], label: str, event: str, trees: int = TREES) -> DataFrame:
    """Clean rows, then event-only training, then log1p: a stage is kept if its error drops."""
    spark = raw.sparkSession
    names = ("raw", "clean")
    prepared = dict(zip(names, side_by_side(spark, [partial(prepare, frame, keys, time, features) for frame in (raw, clean)])))

    def error(name: str, event_only: bool, log1p: bool, stage: str) -> DataFrame:
        frame = prepared[name].filter(F.col(label).isNotNull())
        train = rain_amount_rows(frame.filter("is_train"), label, event if event_only else None)
        scored = predicted_amount(fit_amount_model(train, features, label, log1p=log1p, trees=trees), frame.filter("NOT is_train"), log1p=log1p)
        return scored.agg(F.lit(stage).alias("stage"), F.avg(F.abs(F.col("amount") - F.col(label))).alias("mae"))

    stages = [("raw", False, False, "baseline"), ("clean", False, False, "clean"), ("clean", True, False, "event_only"), ("clean", False, True, "log1p")]
    table = reduce(DataFrame.unionByName, side_by_side(spark, [partial(error, *stage) for stage in stages]))
    base = table.filter("stage = 'baseline'").select(F.col("mae").alias("baseline_mae"))
    return attach(table, base, []).withColumn("kept", F.col("mae") < F.col("baseline_mae"))


# --- stored models --------------------------------------------------------


def save_model(model: PipelineModel, fills: DataFrame, path: str) -> None:
    """Pipeline and fills side by side in shared storage. Runs jobs."""
    model.write().overwrite().save(f"{path}/model")
    fills.write.mode("overwrite").parquet(f"{path}/fills")


def score_stored(df: DataFrame, features: Sequence[str], paths: dict[str, str], keep: Sequence[str], clip_range: tuple[float, float] = (0.0, 60.0)) -> DataFrame:
    """Score feature rows with every stored horizon model; null if a horizon is missing."""
    spark = df.sparkSession
    aligned, out = cleaning.align_features(df, features, keep), None
    for horizon, path in paths.items():
        model, fills = PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/fills")
        base = aligned if out is None else out
        scored = with_prediction(model, filled(base, features, fills), f"prediction_{horizon}")
        out = scored.withColumn(f"prediction_{horizon}", clip(F.col(f"prediction_{horizon}"), *clip_range))
    missing = set(HORIZONS) - set(paths)
    return out.withColumn("available", F.lit(not missing))
