"""Forecast quality: errors, contingency tables, skill, grades, sweeps.

Inputs are long tables with one row per forecast; each score is one grouped
aggregation over (groups), with exact order statistics where needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.plans.dims import dimension, lookup
from skywharf.plans.ranks import attach, bordered, cumulative_counts, exact_quantiles
from skywharf.schema import GRADE_CUTOFFS

MAPE_EPSILON = 1e-10


def finite_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows where both values are finite numbers."""
    def finite(name: str) -> Column:
        value = F.col(name)
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))

    return df.filter(finite(truth) & finite(predicted))


def error_aggs(truth: str, predicted: str) -> dict[str, Column]:
    """RMSE, MAE, R², MAPE (ε in the denominator), bias, count."""
    y, diff = F.col(truth), F.col(predicted) - F.col(truth)
    total_variation = F.var_pop(y) * F.count(y)
    return {
        "n": F.count(y),
        "rmse": F.sqrt(F.avg(diff * diff)),
        "mae": F.avg(F.abs(diff)),
        "r2": F.when(total_variation > 0, F.lit(1.0) - F.sum(diff * diff) / total_variation),
        "mape": F.avg(F.abs(diff / (y + MAPE_EPSILON))) * 100,
        "bias": F.avg(diff),
    }


def regression_scores(df: DataFrame, groups: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """All scalar errors plus the exact median absolute error."""
    pairs = finite_pairs(df, truth, predicted)
    scores = pairs.groupBy(*groups).agg(*[c.alias(n) for n, c in error_aggs(truth, predicted).items()])
    errors = pairs.select(*groups, F.abs(F.col(predicted) - F.col(truth)).alias("_error"))
    return attach(scores, exact_quantiles(errors, groups, "_error", {"medae": 0.5}), groups)


def anchor_scores(df: DataFrame, groups: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Errors per anchor; MAPE only over non-zero truths."""
    aggs = error_aggs(truth, predicted)
    y, diff = F.col(truth), F.col(predicted) - F.col(truth)
    aggs["mape"] = F.avg(F.when(F.abs(y) > 1e-9, F.abs(diff / y))) * 100
    return finite_pairs(df, truth, predicted).groupBy(*groups).agg(*[c.alias(n) for n, c in aggs.items()])


ERROR_QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


def error_quantiles(df: DataFrame, groups: Sequence[str], truth: str, predicted: str) -> DataFrame:
    errors = finite_pairs(df, truth, predicted).select(*groups, F.abs(F.col(predicted) - F.col(truth)).alias("_error"))
    return exact_quantiles(errors, groups, "_error", ERROR_QUANTILES)


def skill_score(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, baseline: str) -> DataFrame:
    """1 - MSE / baseline MSE; null when the baseline is perfect."""
    pairs = finite_pairs(finite_pairs(df, truth, predicted), truth, baseline)
    model, base = F.avg(F.pow(F.col(truth) - F.col(predicted), 2)), F.avg(F.pow(F.col(truth) - F.col(baseline), 2))
    return pairs.groupBy(*groups).agg(F.when(base > 0, 1.0 - model / base).alias("skill_score"))


# --- contingency ----------------------------------------------------------


def contingency_counts(event: Column, forecast: Column, weight: Column | None = None) -> dict[str, Column]:
    """Hits, misses, false alarms, correct negatives; optionally of weighted rows."""
    def count(condition: Column) -> Column:
        return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))

    return {
        "hits": count(event & forecast), "misses": count(event & ~forecast),
        "false_alarms": count(~event & forecast), "correct_negatives": count(~event & ~forecast),
    }


def contingency_scores() -> dict[str, Column]:
    """Scores from the four count columns; an empty denominator gives null."""
    h, m, f, c = (F.col(n).cast("double") for n in ("hits", "misses", "false_alarms", "correct_negatives"))
    total = h + m + f + c
    expected = F.try_divide((h + m) * (h + f) + (c + m) * (c + f), total)
    by_chance = F.try_divide((h + m) * (h + f), total)
    return {
        "pod": F.try_divide(h, h + m), "far": F.try_divide(f, h + f), "csi": F.try_divide(h, h + m + f),
        "hss": F.try_divide(h + c - expected, total - expected), "ets": F.try_divide(h - by_chance, h + m + f - by_chance),
        "accuracy": F.try_divide(h + c, total), "bias_score": F.try_divide(h + f, h + m),
    }


def rain_scores(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, threshold: float = 0.1) -> DataFrame:
    """Scores of reaching (>=) the threshold."""
    counts = contingency_counts(F.col(truth) >= threshold, F.col(predicted) >= threshold)
    counted = finite_pairs(df, truth, predicted).groupBy(*groups).agg(*[c.alias(n) for n, c in counts.items()])
    return counted.withColumns(contingency_scores())


INTENSITY_THRESHOLDS = [0.1, 2.0, 10.0, 30.0]


def intensity_scores(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, thresholds: Sequence[float] = INTENSITY_THRESHOLDS) -> DataFrame:
    """``rain_scores`` at several thresholds from one scan.

    Rows are first counted by how many thresholds truth and forecast reach;
    only that small table is repeated per threshold.
    """
    ordered = sorted(thresholds)

    def reached(name: str) -> Column:
        return sum((F.when(F.col(name) >= t, 1).otherwise(0) for t in ordered), F.lit(0))

    small = finite_pairs(df, truth, predicted).groupBy(*groups, reached(truth).alias("_t"), reached(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ordered)])
    spread = small.withColumn("_s", F.explode(steps)).withColumn("threshold", F.col("_s.threshold"))
    counts = contingency_counts(F.col("_t") >= F.col("_s.rank"), F.col("_p") >= F.col("_s.rank"), F.col("_n"))
    return spread.groupBy(*groups, "threshold").agg(*[c.alias(n) for n, c in counts.items()]).withColumns(contingency_scores())


def categorical_rain(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, main: float = 1.0, heavy: float = 10.0) -> DataFrame:
    """Strictly-above (>) variant at two thresholds, with the error on rainy rows."""
    aggs = []
    for name, t in (("1mm", main), ("10mm", heavy)):
        y, p = F.col(truth) > t, F.col(predicted) > t
        aggs += [F.count_if(y & p).alias(f"tp_{name}"), F.count_if(~y & p).alias(f"fp_{name}"), F.count_if(y & ~p).alias(f"fn_{name}")]
    aggs.append(F.avg(F.when(F.col(truth) > main, F.abs(F.col(predicted) - F.col(truth)))).alias("mae_rain_only"))
    counted = finite_pairs(df, truth, predicted).groupBy(*groups).agg(*aggs)
    out = {}
    for name in ("1mm", "10mm"):
        tp, fp, fn = (F.col(f"{k}_{name}").cast("double") for k in ("tp", "fp", "fn"))
        out |= {f"csi_{name}": F.try_divide(tp, tp + fp + fn), f"far_{name}": F.try_divide(fp, tp + fp), f"pod_{name}": F.try_divide(tp, tp + fn)}
    return counted.withColumns(out)


def extreme_scores(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, percentile: float = 90) -> DataFrame:
    """Errors and capture rate above the truth's percentile."""
    pairs = finite_pairs(df, truth, predicted)
    cutoff = exact_quantiles(pairs, groups, truth, {"extreme_threshold": percentile / 100.0})
    joined = attach(pairs, cutoff, groups)
    above = F.col(truth) >= F.col("extreme_threshold")
    diff = F.when(above, F.col(predicted) - F.col(truth))
    captured = F.count_if(above & (F.col(predicted) >= F.col("extreme_threshold")))
    return joined.groupBy(*groups).agg(
        F.max("extreme_threshold").alias("extreme_threshold"), F.count_if(above).alias("extreme_count"),
        F.avg(F.abs(diff)).alias("extreme_mae"), F.sqrt(F.avg(diff * diff)).alias("extreme_rmse"), F.avg(diff).alias("extreme_bias"),
        F.try_divide(captured, F.count_if(above)).alias("extreme_capture_rate"),
    )


def scenario_scores(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, external: str, rain_threshold: float | None = None) -> DataFrame:
    """Model and external forecast per slice: all, high (>= q90), low (<= q10), rainy, dry."""
    pairs = finite_pairs(df, truth, predicted)
    cut = exact_quantiles(pairs, groups, truth, {"_q10": 0.1, "_q90": 0.9})
    joined = attach(pairs, cut, groups)
    y = F.col(truth)
    slices = [F.lit("all"), F.when(y >= F.col("_q90"), F.lit("high")), F.when(y <= F.col("_q10"), F.lit("low"))]
    if rain_threshold is not None:
        slices += [F.when(y >= rain_threshold, F.lit("rainy")), F.when(y < rain_threshold, F.lit("dry"))]
    model_error, external_error = F.abs(F.col(predicted) - y), F.abs(F.col(external) - y)
    spread = joined.withColumn("scenario", F.explode(F.array_compact(F.array(*slices))))
    scored = spread.groupBy(*groups, "scenario").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(model_error).alias("model_mae"), F.avg(external_error).alias("external_mae"),
        F.sqrt(F.avg(model_error * model_error)).alias("model_rmse"),
    )
    return scored.withColumn("model_beats_external", F.coalesce(F.col("model_mae") < F.col("external_mae"), F.lit(False)))


# --- probabilities --------------------------------------------------------

def event_scores(df: DataFrame, groups: Sequence[str], label: str, probability: str, cut: float = 0.5) -> DataFrame:
    """Brier score, exact AUC with ties, and event scores at the cut.

    AUC sums, over distinct probabilities, positives times the negatives
    ranked below plus half of those tied; probabilities are pre-counted, then
    ordered inside buckets of a quantile sketch, however they crowd, so no group is sorted in one task.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(probability).isNotNull())
    y, p = F.col(label).cast("double"), F.col(probability)
    counts = contingency_counts(F.col(label) == 1, p >= cut)
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - y, 2)).alias("brier"), *[c.alias(n) for n, c in counts.items()]
    )
    tied = rows.groupBy(*groups, p.alias("_p")).agg(F.sum(y).alias("pos"), F.sum(1.0 - y).alias("neg"))
    ranked = cumulative_counts(bordered(tied, groups, "_p", "neg"), groups, "_p", ["neg"])
    areas = ranked.groupBy(*groups).agg(
        F.try_divide(
            F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")
        ).alias("auc")
    )
    h, m, f = (F.col(n).cast("double") for n in ("hits", "misses", "false_alarms"))
    return attach(base, areas, groups).withColumns(
        {
            "csi": F.try_divide(h, h + m + f), "far": F.try_divide(f, h + f), "pod": F.try_divide(h, h + m),
            "precision": F.coalesce(F.try_divide(h, h + f), F.lit(0.0)), "recall": F.coalesce(F.try_divide(h, h + m), F.lit(0.0)),
        }
    )


def persistence_comparison(df: DataFrame, groups: Sequence[str], truth: str, predicted: str, persistence: str, fallback: str | None = None) -> DataFrame:
    """Model and persistence errors, with the strict and the lenient 'beats' rule.

    A missing persistence value falls back to a given column, such as the
    training mean of the label.
    """
    base = F.coalesce(F.col(persistence), F.col(fallback)) if fallback else F.col(persistence)
    rows = finite_pairs(df, truth, predicted).withColumn("_base", base)
    scored = rows.groupBy(*groups).agg(
        F.avg(F.abs(F.col(predicted) - F.col(truth))).alias("mae"), F.avg(F.abs(F.col("_base") - F.col(truth))).alias("persistence_mae")
    )
    return scored.withColumns(
        {"beats_persistence": F.col("mae") < F.col("persistence_mae"), "matches_persistence": F.col("mae") <= F.col("persistence_mae")}
    )


# --- grades and tables ----------------------------------------------------

GRADES = ["excellent", "acceptable", "poor"]


def grade_rules(spark) -> DataFrame:
    rows = [
        (variable, metric, label, float(cut[0]), float(cut[1]), metric == "r2" or metric.startswith("csi"))
        for variable, metrics in GRADE_CUTOFFS.items() for metric, anchors in metrics.items() for label, cut in anchors.items()
    ]
    return dimension(spark, rows, "variable string, metric string, label string, excellent double, acceptable double, higher_is_better boolean")


def accuracy_grades(metrics: DataFrame) -> DataFrame:
    """Grade per (variable, label) of a long metric table: the worst metric decides."""
    rules = grade_rules(metrics.sparkSession)
    v = F.col("value")
    good = F.when(F.col("higher_is_better"), v >= F.col("excellent")).otherwise(v <= F.col("excellent"))
    fair = F.when(F.col("higher_is_better"), v >= F.col("acceptable")).otherwise(v <= F.col("acceptable"))
    worst = F.max(F.when(v.isNull() | F.col("excellent").isNull(), None).when(good, 0).when(fair, 1).otherwise(2))
    graded = metrics.join(rules, ["variable", "metric", "label"], "left").groupBy("variable", "label").agg(worst.alias("_worst"))
    return graded.select("variable", "label", lookup(dict(enumerate(GRADES)), F.coalesce("_worst", F.lit(1))).alias("accuracy_grade"))


def combined_grade(grades: DataFrame) -> DataFrame:
    """Worst grade over the variables of each label."""
    rank = lookup({g: i for i, g in enumerate(GRADES)}, F.col("accuracy_grade"))
    worst = grades.groupBy("label").agg(F.max(rank).alias("_w"))
    return worst.select("label", lookup(dict(enumerate(GRADES)), F.col("_w")).alias("combined_grade"))


def mae_grade(mae: Column) -> Column:
    return F.when(mae <= 1.0, "excellent").when(mae <= 2.0, "good").when(mae <= 3.0, "acceptable").when(mae.isNotNull(), "poor")


SWEEP_THRESHOLDS = [round(0.25 + 0.05 * i, 2) for i in range(13)]
SWEEP_FAR_LIMIT = 0.55


def threshold_sweep(df: DataFrame, groups: Sequence[str], label: str, truth: str, amount: str, probability: str, rain_mm: float = 1.0) -> DataFrame:
    """Rain scores per inference threshold and anchor, plus the mean line.

    A forecast counts as rain when its probability exceeds the threshold and
    its amount exceeds the rain limit. The scan counts rows by the number of
    thresholds passed; only that table is repeated per threshold.
    """
    passed = sum((F.when(F.col(probability) > t, 1).otherwise(0) for t in SWEEP_THRESHOLDS), F.lit(0))
    effective = F.when(F.col(amount) > rain_mm, passed).otherwise(0)
    small = df.groupBy(*groups, label, (F.col(truth) > rain_mm).alias("_event"), effective.alias("_passed")).agg(F.count(F.lit(1)).alias("_n"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(t).alias("threshold")) for i, t in enumerate(SWEEP_THRESHOLDS)])
    spread = small.withColumn("_s", F.explode(steps))
    rain = F.col("_passed") >= F.col("_s.rank")
    n = F.col("_n")
    zero = F.lit(0)
    per_anchor = spread.groupBy(*groups, F.col("_s.threshold").alias("threshold"), F.col(label).alias("anchor")).agg(
        F.coalesce(F.sum(F.when(F.col("_event") & rain, n)), zero).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("_event") & rain, n)), zero).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("_event") & ~rain, n)), zero).alias("fn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    scored = per_anchor.withColumns(
        {"csi": F.try_divide(tp, tp + fp + fn), "far": F.try_divide(fp, tp + fp), "pod": F.try_divide(tp, tp + fn)}
    )
    defined = F.col("csi").isNotNull()
    mean = scored.groupBy(*groups, "threshold").agg(
        F.lit("mean").alias("anchor"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        *[F.avg(F.when(defined, F.col(c))).alias(c) for c in ("csi", "far", "pod")],
    )
    return scored.unionByName(mean)


def best_threshold(sweep: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Highest mean CSI among thresholds with FAR under the limit, else overall."""
    mean = sweep.filter("anchor = 'mean'")
    row = F.struct("threshold", "csi", "far")
    rank = F.struct(F.col("csi"), (-F.col("threshold")).alias("t"))
    allowed = (F.coalesce("far", F.lit(1.0)) < SWEEP_FAR_LIMIT) & F.col("csi").isNotNull()
    best = F.coalesce(F.max_by(row, F.when(allowed, rank)), F.max_by(row, F.when(F.col("csi").isNotNull(), rank)))
    return mean.groupBy(*groups).agg(best.alias("_b")).select(
        *groups, F.col("_b.threshold").alias("best_threshold"), F.col("_b.csi").alias("best_csi_mean"), F.col("_b.far").alias("best_far_mean")
    )


# Metric that decides whether an ablation improved a target.
PRIMARY_METRIC = {"wind_speed": "MAE", "wind_gust": "MAE", "rain_probability": "AUC", "precipitation_amount": "MAE"}


def metric_deltas(baseline: DataFrame, changed: DataFrame) -> DataFrame:
    """Change per (target, horizon, metric) at 4 places, and improvement by the primary metric."""
    keys = ["target", "horizon", "metric"]
    joined = baseline.select(*keys, F.col("value").alias("_old")).join(changed.select(*keys, F.col("value").alias("_new")), keys)
    delta = F.round(F.col("_new") - F.col("_old"), 4)
    primary = lookup(PRIMARY_METRIC, F.col("target"), "MAE") == F.col("metric")
    better = F.when(F.col("metric") == "AUC", F.col("_new") > F.col("_old")).otherwise(F.col("_new") < F.col("_old"))
    return joined.select(*keys, delta.alias("delta"), F.when(primary, better).alias("improved_by_primary_metric"))


def basic_statistics(df: DataFrame, groups: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Count, mean, deviation and range of both series with error percentiles."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, column in (("actual", truth), ("predicted", predicted)):
        aggs += [F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std"), F.min(column).alias(f"{name}_min"), F.max(column).alias(f"{name}_max")]
    aggs.append(F.avg(F.col(predicted) - F.col(truth)).alias("mean_error"))
    errors = df.select(*groups, F.abs(F.col(predicted) - F.col(truth)).alias("_error"))
    spread = exact_quantiles(errors, groups, "_error", {"median_abs_error": 0.5, "p90_abs_error": 0.9})
    return df.groupBy(*groups).agg(*aggs).transform(attach, spread, groups)


def metrics_by_horizon(metrics: DataFrame, groups: Sequence[str], names: Sequence[str] = ("csi", "pod", "far")) -> DataFrame:
    """Chosen metrics as columns per horizon; available when H1 has all of them."""
    wide = metrics.groupBy(*groups, "horizon").agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    h1 = wide.groupBy(*groups).agg(F.coalesce(F.bool_or((F.col("horizon") == "H1") & complete), F.lit(False)).alias("available"))
    return attach(wide, h1, groups)


def imbalance_weights(df: DataFrame, groups: Sequence[str], amount: str, threshold: float = 0.1) -> DataFrame:
    """Weight n_dry / max(n_rain, 1) for rain rows, 1 for dry rows."""
    wet = F.col(amount) > threshold
    counts = df.groupBy(*groups).agg(F.count_if(wet).alias("_wet"), F.count_if(~wet).alias("_dry"))
    return attach(df, counts, groups).withColumn(
        "weight", F.when(wet, F.col("_dry") / F.greatest(F.col("_wet"), F.lit(1))).otherwise(1.0)
    ).drop("_wet", "_dry")
