"""Harmonic tide fits for many stations at once, and surge residuals.

Least squares per station needs only sums of products, so one grouped
aggregation builds the normal equations of every station; a 13 x 13 system
per station is then solved in vectorised batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skywharf.models import training
from skywharf.operators import metrics
from skywharf.plans.timeline import number_rows
from skywharf.schema import TIDAL_PERIODS_HOURS

MIN_ROWS, TRAIN_SHARE = 24, 0.85
SURGE_TREES = 120


def design_columns(hours: Column) -> list[Column]:
    """Intercept and sine/cosine of each constituent."""
    out = [F.lit(1.0)]
    for period in TIDAL_PERIODS_HOURS.values():
        angle = F.lit(2.0 * math.pi) * hours / F.lit(period)
        out += [F.sin(angle), F.cos(angle)]
    return out


TERMS = 1 + 2 * len(TIDAL_PERIODS_HOURS)


def _solve_batch(products: pd.Series, right: pd.Series) -> pd.Series:
    """Solve one small symmetric system per row of an Arrow batch."""
    upper = np.triu_indices(TERMS)

    def one(p, r):
        matrix = np.zeros((TERMS, TERMS))
        matrix[upper] = p
        matrix = matrix + matrix.T - np.diag(np.diag(matrix))
        return np.linalg.lstsq(matrix, np.asarray(r), rcond=None)[0].tolist()

    return pd.Series([one(p, r) for p, r in zip(products, right)])


def fit_harmonic(df: DataFrame, keys: Sequence[str], time: str = "obs_time", value: str = "tide_level", min_rows: int = MIN_ROWS) -> DataFrame:
    """Coefficients and time origin per key with at least ``min_rows`` values."""
    rows = df.filter(F.col(value).isNotNull() & F.col(time).isNotNull())
    origin = rows.groupBy(*keys).agg(F.min(time).alias("origin"))
    hours = (F.col(time).cast("double") - F.col("origin").cast("double")) / 3600.0
    # Design terms become plain columns first, so products reuse them.
    terms = [f"_x{i}" for i in range(TERMS)]
    wide = rows.select(*keys, time, F.col(value).cast("double").alias("_y")).join(origin, list(keys)).select(
        *keys, "origin", "_y", *[c.alias(n) for c, n in zip(design_columns(hours), terms)]
    )
    products = [F.sum(F.col(terms[i]) * F.col(terms[j])) for i in range(TERMS) for j in range(i, TERMS)]
    right = [F.sum(F.col(t) * F.col("_y")) for t in terms]
    sums = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fit_rows"), F.min("origin").alias("origin"), F.array(*products).alias("_p"), F.array(*right).alias("_r")
    ).filter(F.col("fit_rows") >= min_rows)
    solve = F.pandas_udf(_solve_batch, "array<double>")
    return sums.select(*keys, "fit_rows", "origin", solve("_p", "_r").alias("beta"))


def predict_harmonic(df: DataFrame, coefficients: DataFrame, keys: Sequence[str], time: str = "obs_time", name: str = "tide_level_pred") -> DataFrame:
    joined = df.join(coefficients.select(*keys, "origin", "beta"), list(keys))
    hours = (F.col(time).cast("double") - F.col("origin").cast("double")) / 3600.0
    value = sum((F.col("beta")[i] * c for i, c in enumerate(design_columns(hours))), F.lit(0.0))
    return joined.withColumn(name, value).drop("origin", "beta")


def evaluate_harmonic(df: DataFrame, keys: Sequence[str], time: str = "obs_time", value: str = "tide_level", tie: Sequence[str] = ()) -> DataFrame:
    """Fit on the first 85 % of each key's rows, score the rest."""
    rows = number_rows(df.filter(F.col(value).isNotNull()), keys, time, tie, total="_n")
    is_train = F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * TRAIN_SHARE))
    coefficients = fit_harmonic(rows.filter(is_train), keys, time, value)
    predicted = predict_harmonic(rows.filter(~is_train), coefficients, keys, time)
    scores = metrics.anchor_scores(predicted, keys, value, "tide_level_pred").select(*keys, F.col("n").alias("test_rows"), "mae", "rmse", "bias", "r2")
    return scores.join(coefficients.select(*keys, "fit_rows"), list(keys))


def surge_residuals(df: DataFrame, keys: Sequence[str], time: str = "obs_time", value: str = "tide_level") -> DataFrame:
    """Observed minus harmonic tide."""
    predicted = predict_harmonic(df, fit_harmonic(df, keys, time, value), keys, time)
    return predicted.withColumn("surge_residual", F.col(value) - F.col("tide_level_pred"))


def surge_model(df: DataFrame, keys: Sequence[str], time: str, features: Sequence[str], value: str = "tide_level", trees: int = SURGE_TREES) -> DataFrame:
    """Forest on the residual; total tide = harmonic + predicted residual, scored on held-out rows."""
    residual = surge_residuals(df.filter(F.col(value).isNotNull()), keys, time, value)
    prepared = training.prepare(residual, keys, time, features)
    model = training.fit_pipeline(prepared.filter("is_train"), features, training.regressor("random_forest", "surge_residual", trees))
    scored = training.with_prediction(model, prepared.filter("NOT is_train"), "predicted_residual").withColumn(
        "predicted_tide", F.col("tide_level_pred") + F.col("predicted_residual")
    )
    tide = metrics.anchor_scores(scored.withColumn("quantity", F.lit("tide")), ["quantity"], value, "predicted_tide")
    rest = metrics.anchor_scores(scored.withColumn("quantity", F.lit("residual")), ["quantity"], "surge_residual", "predicted_residual")
    return tide.unionByName(rest)
