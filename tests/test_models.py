"""Trained models by error band, and tide coefficients by value."""

import datetime as dt
import inspect
import math
import random
import threading

import numpy as np
import pytest

from skywharf.models import tide, training
from skywharf.models.fits import side_by_side, vectors
from skywharf.operators import labels
from skywharf.schema import TIDAL_PERIODS_HOURS

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1200):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        rows.append(("A", START + dt.timedelta(hours=k), x, None if k % 50 == 0 else y, 2 * x + math.sin(y) + rng.gauss(0, 0.1), 2 * x, float(x > 5)))
    return spark.createDataFrame(rows, "target_area string, obs_time timestamp, x double, y double, label double, last double, event double")


@pytest.mark.parametrize("algorithm", ["random_forest", "gradient_boosting", "linear"])
def test_regressors_beat_the_mean_and_follow_the_function(spark, series, algorithm):
    _, held_out = training.train_regressors(series, ["target_area"], "obs_time", ["x", "y"], {"H1": "label"}, "last", algorithm)
    rows = held_out.collect()
    assert len(rows) == 240 and min(r["obs_time"] for r in rows) == START + dt.timedelta(hours=960)
    truth, predicted = np.array([r["truth"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert 1 - ((truth - predicted) ** 2).sum() / ((truth - truth.mean()) ** 2).sum() > 0.9
    assert np.isclose(rows[0]["train_mean"], np.mean([r["label"] for r in series.orderBy("obs_time").limit(960).collect()]))


def test_event_model_ranks_events(spark, series):
    rows = training.prepare(series, ["target_area"], "obs_time", ["x", "y"])
    scored = training.event_probability(training.fit_event_model(rows.filter("is_train"), ["x", "y"], "event"), rows.filter("NOT is_train")).collect()
    assert min(r["event_probability"] for r in scored if r["event"] == 1 and r["x"] > 6) > max(r["event_probability"] for r in scored if r["event"] == 0 and r["x"] < 4)


def test_stored_models_score_every_row(spark, series, tmp_path):
    rows = training.chronological(series, ["target_area"], "obs_time").filter("is_train")
    fills = training.train_fills(rows, ["x", "y"])
    paths = {h: str(tmp_path / h) for h in ("H1", "H2", "H3", "H4")}
    for path in paths.values():
        training.save_model(training.fit_pipeline(training.filled(rows, ["x", "y"], fills), ["x", "y"], training.regressor("linear", "label")), fills, path)
    out = training.score_stored(series, ["x", "y"], paths, ["target_area", "obs_time"]).collect()
    assert len(out) == 1200 and all(r["available"] and r["prediction_H1"] == r["prediction_H4"] is not None for r in out)


def test_tide_fit_equals_least_squares(spark):
    """The harmonic fit against NumPy's least squares on the same constituents."""
    rng = random.Random(4)
    times = [START + dt.timedelta(hours=k) for k in range(600)]
    levels = [1.5 + 0.8 * math.cos(2 * math.pi * k / 12.4206) + 0.3 * math.sin(2 * math.pi * k / 23.9345) + rng.gauss(0, 0.05) for k in range(600)]
    frame = spark.createDataFrame([("P", t, k, v) for k, (t, v) in enumerate(zip(times, levels))], "station_id string, obs_time timestamp, seq long, tide_level double")
    fit = tide.fit_harmonic(frame, ["station_id"]).first()
    hours = np.arange(600.0)
    design = np.column_stack([np.ones(600), *[f(2 * math.pi * hours / p) for p in TIDAL_PERIODS_HOURS.values() for f in (np.sin, np.cos)]])
    expected = np.linalg.lstsq(design, np.array(levels), rcond=None)[0]
    np.testing.assert_allclose(fit["beta"], expected, rtol=1e-6, atol=1e-6)
    row = tide.evaluate_harmonic(frame, ["station_id"], tie=["seq"]).first()
    assert row["r2"] > 0.98 and row["mae"] < 0.06 and abs(row["bias"]) < 0.02


def test_rain_benchmark_has_a_classifier_for_each_algorithm_and_gates_amounts(spark):
    """Both algorithms score events on their own, and dry hours get an amount of 0."""
    rng = random.Random(6)
    rows = []
    for k in range(600):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        wet = x > 7
        rows.append(("A", START + dt.timedelta(hours=k), x, y, float(wet != (rng.random() < 0.1)), 10.0 + x if wet else 0.0))
    frame = spark.createDataFrame(rows, "target_area string, obs_time timestamp, x double, y double, target_rain_event_H1 double, target_nearby_precipitation_1hr_H1 double")
    out = {r["algorithm"]: r for r in training.rain_benchmark(frame, ["target_area"], "obs_time", ["x", "y"], ["H1"], ["random_forest", "gradient_boosting"]).collect()}
    assert out["random_forest"]["brier"] != out["gradient_boosting"]["brier"]
    assert all(r["mae"] < 1.5 and r["r2"] > 0.8 for r in out.values())


def test_rain_amounts_are_zero_where_no_event_is_expected(spark):
    """No event in training: every amount is 0, so the error is the mean of the truth."""
    rows = [("A", START + dt.timedelta(hours=k), float(k % 7), 0.0, float(k % 3)) for k in range(200)]
    frame = spark.createDataFrame(rows, "target_area string, obs_time timestamp, x double, target_rain_event_H1 double, target_nearby_precipitation_1hr_H1 double")
    row = training.rain_benchmark(frame, ["target_area"], "obs_time", ["x"], ["H1"]).first()
    truth = [k % 3 for k in range(160, 200)]
    assert math.isclose(row["mae"], sum(truth) / len(truth), rel_tol=1e-3)


def test_fold_masks_are_the_folds_without_copies(spark):
    rows = [(key, START + dt.timedelta(hours=k)) for key, count in (("A", 37), ("B", 11), ("C", 3)) for k in range(count)]
    frame = spark.createDataFrame(rows, "target_area string, obs_time timestamp")
    masks = labels.fold_masks(frame, ["target_area"], "obs_time", 4, gap=2).collect()
    assert len(masks) == len(rows)
    got = {(r["target_area"], r["obs_time"], k + 1, role) for r in masks for role in ("train", "test") for k in range(4) if r[f"{role}_folds"] >> k & 1}
    copies = labels.expanding_folds(frame, ["target_area"], "obs_time", 4, gap=2).collect()
    assert got == {(r["target_area"], r["obs_time"], r["fold"], r["role"]) for r in copies} and len(copies) == len(got) > len(rows)


def test_fits_run_side_by_side_in_order_and_raise(spark):
    started = threading.Barrier(3, timeout=60)
    assert side_by_side(spark, [lambda k=k: (started.wait(), spark.range(k).count())[1] for k in (3, 1, 2)]) == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_stacking_equals_its_parts(spark, series):
    """Out-of-fold predictions of linear base models, computed one after another, give the same head."""
    rows = training.prepare(series, ["target_area"], "obs_time", ["x", "y"])
    out = training.stacked(rows.filter("is_train"), rows.filter("NOT is_train"), ["target_area"], "obs_time", ["x", "y"], "label", folds=3, trees=5, base=("linear", "random_forest")).collect()
    assert len(out) == 240 and rows.columns == [c for c in out[0].asDict() if c != "predicted"]
    truth, predicted = np.array([r["label"] for r in out]), np.array([r["predicted"] for r in out])
    assert 1 - ((truth - predicted) ** 2).sum() / ((truth - truth.mean()) ** 2).sum() > 0.9


def test_vectors_have_parts_by_size(spark, series):
    table = vectors(training.prepare(series, ["target_area"], "obs_time", ["x", "y"]).repartition(6), ["x", "y"], ["label"])
    assert table.rdd.getNumPartitions() == 1 and table.columns == ["label", "features"] and table.count() == 1200


def test_models_have_the_sizes_of_the_reference(spark):
    def default(function, name):
        return inspect.signature(function).parameters[name].default

    assert (default(training.stacked, "folds"), default(training.stacked, "trees")) == (5, 50)
    assert (default(training.validate_folds, "n_splits"), default(training.validate_folds, "trees")) == (5, training.TREES)
    assert (default(training.staged_ablation, "trees"), default(tide.surge_model, "trees")) == (training.TREES, 120)
    assert training.regressor("gradient_boosting", "label").getMaxIter() == 100 and training.regressor("random_forest", "label", depth=8).getMaxDepth() == 8
    assert training.classifier("gradient_boosting", "event").getMaxIter() == 100
