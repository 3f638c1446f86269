"""Literal cases of the rules and parsers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skywharf.functions import clock, text, weather, wind
from skywharf.operators import aggregates, cleaning, decisions, labels, ranking
from skywharf.plans.dispatch import extended_windows  # noqa: F401
from skywharf.sources import files, payloads, store

AT = dt.datetime(2024, 7, 1, 12)


def value(spark, column, rows=((1,),), schema="x int"):
    out = [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]
    return out[0] if len(out) == 1 else out


def test_levels(spark):
    speeds = [(7.9,), (8.0,), (10.8,), (13.9,), (17.2,)]
    assert value(spark, wind.wind_speed_level(F.col("x")), speeds, "x double") == ["normal", "watch", "warning", "high_risk", "stop"]
    assert value(spark, wind.wind_gust_level(F.lit(9.7))) == "watch"
    assert value(spark, wind.wind_gust_level(F.lit(9.5))) == "normal"
    assert value(spark, weather.rain_amount_level(F.lit(0.5), 1)) == "無"
    assert value(spark, weather.rain_amount_level(F.lit(200.0), 3)) == "大豪雨"
    assert value(spark, weather.rain_amount_level(F.lit(5.0), 24)) == "not_applicable"
    assert value(spark, wind.beaufort(F.lit(-3.0))) == 0


def test_parsers(spark):
    assert value(spark, wind.beaufort_from_text(F.lit("≥6"))) == 6
    assert value(spark, wind.beaufort_from_text(F.lit("4-5"))) == 4
    assert value(spark, wind.beaufort_from_text(F.lit("5 級"))) == 5
    assert value(spark, wind.beaufort_from_text(F.lit("-"))) is None
    assert str(value(spark, text.meridiem_time(F.lit("2026/6/30 下午 08:35:00")))) == "2026-06-30 20:35:00"
    assert str(value(spark, text.meridiem_time(F.lit("2026/6/30 上午 12:05:00")))) == "2026-06-30 00:05:00"
    parsed = value(spark, text.key_values(F.lit("[WS_AVG]=2.261429,[WD_AVG]=179.9286,[MAX_T]=2026/6/30 08:35:00,bad")))
    assert parsed == {"WS_AVG": "2.261429", "WD_AVG": "179.9286", "MAX_T": "2026/6/30 08:35:00"}
    assert value(spark, text.speed_mps(F.lit(10.0), F.lit("knots"))) == pytest.approx(5.14444)
    assert value(spark, text.speed_mps(F.lit(36.0), F.lit("km/h"))) == 10.0
    assert value(spark, text.length_in(F.lit(1.2), F.lit("m"), "cm")) == pytest.approx(120.0)
    assert value(spark, text.redact_authorization(F.lit("a?Authorization=k&b=1"))) == "a?Authorization=***&b=1"


def test_pop_values(spark):
    rows = [("0",), ("1",), ("35%",), ("120",), ("",), (None,), ("x",)]
    got = value(spark, weather.pop_quality(F.col("x")), rows, "x string")
    assert [g.parse_status for g in got] == ["ok", "ok", "ok", "out_of_range", "missing_field", "not_available", "parse_error"]
    assert [g.normalized_value for g in got[:3]] == [0.0, 1.0, 0.35]


def test_seasons_and_dew_point(spark):
    months = [(dt.datetime(2024, m, 1),) for m in (3, 7, 10, 12)]
    assert value(spark, clock.season(F.col("x")), months, "x timestamp") == ["spring", "summer", "autumn", "winter"]
    assert value(spark, clock.season(F.col("x"), [7]), months, "x timestamp")[1] == "typhoon"
    assert value(spark, weather.dew_point(F.lit(25.0), F.lit(100.0))) == pytest.approx(25.0, abs=1e-3)
    assert value(spark, clock.status_level(F.lit(45), F.lit(75))) == "current"
    assert value(spark, clock.status_level(F.lit(45), F.lit(20))) == "stale"
    assert value(spark, clock.status_level(F.lit(2880), F.lit(20))) == "outage"


def rules(spark, **kw):
    base = {"label": "H1", "p": 0.2, "near": True, "max": 0.0, "mean": 0.0, "has": False, "pop": None} | kw
    columns = [F.lit(base[k]) for k in ("p", "label", "near", "max", "mean", "has")] + [F.lit(base["pop"]).cast("double")]
    adjusted, applied = decisions.rain_rules(*columns)
    return value(spark, F.struct(adjusted.alias("p"), applied.alias("r")))


def test_rain_rules(spark):
    assert rules(spark, max=0.8).p == 0.70
    assert rules(spark, max=3.0, mean=2.5).p == 0.85
    assert rules(spark, max=0.8, label="H3").p == 0.2
    assert rules(spark, p=0.9, has=True, pop=0.05).p == 0.15
    assert rules(spark, label="H4", has=True, pop=0.9).p == pytest.approx(0.72)
    assert rules(spark, max=0.8).r == ["nearby_single_station_trigger"]


def test_pop_prior(spark):
    cases = [("H1", 0.2, 0.8), ("H2", 0.3, 0.8), ("H3", 0.4, 0.8), ("H4", 0.5, 0.9)]
    frame = spark.createDataFrame(cases, "label string, p double, pop double")
    prior, _ = decisions.pop_prior(F.col("p"), F.col("label"), F.lit(True), F.lit("ok"), F.col("pop"))
    assert [round(r[0], 4) for r in frame.select(prior).collect()] == [0.2, 0.3, 0.48, 0.58]


def test_mode_cases(spark):
    base = dict(port_local_model_available=False, port_local_model_accepted=False, dataset_ready=False, port_local_model_trained=False, khwd_realtime_available=True,
                valid_khwd_station_count=6, no_realtime_khwd_mode=False, nearby_cwa_historical_model_available=True, nearby_cwa_historical_model_accepted=True,
                all_nearby_cwa_stations_closer_than_467441=True)
    away = base | dict(khwd_realtime_available=False, valid_khwd_station_count=0, no_realtime_khwd_mode=True)
    model = base | dict(port_local_model_available=True, port_local_model_accepted=True, dataset_ready=True, port_local_model_trained=True)
    frame = spark.createDataFrame([base, away, away | dict(nearby_cwa_historical_model_accepted=False), model]).coalesce(1)
    got = [(r.selected_mode, r.selection_case_id) for r in decisions.select_mode(frame).collect()]
    assert got == [
        ("port_local_postprocess", "KHWD_REALTIME_AVAILABLE_NEARBY_ACCEPTED"), ("nearby_cwa_historical_model", "KHWD_UNAVAILABLE_NEARBY_ACCEPTED"),
        ("fallback_baseline", "KHWD_UNAVAILABLE_NEARBY_REJECTED"), ("port_local_model", "PORT_LOCAL_MODEL_ACCEPTED"),
    ]


def test_cleaning_cases(spark):
    rows = [("a", AT, 0, -9.8, -99.7, 150000.0), ("a", AT, 1, 1.0, 2.0, None), ("a", AT, 2, 1.0, None, None)]
    frame = spark.createDataFrame(rows, "station_id string, obs_time timestamp, seq int, precipitation_1hr double, wind_speed double, visibility double")
    masked = cleaning.mask_ranges(frame).collect()
    assert (masked[0].precipitation_1hr, masked[0].wind_speed, masked[0].visibility) == (None, None, None)
    assert cleaning.deduplicate_fullest(cleaning.mask_ranges(frame), ["station_id", "obs_time"], "seq").first().seq == 1
    with pytest.raises(ValueError):
        cleaning.refuse_forbidden(["wind_speed", "nearby_precip_1"])
    assert cleaning.rain_benchmark_features(["hour_sin", "nearby_wind_speed_station_count", "target_rain_event_H1", "rainy"]) == ["hour_sin", "rainy"]


def test_upstream_and_snapshot(spark):
    rows = [("U1", AT, 5.0, 9.0, 0.0), ("X9", AT, 20.0, 30.0, 1.0)]
    frame = spark.createDataFrame(rows, "station_id string, obs_time timestamp, wind_speed double, wind_gust double, precipitation_1hr double")
    up = aggregates.upstream_lead(frame, ["obs_time"], "obs_time", {"summer": ["U1"]}).first()
    assert (up.upstream_subset_station_count, up.upstream_subset_wind_speed_mean, up.upstream_subset_wind_gust_max) == (1, 5.0, 9.0)
    none = aggregates.upstream_lead(frame, ["obs_time"], "obs_time", {"summer": []}).first()
    assert (none.upstream_subset_station_count, none.upstream_subset_wind_speed_mean) == (0, None)
    latest = spark.createDataFrame([("T", 3.0, 1.0, 0.0), ("A", 2.0, 1.0, 1.0), ("B", 4.0, 1.0, 0.0)], "station_id string, wind_speed double, wind_gust double, precipitation_1hr double")
    snap = aggregates.nearby_snapshot(latest, "T").first()
    assert (snap.nearby_wind_speed_mean, snap.nearby_wind_speed_max, snap.target_wind_speed_minus_nearby_mean, snap.nearby_rainy_station_ratio) == (3.0, 4.0, 0.0, 0.5)


def test_upsert_keeps_first_position(spark):
    schema = "source string, station_id string, device_type string, obs_time timestamp, is_forecast boolean, seq int, wind_speed double, longitude double"
    old = spark.createDataFrame([("s", "a", "W", AT, False, 1, 1.0, 120.1)], schema)
    new = spark.createDataFrame([("s", "a", "W", AT, False, 2, 5.0, 120.9), ("s", "b", "W", AT, False, 3, 7.0, 121.0)], schema)
    got = {r.station_id: (r.wind_speed, r.longitude) for r in store.upsert(old, new, ["seq"]).collect()}
    assert got == {"a": (5.0, 120.1), "b": (7.0, 121.0)}


def test_files_round_trip(spark, tmp_path):
    big5 = tmp_path / "big5"
    big5.mkdir()
    (big5 / "467000_2024.csv").write_bytes("觀測時間(hour),氣溫(℃),WS\n2024-01-01 01:00,21.5,3\n2024-01-01 02:00,99,-1\nbad,1,1\n".encode("cp950"))
    rows = files.load_archive_csv(spark, str(big5), "Big5").orderBy("obs_time").collect()
    assert [(r.station_id, r.temperature, r.wind_speed) for r in rows] == [("467000", 21.5, 3.0), ("467000", None, None)]
    frame = spark.createDataFrame([("a", AT, 1.0), ("a", AT + dt.timedelta(days=1), 2.0)], "station_id string, obs_time timestamp, wind_speed double")
    table = str(tmp_path / "table.parquet")
    files.write_observations(frame, table)
    back = files.load_observations(spark, table, start="2024-07-02 00:00:00")
    assert back.select("wind_speed").collect()[0][0] == 2.0
    files.write_report(frame, str(tmp_path / "report"))
    files.write_report(frame.limit(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    for _ in range(2):
        files.append_metrics(frame, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 4


def test_history_xml_file(spark, tmp_path):
    (tmp_path / "h.xml").write_text(
        "<root><data><Station><StationName>Port</StationName><StationId>P1</StationId><ObsTime><DateTime>2024-07-01T12:00:00+08:00</DateTime></ObsTime>"
        "<GeoInfo><Coordinates><CoordinateName>WGS84</CoordinateName><StationLongitude>120.3</StationLongitude></Coordinates></GeoInfo>"
        "<WeatherElement><WindSpeed>3.2</WindSpeed></WeatherElement></Station></data></root>", encoding="utf-8")
    row = payloads.flatten_history(payloads.read_history_xml(spark, str(tmp_path / "h.xml"))).first()
    assert (row.station_id, row.wind_speed, row.longitude) == ("P1", 3.2, 120.3)


def test_anchor_time_and_ranking(spark):
    schema = "prediction_mode string, port_time timestamp, nearby_time timestamp, fallback_time timestamp, forecast_time timestamp, generated_at timestamp"
    frame = spark.createDataFrame([("port_local_postprocess", AT, None, AT - dt.timedelta(hours=2), None, AT + dt.timedelta(minutes=10))], schema)
    row = decisions.anchor_base_time(frame, {"H1": 30}).first()
    assert (row.anchor_time_source, row.anchor_time_staleness_minutes, row.anchor_time) == ("port_local_khwd", 10, AT + dt.timedelta(minutes=30))
    stations = spark.createDataFrame([("base", 120.43, 22.73), ("near", 120.30, 22.60), ("first", 120.33, 22.65), ("far", 121.0, 23.5)], "station_id string, longitude double, latitude double")
    chosen = ranking.rank_nearby(stations, "base", ["first"], 2).filter("selected").orderBy("rank").collect()
    assert [r.station_id for r in chosen] == ["first", "near"]


def test_dispatch_labels_end_of_series(spark):
    frame = spark.createDataFrame([("a", AT + dt.timedelta(minutes=10 * i), 1.0, 5.0, 6.0) for i in range(5)], "station_id string, obs_time timestamp, precipitation_1hr double, wind_speed double, wind_gust double")
    last = labels.dispatch_labels(frame, ["station_id"], "obs_time").orderBy(F.col("obs_time").desc()).first()
    assert last.rain_event_H1 == 0 and last.future_wind_level_H1 is None


def test_stored_models_score_all_horizons(spark, tmp_path):
    from skywharf.models import training

    rows = [("a", AT + dt.timedelta(hours=i), float(i % 7), float(i % 7) * 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "station_id string, obs_time timestamp, x double, y double")
    prepared = training.prepare(frame, ["station_id"], "obs_time", ["x"])
    model = training.fit_pipeline(prepared.filter("is_train"), ["x"], training.regressor("random_forest", "y", 3))
    training.save_model(model, training.train_fills(prepared, ["x"]), str(tmp_path / "m"))
    out = training.score_stored(frame, ["x"], {"H1": str(tmp_path / "m")}, ["station_id", "obs_time"])
    assert out.filter("prediction_H1 IS NULL").count() == 0
    assert out.first().available is False


def test_panel_texts_of_one_file_are_dealt_out_before_they_are_read(spark):
    texts = [(k, f"KHWD01M01 WS_AVG={k}.5 MAX_T=2024/1/2 下午 3:04:05") for k in range(20)]
    out = payloads.parse_panel_text(spark.createDataFrame(texts, "k long, page string").coalesce(1), "page", ["KHWD01"], "k")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan[plan.index("Generate") :]
    assert {(r["k"], r["wind_speed"], str(r["obs_time"])) for r in out.collect()} == {(k, k + 0.5, "2024-01-02 15:04:05") for k in range(20)}


def test_meridiem_times_at_the_edges(spark):
    told = {
        "2024/1/1 下午 00:00:00": "2024-01-01 12:00:00", "2024-01-02上午12:00:00": "2024-01-02 00:00:00", "2024/01/0110:00:00": "2024-01-01 10:00:00", "2024/1/1 下午 13:00:00": "2024-01-01 13:00:00",
        " 2024/1/1 9:08:07\n": "2024-01-01 09:08:07", "2024/2/31 9:08:07": "None", "2024/1/1 24:00:00": "None", "2024-01-01T10:00:00": "None", "2024/1/1 10:00": "None",
    }
    rows = spark.createDataFrame([(x,) for x in told], "x string").select("x", text.meridiem_time(F.col("x")).alias("t")).collect()
    assert {r["x"]: str(r["t"]) for r in rows} == told
