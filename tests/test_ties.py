"""Ties, long records, repeated periods and rows per hour on literal rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skywharf.operators import features, joins, ranking
from skywharf.sources import payloads


def test_first_of_equal_candidates_wins(spark):
    rows = [("d", "b", "L", "e", "3h", 1, 5, 0, 4, 2), ("d", "a", "L", "e", "3h", 1, 5, 0, 4, 1), ("d", "c", "L", "e", "3h", 1, 5, 0, 0, 0)]
    names = "day string, dataset_id string, location_name string, element_name string, source_resolution string, dataset_priority int, location_index int, element_index int, record_count int, candidate_index int"
    for k in (1, 2, 3):
        assert ranking.best_source(spark.createDataFrame(rows[k:] + rows[:k], names), ["day"]).first()["dataset_id"] == "a"


def test_first_archive_row_of_a_time_wins(spark):
    def row(speed):
        return {"DataTime": "2024-01-01T05:00:00", "WindSpeed": {"Mean": speed}}

    body = json.dumps({"data": [{"dts": [row("1.5"), row("2.5")]}, {"dts": [row("3.5")]}]})
    assert [r["wind_speed"] for r in payloads.flatten_climate_archive(spark.createDataFrame([("S", body)], "station_id string, body string"), "body", "station_id").collect()] == [1.5]


def test_panel_records_of_any_length_and_ties(spark):
    text = f"KHWD01 {'. ' * 900} WS_AVG=4.5 WS_MAX=7.5 2024/01/01 10:00:00 KHWD01 WS_AVG=9.5 WS_MAX=9.5 2024/01/01 10:00:00"
    row = payloads.parse_panel_text(spark.createDataFrame([(text,)], "page string"), "page", ["KHWD01"]).first()
    assert row["wind_speed"] == 4.5 and row["wind_gust"] == 7.5


def test_last_item_of_a_repeated_period_wins(spark):
    def item(**value):
        return {"StartTime": "2024-01-01T00:00:00", "EndTime": "2024-01-01T03:00:00", "ElementValue": [value]}

    elements = [{"ElementName": "PoP3h", "Time": [item(PoP3h="9"), item(PoP3h="70"), item(PoP3h="-")]}, {"ElementName": "風速", "Time": [item(WindSpeed="9", BeaufortScale="5"), item(WindSpeed="3")]}]
    body = json.dumps({"records": {"Locations": [{"Location": [{"LocationName": "L", "WeatherElement": elements}]}]}})
    row = payloads.flatten_forecast(spark.createDataFrame([(body,)], "body string"), "body").collect()
    assert len(row) == 1 and (row[0]["raw_value"], row[0]["pop"], row[0]["wind_speed_text"], row[0]["wind_speed_mps"], row[0]["beaufort_scale_text"]) == ("70", 0.7, "3", 3.0, None)


def test_only_the_last_row_gets_attached_features(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("S", at, 1), ("S", at, 2), ("S", at - dt.timedelta(hours=1), 3)], "station_id string, obs_time timestamp, seq int")
    extra = spark.createDataFrame([("S", 4.0)], "station_id string, rain double")
    assert {r["seq"]: r["rain"] for r in joins.attach_to_latest(rows, extra, "station_id", "obs_time", ["rain"], tie=["seq"]).collect()} == {1: 0.0, 2: 4.0, 3: 0.0}


@pytest.mark.parametrize("minutes,lag", [(60, 1), (30, 2), (10, 6)])
def test_an_hour_back_at_the_own_rate(spark, minutes, lag):
    start = dt.datetime(2024, 1, 1)
    rows = [("S", start + dt.timedelta(minutes=minutes * k), float(k)) for k in range(40)] + [("T", start + dt.timedelta(minutes=30 * k), float(k)) for k in range(40)]
    series = spark.createDataFrame(rows, "station_id string, obs_time timestamp, v double")
    out = features.hourly_features(series, ["station_id"], "obs_time", lambda n: [features.lags(["v"], (1,), n), features.rolling(["v"], {"3h": 3}, ["sum"], n)])
    got = {(r["station_id"], r["v"]): (r["v_lag_1h"], r["v_roll_3h_sum"]) for r in out.select("station_id", "v", F.col("v_lag_1h"), "v_roll_3h_sum").collect()}
    for k in range(20, 40):
        assert got["S", k] == (k - lag, sum(range(k - 3 * lag + 1, k + 1))) and got["T", k] == (k - 2, sum(range(k - 5, k + 1)))
