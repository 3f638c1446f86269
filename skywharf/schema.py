"""Record schemas and the fixed tables that results depend on."""

from __future__ import annotations

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

KEY_COLUMNS = ["source", "station_id", "device_type", "obs_time", "is_forecast"]

MEASURES = [
    "wind_speed", "wind_gust", "wind_direction", "wind_gust_direction",
    "precipitation_10min", "precipitation_1hr", "precipitation_24hr",
    "air_temperature", "relative_humidity", "air_pressure", "visibility",
    "tide_level", "wave_height", "wave_period", "wave_max_height",
    "current_speed", "current_direction",
]

# Columns an upsert overwrites, and columns that keep their first-seen value.
UPSERT_REPLACED = ["station_name", "location", *MEASURES, "raw_data", "raw_last_data_str",
                   "confidence", "stale", "fetched_at"]
UPSERT_KEPT = ["port_code", "longitude", "latitude", "elevation", "tide_level_unit"]

# Column aliases accepted by the observation reader.
OBSERVATION_ALIASES = {
    "wind_speed_mps": "wind_speed",
    "wind_gust_mps": "wind_gust",
    "wind_direction_deg": "wind_direction",
    "precipitation_1hr_mm": "precipitation_1hr",
    "visibility_m": "visibility",
    "qpe_1hr": "qpe_1hr_mm",
    "qpe_3hr": "qpe_3hr_mm",
}

# Column names of historical archives, in English and Chinese.
ARCHIVE_COLUMNS = {
    "WS": "wind_speed",
    "WD": "wind_direction",
    "WSGust": "wind_gust",
    "WDGust": "wind_gust_direction",
    "Precp": "precipitation_1hr",
    "PrecpHour": "precipitation_1hr",
    "RH": "relative_humidity",
    "Tx": "temperature",
    "Td": "dew_point",
    "StnPres": "station_pressure",
    "SeaPres": "sea_level_pressure",
    "Visb": "visibility",
    "觀測時間(hour)": "obs_time",
    "測站氣壓(hPa)": "station_pressure",
    "氣溫(℃)": "temperature",
    "相對溼度(%)": "relative_humidity",
    "風速(m/s)": "wind_speed",
    "風向(360degree)": "wind_direction",
    "最大陣風(m/s)": "wind_gust",
    "最大陣風風向(360degree)": "wind_gust_direction",
    "降水量(mm)": "precipitation_1hr",
}
ARCHIVE_TIME_COLUMNS = ["obs_time", "timestamp", "Datetime", "DateTime", "ObsTime",
                        "ObsTimeDate", "DataTime", "time", "date"]
ARCHIVE_MEASURES = ["wind_speed", "wind_direction", "wind_gust", "wind_gust_direction",
                    "precipitation_1hr", "relative_humidity", "temperature", "dew_point",
                    "station_pressure", "sea_level_pressure", "visibility"]

# Inclusive physical limits: archive cleaning, sequence preparation, and
# per-station-type quality control use three different tables.
ARCHIVE_LIMITS = {
    "wind_speed": (0.0, 100.0),
    "wind_gust": (0.0, 120.0),
    "precipitation_1hr": (0.0, 500.0),
    "relative_humidity": (0.0, 100.0),
    "station_pressure": (800.0, 1100.0),
    "sea_level_pressure": (800.0, 1100.0),
    "temperature": (-20.0, 50.0),
    "visibility": (0.0, 100000.0),
    "dew_point": (-30.0, 40.0),
}
SEQUENCE_LIMITS = {
    "wind_speed": (0.0, 60.0),
    "wind_gust": (0.0, 80.0),
    "precipitation_1hr": (0.0, 200.0),
    "tide_level": (-200.0, 600.0),
    "visibility": (0.0, 20000.0),
    "qpe_1hr_mm": (0.0, 200.0),
    "qpe_3hr_mm": (0.0, 500.0),
    "nearby_precip_1": (0.0, 200.0),
    "nearby_precip_2": (0.0, 200.0),
    "nearby_precip_3": (0.0, 200.0),
    "nearby_available": (0.0, 1.0),
    "cwa_pop_current": (0.0, 1.0),
    "cwa_pop_next": (0.0, 1.0),
    "cwa_data_age_hr": (0.0, 1.0),
    "cwa_available": (0.0, 1.0),
    "wind_direction": (0.0, 360.0),
}
STATION_TYPE_LIMITS = {
    "wind": {"wind_speed": (0.0, 60.0), "wind_gust": (0.0, 100.0), "wind_direction": (0.0, 360.0)},
    "tide": {"tide_level_cm": (-500.0, 800.0)},
    "wave": {"wave_height_m": (0.0, 20.0), "wave_period_s": (0.0, 30.0),
             "current_speed": (0.0, 10.0), "current_direction": (0.0, 360.0)},
}

# Text that means "no value".
AGENCY_SENTINELS = ["", "-", "-99", "-999", "NaN"]
PANEL_SENTINELS = ["", "-", "-999", "NaN", "null", "None", "&nbsp;", " "]

# Sequence features and the defaults of absent ones.
BASE_FEATURES = ["wind_speed", "wind_gust", "precipitation_1hr", "tide_level"]
OPTIONAL_FEATURES = ["visibility"]
QPE_FEATURES = ["qpe_1hr_mm", "qpe_3hr_mm"]
SPATIAL_RAIN_FEATURES = ["nearby_precip_1", "nearby_precip_2", "nearby_precip_3", "nearby_available"]
FORECAST_FEATURES = ["cwa_pop_current", "cwa_pop_next", "cwa_data_age_hr", "cwa_available"]
FORECAST_FEATURE_DEFAULTS = {"cwa_pop_current": 0.0, "cwa_pop_next": 0.0,
                             "cwa_data_age_hr": 1.0, "cwa_available": 0.0}
CYCLIC_FEATURES = ["wind_dir_sin", "wind_dir_cos", "hour_sin", "hour_cos",
                   "doy_sin", "doy_cos", "tide_sin", "tide_cos"]

# Forecast anchors: label -> minutes ahead.
HORIZONS = {"H1": 30, "H2": 60, "H3": 90, "H4": 120}

# Operational levels, weakest first.
LEVELS = ["normal", "watch", "warning", "high_risk", "stop"]
LEVEL_RANK = {"normal": 0, "watch": 1, "warning": 2, "high_risk": 3, "stop": 4}

WIND_SPEED_THRESHOLDS = {"watch": 8.0, "warning": 10.8, "high_risk": 13.9, "stop": 17.2}
WIND_GUST_THRESHOLDS = {"watch": 10.8, "warning": 13.9, "high_risk": 17.2, "stop": 30.0}
RAIN_PROBABILITY_THRESHOLDS = {"watch": 0.30, "warning": 0.50, "high_risk": 0.70}
RAIN_WARNING_THRESHOLDS = {"watch": 0.30, "warning": 0.50, "stop": 0.70}
GUST_BUFFER_MPS = 1.2

RAIN_AMOUNT_THRESHOLDS = {"light": 1.0, "heavy_1hr": 40.0, "torrential_3hr": 100.0,
                          "severe_torrential_3hr": 200.0}
RAIN_AMOUNT_LABELS = {"none": "無", "light": "小雨", "heavy": "大雨", "torrential": "豪雨",
                      "severe": "大豪雨", "over": "not_applicable"}

# Lower bound (m/s) of each Beaufort number 0..12, with its name.
BEAUFORT_LOWER = [0.0, 0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7]
BEAUFORT_NAMES = ["無風", "軟風", "輕風", "微風", "和風", "清風", "強風", "疾風", "大風", "烈風",
                  "狂風", "暴風", "颶風"]

OPERATION_LABELS = {
    "normal": "一般風險",
    "watch": "注意風況",
    "warning": "限制高風險作業",
    "high_risk": "延後高風險作業",
    "stop": "停止暴露作業",
}
ACTION_BY_LEVEL_HIGH_RELIABILITY = {
    "normal": "normal_dispatch",
    "watch": "monitor",
    "warning": "restrict_sensitive_tasks",
    "high_risk": "delay_high_risk_tasks",
    "stop": "suspend_exposed_tasks",
}
ACTION_BY_LEVEL_LOW_RELIABILITY = {
    "normal": "normal_dispatch",
    "watch": "observe_only",
    "warning": "monitor",
    "high_risk": "restrict_sensitive_tasks",
    "stop": "delay_high_risk_tasks",
}
ACTION_LABELS = {
    "normal_dispatch": "正常派工",
    "observe_only": "觀察",
    "monitor": "監控",
    "restrict_sensitive_tasks": "限制敏感作業",
    "delay_high_risk_tasks": "延後高風險作業",
    "suspend_exposed_tasks": "暫停暴露作業",
}
ACTION_TEXTS = {
    "normal_dispatch": "可正常安排作業，持續監測天氣變化。",
    "observe_only": "風險來源可靠度較低，建議先觀察並加強現場回報。",
    "monitor": "可派工但需提高警戒，持續監控風速、陣風與降雨。",
    "restrict_sensitive_tasks": "建議限制吊掛、高處、臨水或其他受天氣影響較大的作業。",
    "delay_high_risk_tasks": "不建議安排高風險戶外作業，優先改派低風險工作。",
    "suspend_exposed_tasks": "建議暫停戶外暴露或高風險作業，待風險降低後再復工。",
}
LOW_RELIABILITY = {
    "normal": "normal_dispatch",
    "watch": "observe_only",
    "warning": "monitor",
    "high_risk": "restrict_sensitive_tasks",
    "stop": "delay_high_risk_tasks",
}
ACTION_LABELS = {
    "normal_dispatch": "正常派工",
    "observe_only": "觀察",
    "monitor": "監控",
    "restrict_sensitive_tasks": "限制敏感作業",
    "delay_high_risk_tasks": "延後高風險作業",
    "suspend_exposed_tasks": "暫停暴露作業",
}
ACTION_TEXTS = {
    "normal_dispatch": "可正常安排作業，持續監測天氣變化。",
    "observe_only": "風險來源可靠度較低，建議先觀察並加強現場回報。",
    "monitor": "可派工但需提高警戒，持續監控風速、陣風與降雨。",
    "restrict_sensitive_tasks": "建議限制吊掛、高處、臨水或其他受天氣影響較大的作業。",
    "delay_high_risk_tasks": "不建議安排高風險戶外作業，優先改派低風險工作。",
    "suspend_exposed_tasks": "建議暫停戶外暴露或高風險作業，待風險降低後再復工。",
}
SUGGESTION_TEXTS = {
    "normal": "可正常派工，持續監測天氣變化。",
    "watch": "可派工但需提高警戒，留意降雨、風速與陣風變化。",
    "warning": "建議限制高風險作業，必要作業需加強現場管制。",
    "high_risk": "不建議安排高風險戶外作業，應啟動替代排程。",
    "stop": "建議停止戶外暴露或高風險作業，待風險降低後再復工。",
}
LOW_RELIABILITY = ["low", "low_to_medium", "optional", "reference_only", "low_confidence", "unavailable"]
RELIABILITY = {
    "wind_speed": "high",
    "wind_gust": "medium_high",
    "rain_probability": "low_to_medium",
    "tide": "reference_only",
    "visibility": "optional",
    "marine_transfer": "low_confidence",
}
TRIGGER_PRIORITY = ["wind_gust", "wind_speed", "rain_probability", "visibility", "tide"]

# Seasons.
SEASON_MONTHS = {"spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11], "winter": [12, 1, 2]}
SEASON_CODES = {"spring": 1.0, "summer": 2.0, "autumn": 3.0, "winter": 4.0, "typhoon": 5.0}

# Freshness policy: (source, device type) -> minutes, interval text, note.
DEFAULT_FRESHNESS = (20, "約 5-20 分鐘", "未指定類型時使用保守門檻。")
FRESHNESS_POLICIES = {
    ("twport", "WIND"): (20, "現場風站約 1-5 分鐘；模擬風站可能整點更新", "風速對港口作業影響高，維持較嚴格門檻。"),
    ("twport", "VISIBILITY"): (20, "約 1-5 分鐘", "能見度屬即時安全條件，維持較嚴格門檻。"),
    ("twport", "TIDE"): (75, "主站約數分鐘；模擬站常見整點更新", "潮位與模擬資料更新頻率不同，採較寬門檻。"),
    ("twport", "WAVE"): (75, "多為整點或約 1 小時", "波浪模擬資料通常不是分鐘級更新。"),
    ("twport", "CURRENT"): (75, "多為整點或約 1 小時", "海流模擬資料通常不是分鐘級更新。"),
    ("twport", "AWAC"): (90, "約 30-60 分鐘", "底碇式波流觀測站常有較長更新間隔。"),
    ("twport", "STABILITY"): (75, "多為整點或約 1 小時", "港內靜穩資料常見整點更新。"),
    ("cwa", "WEATHER"): (75, "約每 1 小時", "CWA 自動站資料常以整點或接近整點更新。"),
}
OUTAGE_AFTER_MINUTES = 1440

# Accuracy cut-offs: variable -> metric -> anchor -> (excellent, acceptable).
GRADE_CUTOFFS = {
    "tide_level": {
        "mae": {"H1": (3, 6), "H2": (5, 10), "H3": (7, 13), "H4": (10, 18)},
        "rmse": {"H1": (5, 9), "H2": (8, 14), "H3": (11, 19), "H4": (15, 25)},
    },
    "wind_speed": {
        "mae": {"H1": (0.8, 1.5), "H2": (1.2, 2.0), "H3": (1.5, 2.5), "H4": (2.0, 3.0)},
        "rmse": {"H1": (1.2, 2.2), "H2": (1.8, 2.8), "H3": (2.2, 3.5), "H4": (2.8, 4.2)},
    },
    "wind_gust": {
        "mae": {"H1": (1.0, 2.0), "H2": (1.5, 2.5), "H3": (2.0, 3.2), "H4": (2.5, 3.8)},
    },
    "precipitation_1hr": {
        "mae": {"H1": (1.0, 1.8), "H2": (1.1, 2.2), "H3": (1.1, 2.8), "H4": (1.1, 3.5)},
        "csi_threshold_1mm": {"H1": (0.50, 0.35), "H2": (0.45, 0.32), "H3": (0.40, 0.30), "H4": (0.36, 0.28)},
    },
    "visibility": {
        "mae": {"H1": (500, 1000), "H2": (700, 1400), "H3": (900, 1800), "H4": (1200, 2200)},
    },
}

# Earth radii (km) used by the two distance rules.
EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_MEAN_KM = 6371.0088

# Named harbour reference points: (name, longitude, latitude).
REFERENCE_POINTS = [
    ("first_harbor", 120.283, 22.617),
    ("qianzhen_fishing_port", 120.304, 22.574),
    ("second_harbor", 120.340, 22.552),
    ("container_terminal_area", 120.300, 22.600),
]

# Tidal constituents: name -> period in hours.
TIDAL_PERIODS_HOURS = {
    "M2": 12.4206,
    "S2": 12.0,
    "N2": 12.6583,
    "K1": 23.9345,
    "O1": 25.8193,
    "P1": 24.0659,
}

# Features the rain amount model may use.
RAIN_AMOUNT_FEATURES = [
    "nearby_cwa_precipitation_1hr_mean",
    "nearby_cwa_precipitation_1hr_max",
    "nearby_cwa_precipitation_1hr_max_lag1",
    "nearby_cwa_precipitation_1hr_max_roll3",
    "nearby_cwa_precipitation_roll3",
    "nearby_cwa_precipitation_roll6",
    "nearby_cwa_rainy_station_count",
    "nearby_cwa_rainy_station_ratio",
    "distance_weighted_precipitation",
    "upstream_subset_precipitation_1hr_mean",
    "upstream_subset_precipitation_1hr_max",
    "upstream_subset_precipitation_1hr_max_lag1",
    "upstream_subset_precipitation_1hr_max_roll3",
    "upstream_subset_precipitation_roll3",
    "upstream_subset_precipitation_roll6",
    "upstream_subset_station_count",
    "upstream_subset_season_code",
    "nearby_cwa_pressure_mean",
    "nearby_cwa_pressure_min",
    "nearby_cwa_pressure_max",
    "nearby_cwa_pressure_std",
    "nearby_cwa_pressure_gradient",
    "nearby_cwa_pressure_mean_lag1",
    "nearby_cwa_pressure_mean_roll3",
    "nearby_cwa_pressure_mean_trend_3h",
    "nearby_cwa_relative_humidity_mean",
    "nearby_cwa_relative_humidity_min",
    "nearby_cwa_relative_humidity_max",
    "nearby_cwa_relative_humidity_std",
    "nearby_cwa_temperature_mean",
    "nearby_cwa_temperature_min",
    "nearby_cwa_temperature_max",
    "nearby_cwa_temperature_std",
    "nearby_cwa_dew_point_mean",
    "nearby_cwa_dew_point_spread_mean",
    "hour_sin",
    "hour_cos",
    "doy_sin",
    "doy_cos",
]

# Words that mark a column as usable in the rain benchmark.
RAIN_FEATURE_WORDS = ["precipitation", "rainy", "rain", "hour_", "doy_", "station_count"]
