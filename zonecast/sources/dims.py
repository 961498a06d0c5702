"""Fixed dimensions: zones, series registry, alert thresholds, default flow pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------------------------------------
# zone_id, EIC code, name, country, latitude, longitude, IANA time zone
ZONES = [
    ("SE1", "10Y1001A1001A44P", "Luleå", "SE", 65.58, 22.15, "Europe/Stockholm"),
    ("SE2", "10Y1001A1001A45N", "Sundsvall", "SE", 62.39, 17.31, "Europe/Stockholm"),
    ("SE3", "10Y1001A1001A46L", "Stockholm", "SE", 59.33, 18.07, "Europe/Stockholm"),
    ("SE4", "10Y1001A1001A47J", "Malmö", "SE", 55.60, 13.00, "Europe/Stockholm"),
]
ZONE_SCHEMA = "zone_id string, entsoe_eic string, name string, country string, lat double, lon double, timezone string"

SERIES = {
    "prices_raw": 1,
    "weather_temperature": 10,
    "weather_wind_speed": 11,
    "weather_irradiance": 12,
    "lgbm_q05": 20,
    "lgbm_q50": 21,
    "lgbm_q95": 22,
    "ens_q05": 23,
    "ens_q50": 24,
    "ens_q95": 25,
    "lear_q05": 30,
    "lear_q50": 31,
    "lear_q95": 32,
    "generation_total": 40,
    "generation_wind": 41,
    "generation_solar": 42,
    "load_actual": 50,
    "crossborder_SE1_SE2": 60,
    "crossborder_SE2_SE3": 61,
    "crossborder_SE3_SE4": 62,
}

DEFAULT_PAIRS = [("SE1", "SE2"), ("SE2", "SE3"), ("SE3", "SE4")]

# rmae_max, pinball_q50_multiplier, coverage_min, coverage_max, min_hours: the same for every zone
THRESHOLD_DEFAULTS = (1.2, 1.5, 0.80, 0.97, 48)
WINDOW_DAYS = 7
BASELINE_DAYS = 90
# --- end of fixed values -------------------------------------------------------------------------------------------

THRESHOLD_SCHEMA = (
    "zone string, rmae_max double, pinball_q50_multiplier double, coverage_min double, coverage_max double, "
    "min_hours int"
)


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, ZONE_SCHEMA)


def series(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for n, i in SERIES.items()], "series_id int, name string")


def zone_pairs(spark: SparkSession, pairs=None) -> DataFrame:
    """Flow pairs as EIC codes; unknown zone ids raise."""
    eic = {z[0]: z[1] for z in ZONES}
    chosen = DEFAULT_PAIRS if pairs is None else pairs
    missing = sorted({z for p in chosen for z in p if z not in eic})
    if missing:
        raise ValueError(f"Unknown zone(s) {missing}. Available: {', '.join(eic)}")
    return spark.createDataFrame(
        [(a, b, eic[a], eic[b]) for a, b in chosen],
        "from_zone_id string, to_zone_id string, from_zone string, to_zone string",
    )


def thresholds(spark: SparkSession, zone_ids=None) -> DataFrame:
    ids = [z[0] for z in ZONES] if zone_ids is None else list(zone_ids)
    return spark.createDataFrame([(z, *THRESHOLD_DEFAULTS) for z in ids], THRESHOLD_SCHEMA)


def zone_by_id(spark: SparkSession, zone_id: str) -> DataFrame:
    """One zone row; an unknown id raises ValueError."""
    known = [z[0] for z in ZONES]
    if zone_id not in known:
        raise ValueError(f"Unknown zone '{zone_id}'. Available: {', '.join(known)}")
    return zones(spark).where(F.col("zone_id") == zone_id)


def thresholds_by_zone(table: DataFrame, zone_id: str) -> DataFrame:
    """Thresholds of one zone plus the two global windows; an unknown zone raises KeyError."""
    row = table.where(F.col("zone") == zone_id).limit(1)
    if row.isEmpty():
        raise KeyError(f"Zone '{zone_id}' not found in thresholds")
    return row.withColumns({"window_days": F.lit(WINDOW_DAYS), "baseline_days": F.lit(BASELINE_DAYS)})


def lookup_required(facts: DataFrame, dim: DataFrame, on: str, probe: str, what: str) -> DataFrame:
    """Left join to a dimension in which an unmatched key fails the job instead of passing as nulls."""
    joined = facts.join(dim, on, "left")
    failed = F.raise_error(F.concat(F.lit(f"Unknown {what}: "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return joined.withColumn(probe, F.when(F.col(probe).isNull(), failed.cast(dim.schema[probe].dataType))
                             .otherwise(F.col(probe)))


def resolve_zone_ids(facts: DataFrame, zone_col: str = "zone") -> DataFrame:
    """Short zone ids to EIC codes for a table; unknown ids fail the job."""
    dim = zones(facts.sparkSession).select(F.col("zone_id").alias(zone_col), "entsoe_eic")
    out = lookup_required(facts, dim, zone_col, "entsoe_eic", "zone")
    return out.withColumn(zone_col, F.col("entsoe_eic")).drop("entsoe_eic")


def ingest_window(kind: str, now: dt.datetime, start: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Half-open polling window: prices reach the end of D+1, everything else the current hour."""
    if kind == "prices":
        end = now.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(days=2)
    else:
        end = now.replace(minute=0, second=0, microsecond=0)
    return start, end


def in_window(time: Column, window: tuple[dt.datetime, dt.datetime]) -> Column:
    return (time >= F.lit(window[0])) & (time < F.lit(window[1]))
