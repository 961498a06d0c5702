"""Gold feature table and the feature views on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions.calendar import CALENDAR_COLS
from zonecast.operators.features import LAG_COLS

TTL_DAYS = 30

# --- fixed values: view columns, and view name -> matrix name where they differ ---
VIEWS = {
    "price_features": [*LAG_COLS, "price_roll24h_mean", "price_roll168h_mean", "price_roll168h_std",
                       "price_roll720h_std"],
    "calendar_features": list(CALENDAR_COLS),
    "grid_weather_features": ["temperature_2m", "wind_speed_10m", "solar_radiation", "temp_x_wind", "temp_x_hour",
                              "wind_mw", "solar_mw", "load_mw", "net_exchange_mw"],
}
ALIASES = {
    "price_roll24h_mean": "price_roll24h",
    "price_roll168h_mean": "price_roll168h",
    "temperature_2m": "temperature",
    "wind_speed_10m": "wind_speed",
    "solar_radiation": "irradiance",
}
INTEGER_FIELDS = ["hour", "weekday", "month", "is_weekend", "is_holiday", "hour_of_week"]
# --- end of fixed values ---

SERVICE = ["price_features", "calendar_features", "grid_weather_features"]


def view_columns(views: list[str] = SERVICE) -> list[str]:
    return [c for v in views for c in VIEWS[v]]


def select_views(matrix: DataFrame, views: list[str] = SERVICE) -> DataFrame:
    """Matrix columns under their view names and declared types, with the join keys."""
    out = []
    for c in view_columns(views):
        kind = "bigint" if c in INTEGER_FIELDS else "double"
        out.append(F.col(ALIASES.get(c, c)).cast(kind).alias(c))
    return matrix.select("zone", "valid_time", *out)


def write_gold(matrix: DataFrame, path: str) -> None:
    """``zone/year/month`` folders; only the months present in ``matrix`` are replaced."""
    out = matrix.withColumns({"year": F.year("valid_time"), "month_no": F.month("valid_time")})
    (
        out.hint("rebalance", "zone", "year", "month_no")
        .sortWithinPartitions("zone", "year", "month_no", "valid_time")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("zone", "year", "month_no")
        .parquet(path)
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path).drop("year", "month_no")
    return df.withColumn("zone", F.col("zone").cast("string"))
