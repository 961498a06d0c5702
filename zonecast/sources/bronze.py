"""Bronze day files and the normalisers that shape landed payload tables."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEATHER_VARIABLES = ["temperature_2m", "wind_speed_10m", "shortwave_radiation"]
WEATHER_SERIES = {
    "temperature_2m": "weather_temperature",
    "wind_speed_10m": "weather_wind_speed",
    "shortwave_radiation": "weather_irradiance",
}


def utc_time(col: Column) -> Column:
    return col.cast("timestamp")


def epoch_time(col: Column) -> Column:
    return F.timestamp_seconds(col)


def with_utc_date(df: DataFrame, time: str = "valid_time") -> DataFrame:
    return df.withColumn("date", F.to_date(time))


# --- day files -----------------------------------------------------------------------------------------------------


def bronze_write(df: DataFrame, root: str, data_type: str) -> None:
    """Write every ``(zone, UTC day)`` in ``df``; days already on disk are replaced, all others stay."""
    out = with_utc_date(df).withColumn("data_type", F.lit(data_type))
    (
        out.hint("rebalance", "zone", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("data_type", "zone", "date")
        .parquet(root)
    )


def bronze_read_range(
    spark: SparkSession,
    root: str,
    data_type: str,
    start: dt.date,
    end: dt.date,
    zone: str | None = None,
    schema: str = "valid_time timestamp, value double, zone string",
    merge: bool = False,
) -> DataFrame:
    """Days ``start`` to ``end`` inclusive; absent days are skipped, an absent type gives an empty frame.

    Only the folders of the wanted zone and days are listed. Files are read by ``schema``; ``merge`` takes the union of
    the columns of those folders instead, for tables whose columns differ from day to day.
    """
    days = ",".join(str(start + dt.timedelta(days=i)) for i in range((end - start).days + 1))
    wanted = f"{root}/data_type={data_type}/zone={zone or '*'}/date={{{days}}}"
    reader = spark.read.option("basePath", root)
    try:
        if merge:
            df = reader.option("mergeSchema", "true").parquet(wanted)
        else:
            df = reader.schema(f"{schema}, data_type string, date date").parquet(wanted)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    df = df.where(F.col("date").between(F.lit(start), F.lit(end)))
    if zone is not None:
        df = df.where(F.col("zone") == zone)
    return df.withColumn("zone", F.col("zone").cast("string")).drop("data_type", "date")


def union_days(frames: list[DataFrame]) -> DataFrame:
    """All rows of several day frames; columns missing in one are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- normalisers ---------------------------------------------------------------------------------------------------


def normalize_prices(raw: DataFrame, time: str = "valid_time", value: str = "value",
                     zone: str | Column = "zone") -> DataFrame:
    z = F.col(zone) if isinstance(zone, str) else zone
    out = raw.select(utc_time(F.col(time)).alias("valid_time"), F.col(value).cast("double").alias("value"),
                     z.alias("zone"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def normalize_load(raw: DataFrame, zone: str | Column = "zone") -> DataFrame:
    """The first two columns are time and load, whatever their names."""
    t, v = raw.columns[:2]
    z = F.col(zone) if isinstance(zone, str) else zone
    out = raw.select(utc_time(F.col(t)).alias("valid_time"), F.col(v).cast("double").alias("actual_load"),
                     z.alias("zone"))
    return out.where(F.col("actual_load").isNotNull() & ~F.isnan("actual_load"))


def normalize_generation(long: DataFrame, fuels: list[str] | None = None) -> DataFrame:
    """Long ``zone, valid_time, fuel, kind, value`` to wide fuel columns; consumption rows are left out.

    ``fuels`` fixes the columns; without it the distinct fuel names (a short code list) are looked up first.
    """
    actual = long.where(F.col("kind") == "Actual Aggregated")
    if fuels is None:
        fuels = sorted(r.fuel for r in actual.select("fuel").distinct().collect())
    wide = actual.groupBy(utc_time(F.col("valid_time")).alias("valid_time"), "zone").pivot("fuel", fuels).agg(
        F.first("value", ignorenulls=True)
    )
    return wide.na.drop("all", subset=[f"`{f}`" for f in fuels]).select(
        "valid_time", *[F.col(f"`{f}`") for f in fuels], "zone"
    )


def drop_empty_fuel_rows(wide: DataFrame) -> DataFrame:
    fuels = [f"`{c}`" for c in wide.columns if c not in ("valid_time", "zone")]
    return wide.na.drop("all", subset=fuels)


def normalize_crossborder(raw: DataFrame, from_zone: str | Column = "from_zone",
                          to_zone: str | Column = "to_zone") -> DataFrame:
    a = F.col(from_zone) if isinstance(from_zone, str) else from_zone
    b = F.col(to_zone) if isinstance(to_zone, str) else to_zone
    out = raw.select(utc_time(F.col("valid_time")).alias("valid_time"), F.col("value").cast("double").alias("value"),
                     a.alias("from_zone"), b.alias("to_zone"))
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def wanted_pairs(flows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Flows of the configured zone pairs (the pair list is a fixed dimension)."""
    keep = pairs.select("from_zone", "to_zone")
    return flows.join(keep, ["from_zone", "to_zone"], "left_semi")


def normalize_weather(payload: DataFrame, variables: list[str] = WEATHER_VARIABLES) -> DataFrame:
    """Payload rows ``zone, start_s, end_s, step_s, <variable arrays>`` to long ``zone, variable, valid_time, value``.

    The time axis is built once per payload row; null values are dropped per variable.
    """
    axis = F.sequence(F.col("start_s"), F.col("end_s") - F.col("step_s"), F.col("step_s"))
    zipped = F.arrays_zip(axis.alias("t"), *[F.col(v) for v in variables])
    hours = payload.select("zone", F.explode(zipped).alias("h")).select(
        "zone", epoch_time(F.col("h.t")).alias("valid_time"), *[F.col(f"h.{v}").cast("double").alias(v) for v in variables]
    )
    long = hours.unpivot(["zone", "valid_time"], variables, "variable", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).select("zone", "variable", "valid_time", "value")


def weather_wide(long: DataFrame, variables: list[str] = WEATHER_VARIABLES) -> DataFrame:
    """One row per time of the *first* variable, the others where known: one aggregation, no chain of joins."""
    wide = long.where(F.col("variable").isin(variables)).groupBy("valid_time", "zone").agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    )
    return wide.where(F.col(variables[0]).isNotNull()).select("valid_time", *variables, "zone")
