"""Bitemporal series: ``valid_time`` says when a value applies, ``knowledge_time`` when it became known.

Row shape: ``zone, series_id, valid_time, value, knowledge_time, retention``. Versions are only ever appended; reads
resolve them with one aggregation per ``(zone, series_id, valid_time)``, which combines on the map side, so a key with
very many versions never gathers in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["zone", "series_id", "valid_time"]
SCHEMA = (
    "zone string, series_id int, valid_time timestamp, value double, knowledge_time timestamp, retention string"
)
# "medium" is three years; the lengths of "short" and "long" are deployment choices
DEFAULT_TTL_DAYS = {"short": 90, "medium": 1095, "long": 3650}


def to_versions(
    df: DataFrame,
    series_id: int | Column | None = None,
    knowledge_time: dt.datetime | Column | None = None,
    retention: str = "forever",
) -> DataFrame:
    """Shape ``zone, valid_time, value`` rows as versions; knowledge time defaults to now."""
    if series_id is None:
        sid = F.col("series_id")
    else:
        sid = series_id if isinstance(series_id, Column) else F.lit(series_id)
    if knowledge_time is None:
        known = F.current_timestamp()
    else:
        known = knowledge_time if isinstance(knowledge_time, Column) else F.lit(knowledge_time)
    return df.select(
        "zone",
        sid.cast("int").alias("series_id"),
        F.col("valid_time").cast("timestamp").alias("valid_time"),
        F.col("value").cast("double").alias("value"),
        known.cast("timestamp").alias("knowledge_time"),
        F.lit(retention).alias("retention"),
    )


def write_series(df: DataFrame, path: str, **version_options) -> None:
    """Append versions; earlier versions stay readable.

    Partitioned by series and month so time-bounded reads prune; the rebalance hint lets AQE split large and merge
    small write partitions.
    """
    rows = to_versions(df, **version_options).withColumn("ym", F.date_format("valid_time", "yyyyMM").cast("int"))
    rows.hint("rebalance", "series_id", "ym").write.mode("append").partitionBy("series_id", "ym").parquet(path)


def read_versions(spark, path: str, series_ids: list[int] | None = None, start=None, end=None) -> DataFrame:
    """All stored versions, optionally of some series and a half-open valid range (both prune partitions)."""
    df = spark.read.schema(SCHEMA + ", ym int").parquet(path)
    if series_ids is not None:
        df = df.where(F.col("series_id").isin(series_ids))
    if start is not None:
        df = df.where((F.col("ym") >= int(start.strftime("%Y%m"))) & (F.col("valid_time") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("ym") <= int(end.strftime("%Y%m"))) & (F.col("valid_time") < F.lit(end)))
    return df.drop("ym")


def with_series_name(versions: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Series name next to the id; an unregistered id shows as its number."""
    names = registry.select("series_id", F.col("name").alias("_name"))
    return (
        versions.join(names, "series_id", "left")
        .withColumn(name, F.coalesce("_name", F.col("series_id").cast("string")))
        .drop("_name")
    )


def _newest() -> Column:
    # newest knowledge wins, equal knowledge times resolve to the larger value
    return F.max(F.struct("knowledge_time", "value"))


def read_latest(versions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One value per key: the newest version."""
    keys = keys or KEYS
    return (
        versions.groupBy(*keys)
        .agg(_newest().alias("_v"))
        .select(*keys, F.col("_v.value").alias("value"), F.col("_v.knowledge_time").alias("knowledge_time"))
    )


def known_before(versions: DataFrame, as_of: dt.datetime | Column) -> DataFrame:
    cut = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return versions.where(F.col("knowledge_time") < cut)


def read_as_of(versions: DataFrame, as_of: dt.datetime | Column, start_day: dt.date | None = None,
               end_day: dt.date | None = None) -> DataFrame:
    """What was known strictly before ``as_of``, for valid days ``start_day`` to ``end_day`` inclusive."""
    df = known_before(versions, as_of)
    if start_day is not None:
        df = df.where(F.col("valid_time") >= F.lit(start_day).cast("timestamp"))
    if end_day is not None:
        df = df.where(F.col("valid_time") < F.lit(end_day + dt.timedelta(days=1)).cast("timestamp"))
    return read_latest(df)


def gate_closure(valid_time: Column, days_ahead: int = 1, time_of_day: dt.time = dt.time(12, 0)) -> Column:
    """Decision time for the delivery day of ``valid_time``."""
    offset = dt.timedelta(hours=time_of_day.hour, minutes=time_of_day.minute, seconds=time_of_day.second)
    shift = int(offset.total_seconds()) - days_ahead * 86400
    day = F.date_trunc("day", valid_time)
    return F.timestamp_seconds(F.unix_seconds(day) + F.lit(shift))


def read_relative(versions: DataFrame, days_ahead: int = 1, time_of_day: dt.time = dt.time(12, 0)) -> DataFrame:
    """Per valid time the newest version known at or before its own gate closure (a row filter, no join)."""
    cut = gate_closure(F.col("valid_time"), days_ahead, time_of_day)
    return read_latest(versions.where(F.col("knowledge_time") <= cut))


def read_latest_wide(versions: DataFrame, series: dict[str, int]) -> DataFrame:
    """Newest values of several series as columns per ``(zone, valid_time)``; absent series give null columns.

    One aggregation with a conditional maximum per series: a single shuffle, no pivot.
    """
    wanted = versions.where(F.col("series_id").isin(list(series.values())))
    wide = wanted.groupBy("zone", "valid_time").agg(
        *[
            F.max(F.when(F.col("series_id") == sid, F.struct("knowledge_time", "value"))).alias(name)
            for name, sid in series.items()
        ]
    )
    return wide.select("zone", "valid_time", *[F.col(f"{n}.value").alias(n) for n in series])


def provenance(versions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per run (knowledge time): first and last valid time and the number of stored hours."""
    keys = keys or ["knowledge_time"]
    return versions.groupBy(*keys).agg(
        F.min("valid_time").alias("first_valid_time"),
        F.max("valid_time").alias("last_valid_time"),
        F.count("valid_time").alias("hours_stored"),
    )


def apply_retention(versions: DataFrame, now: dt.datetime | Column, ttl_days: dict[str, int] | None = None) -> DataFrame:
    """Drop rows older than their tier allows, counted from valid time; "forever" and unknown tiers stay."""
    ttl = DEFAULT_TTL_DAYS if ttl_days is None else ttl_days
    now = now if isinstance(now, Column) else F.lit(now)
    keep = F.lit(True)
    for tier, days in ttl.items():
        oldest = F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) - days * 86400)
        keep = F.when(F.col("retention") == tier, F.col("valid_time") >= oldest).otherwise(keep)
    return versions.where(keep)


def rewrite_retained(spark, path: str, target: str, now: dt.datetime | Column, ttl_days: dict[str, int] | None = None) -> None:
    """Rewrite stored versions without expired rows into the fresh folder ``target``, laid out as ``write_series`` does."""
    rows = spark.read.schema(SCHEMA + ", ym int").parquet(path)
    kept = apply_retention(rows, now, ttl_days)
    kept.hint("rebalance", "series_id", "ym").write.partitionBy("series_id", "ym").parquet(target)


def forecasts_to_versions(
    forecasts: DataFrame,
    series: dict[str, int],
    knowledge_time: dt.datetime | Column | None = None,
    retention: str = "forever",
) -> DataFrame:
    """Forecast columns (named in ``series``) to long versions under one run's knowledge time, nulls dropped."""
    cols = [c for c in series if c in forecasts.columns]
    long = forecasts.unpivot(["zone", "valid_time"], cols, "_series", "value").where(F.col("value").isNotNull())
    sid = F.coalesce(*[F.when(F.col("_series") == c, F.lit(series[c])) for c in cols])
    return to_versions(long, sid, knowledge_time, retention)
