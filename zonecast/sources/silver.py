"""Silver tables: cleaning rules, monthly layout, tolerant reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: table columns and sort keys ---
TABLES = {
    "generation_actual": ("valid_time timestamp, zone string, total_mw double, wind_mw double, solar_mw double",
                          ["zone", "valid_time"]),
    "load_actual": ("valid_time timestamp, zone string, value_mw double", ["zone", "valid_time"]),
    "crossborder_flows": ("valid_time timestamp, from_zone string, to_zone string, value_mw double",
                          ["from_zone", "to_zone", "valid_time"]),
}
# --- end of fixed values ---


def _audited(df: DataFrame, audit: bool) -> DataFrame:
    return df.withColumn("loaded_at", F.current_timestamp()) if audit else df


def silver_generation(raw: DataFrame, audit: bool = False) -> DataFrame:
    """Known time and zone, no negative output; a null output drops the row too."""
    mw = ["total_mw", "wind_mw", "solar_mw"]
    out = raw.select(F.col("valid_time").cast("timestamp").alias("valid_time"), "zone", *mw)
    keep = F.col("valid_time").isNotNull() & F.col("zone").isNotNull()
    for c in mw:
        keep = keep & (F.col(c) >= 0)
    return _audited(out.where(keep), audit)


def silver_load(raw: DataFrame, audit: bool = False) -> DataFrame:
    out = raw.select(F.col("valid_time").cast("timestamp").alias("valid_time"), "zone", "value_mw")
    return _audited(out.where("valid_time IS NOT NULL AND zone IS NOT NULL AND value_mw > 0"), audit)


def silver_crossborder(raw: DataFrame, audit: bool = False) -> DataFrame:
    """Flows may be negative or null; only the keys are required."""
    out = raw.select(F.col("valid_time").cast("timestamp").alias("valid_time"), "from_zone", "to_zone", "value_mw")
    return _audited(out.where("valid_time IS NOT NULL AND from_zone IS NOT NULL AND to_zone IS NOT NULL"), audit)


def write_silver(df: DataFrame, path: str, sort_keys: list[str], mode: str = "overwrite") -> None:
    """Full rebuild (``overwrite``), append, or create-if-absent (``ignore``): months as folders, rows sorted in files.

    The rebalance evens out months of very different size; the sort makes row-group statistics selective.
    """
    out = df.withColumn("ym", F.date_format("valid_time", "yyyyMM").cast("int"))
    (
        out.hint("rebalance", "ym")
        .sortWithinPartitions("ym", *sort_keys)
        .write.mode(mode)
        .partitionBy("ym")
        .parquet(path)
    )


def refresh_table(df: DataFrame, name: str, path: str) -> None:
    """Rebuild one of the tables from all its cleaned rows, sorted by the table's keys inside each month."""
    columns, keys = TABLES[name]
    write_silver(df.select(*[c.split()[0] for c in columns.split(", ")]), path, keys)


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table by its declared columns; the month folder ``ym`` is there to prune by."""
    return spark.read.schema(f"{TABLES[name][0]}, ym int").parquet(path)


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Catalog tables, created only where absent."""
    for name, (cols, _) in TABLES.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({cols}, ym int) USING parquet PARTITIONED BY (ym)"
        )
    return list(TABLES)


def read_or_empty(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """A catalog table, or an empty frame of that schema if it does not exist; other errors propagate."""
    if spark.catalog.tableExists(table):
        return spark.read.table(table)
    return spark.createDataFrame([], schema)


def scan_window(df: DataFrame, zone: str | None, start: dt.datetime, end: dt.datetime, ordered: bool = True) -> DataFrame:
    """Half-open time range of one zone; both filters reach the Parquet scan (and its month folders)."""
    out = df.where((F.col("valid_time") >= F.lit(start)) & (F.col("valid_time") < F.lit(end)))
    if zone is not None:
        out = out.where(F.col("zone") == zone)
    if "ym" in df.columns:
        out = out.where(F.col("ym").between(int(start.strftime("%Y%m")), int(end.strftime("%Y%m"))))
    return out.orderBy("valid_time") if ordered else out


def recent_days(df: DataFrame, now: dt.datetime, days: int) -> DataFrame:
    return df.where(F.col("valid_time") >= F.lit(now - dt.timedelta(days=days)))


def between_dates(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Inclusive date range written as a time range, so it can be pushed down."""
    lo = dt.datetime.combine(first, dt.time())
    hi = dt.datetime.combine(last, dt.time()) + dt.timedelta(days=1)
    return df.where((F.col("valid_time") >= F.lit(lo)) & (F.col("valid_time") < F.lit(hi)))
