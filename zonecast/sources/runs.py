"""Write-once runs of bitemporal versions, with retention by whole months.

``<root>/rows`` holds versions by ``retention``, ``ym`` (month of the valid time) and ``attempt``; ``<root>/complete``
names the finished attempt of each run. A run counts from the moment its line stands there, so a torn attempt is never
read, a retry writes beside it, and a run that is already complete adds nothing. If two attempts of one run finish at
the same time, every reader takes the same one.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.sources import bitemporal

PARTITIONS = ["retention", "ym", "attempt"]


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Stored rows, none if nothing has been written yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/rows", "parquet", f"{bitemporal.SCHEMA}, ym int, attempt string")


def complete_runs(spark: SparkSession, root: str) -> DataFrame:
    """``run, attempt``: one attempt for each complete run."""
    lines = _read(spark, f"{root}/complete", "json", "run string, attempt string")
    return lines.groupBy("run").agg(F.min("attempt").alias("attempt"))


def is_complete(spark: SparkSession, root: str, run: str) -> bool:
    return not complete_runs(spark, root).where(F.col("run") == run).isEmpty()


def write_rows(versions: DataFrame, root: str) -> str:
    """Store the rows of one attempt, unseen by readers until ``finish``; returns the attempt."""
    attempt = uuid.uuid4().hex
    rows = versions.select(*bitemporal.KEYS, "value", "knowledge_time", "retention").withColumns(
        {"ym": F.date_format("valid_time", "yyyyMM").cast("int"), "attempt": F.lit(attempt)}
    )
    (
        rows.hint("rebalance", "retention", "ym")
        .sortWithinPartitions("retention", "ym", *bitemporal.KEYS)
        .write.mode("append").partitionBy(*PARTITIONS).parquet(f"{root}/rows")
    )
    return attempt


def finish(spark: SparkSession, root: str, run: str, attempt: str) -> None:
    line = spark.createDataFrame([(run, attempt)], "run string, attempt string")
    line.coalesce(1).write.mode("append").json(f"{root}/complete")


def write_run(versions: DataFrame, root: str, run: str) -> bool:
    """Store all versions of one run, once; False if the run was complete already."""
    spark = versions.sparkSession
    if is_complete(spark, root, run):
        return False
    finish(spark, root, run, write_rows(versions, root))
    return True


def read_runs(spark: SparkSession, root: str, series_ids: list[int] | None = None, start: dt.datetime | None = None,
              end: dt.datetime | None = None) -> DataFrame:
    """Versions of complete runs with their ``run``, optionally of some series and a half-open valid range.

    Months prune as folders; inside files rows are sorted by zone, series and time.
    """
    rows = _rows(spark, root)
    if series_ids is not None:
        rows = rows.where(F.col("series_id").isin(series_ids))
    if start is not None:
        rows = rows.where((F.col("ym") >= int(start.strftime("%Y%m"))) & (F.col("valid_time") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("ym") <= int(end.strftime("%Y%m"))) & (F.col("valid_time") < F.lit(end)))
    return rows.join(complete_runs(spark, root), "attempt").drop("attempt", "ym")


# --- retention -----------------------------------------------------------------------------------------------------


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def _months(spark: SparkSession, folder: str) -> list[int]:
    """Months that have a folder; a listing of names, no file is opened."""
    where, fs = _file_system(spark, folder)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[3:]) for n in names if n.startswith("ym=") and n[3:].isdigit())


def _bounds(month: int) -> tuple[dt.datetime, dt.datetime]:
    first = dt.datetime(month // 100, month % 100, 1)
    return first, (first + dt.timedelta(days=31)).replace(day=1)


def _rewrite(spark: SparkSession, root: str, tier: str, month: int, oldest: dt.datetime) -> bool:
    """Replace the attempts of one month that hold expired rows; unfinished attempts stay as they are."""
    finished = complete_runs(spark, root).select("attempt")
    rows = _rows(spark, root).where((F.col("retention") == tier) & (F.col("ym") == month)).join(finished, "attempt", "left_semi")
    kept = F.col("valid_time") >= F.lit(oldest)
    # a row for each run that wrote into this month
    held = rows.groupBy("attempt").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("expired"))
    stale = held.where("expired > 0").collect()
    mixed = [r.attempt for r in stale if r.kept]
    if mixed:
        (
            rows.where(F.col("attempt").isin(mixed) & kept)
            .hint("rebalance", *PARTITIONS)
            .sortWithinPartitions(*PARTITIONS, *bitemporal.KEYS)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{root}/rows")
        )
    for r in stale:
        if not r.kept:
            _delete(spark, f"{root}/rows/retention={tier}/ym={month}/attempt={r.attempt}")
    return bool(stale)


def drop_expired(spark: SparkSession, root: str, now: dt.datetime, ttl_days: dict[str, int] | None = None) -> dict[str, list]:
    """Remove versions older than their tier allows, counted from valid time, in place.

    Months that lie wholly before a tier's limit go as folders, unread; only the month that holds the limit is read,
    and of it only attempts with expired rows are replaced. Other tiers and months are never opened. Returns the
    ``(tier, month)`` pairs that were ``dropped`` and ``rewritten``; a second call finds nothing to do.
    """
    done: dict[str, list] = {"dropped": [], "rewritten": []}
    for tier, days in (bitemporal.DEFAULT_TTL_DAYS if ttl_days is None else ttl_days).items():
        oldest = now - dt.timedelta(days=days)
        folder = f"{root}/rows/retention={tier}"
        for month in _months(spark, folder):
            first, after = _bounds(month)
            if after <= oldest:
                _delete(spark, f"{folder}/ym={month}")
                done["dropped"].append((tier, month))
            elif first < oldest and _rewrite(spark, root, tier, month, oldest):
                done["rewritten"].append((tier, month))
    return done
