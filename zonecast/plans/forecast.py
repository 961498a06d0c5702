"""Batch forecasts for a table of requests ``zone, date``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators.features import HISTORY_HOURS, delivery_day
from zonecast.operators.monitor import valid_requests
from zonecast.sources import bitemporal, dims

ENSEMBLE_SERIES = {q: dims.SERIES[q] for q in ("ens_q05", "ens_q50", "ens_q95")}


def split_requests(requests: DataFrame, today: dt.date) -> tuple[DataFrame, DataFrame]:
    """Requests for tomorrow or later, and the rejected ones."""
    marked = valid_requests(requests, today)
    return marked.where("valid").drop("valid"), marked.where("NOT valid").drop("valid")


def history_start(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=HISTORY_HOURS)


def requested_rows(matrix: DataFrame, requests: DataFrame) -> DataFrame:
    """Feature rows of the requested delivery days; raises unless every requested day has exactly 24.

    ``matrix`` must reach back over the feature history of the earliest request.
    """
    wanted = requests.select("zone", F.to_date("date").alias("_day")).distinct()
    rows = matrix.withColumn("_day", F.to_date("valid_time")).join(wanted, ["zone", "_day"], "left_semi")
    counted = rows.groupBy("zone", "_day").agg(F.count(F.lit(1)).alias("_rows"))
    checked = wanted.join(counted, ["zone", "_day"], "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    # an action on purpose: a filter inside the plan would be skipped where a request has no rows at all
    bad = checked.where(F.col("_rows") != 24).limit(1).collect()
    if bad:
        raise ValueError(f"Expected 24 feature rows for {bad[0]['zone']} on {bad[0]['_day']}, got {bad[0]['_rows']}")
    return rows.drop("_day")


def hourly_response(predictions: DataFrame, model_version: str, generated_at=None) -> DataFrame:
    """``ens_q05/q50/q95`` rows to one nested row per zone and UTC date with its 24 hours in order, rounded."""
    hour = F.struct(
        F.hour("valid_time").alias("hour"), F.round("ens_q50", 2).alias("point"), F.round("ens_q05", 2).alias("q05"),
        F.round("ens_q95", 2).alias("q95"),
    )
    stamp = F.current_timestamp() if generated_at is None else F.lit(generated_at).cast("timestamp")
    # a group is one day of one zone: 24 entries
    return predictions.groupBy("zone", F.to_date("valid_time").alias("date")).agg(
        F.array_sort(F.collect_list(hour)).alias("forecast")
    ).select("zone", "date", F.lit(model_version).alias("model_version"), stamp.alias("generated_at"), "forecast")


def batch_forecast(matrix: DataFrame, requests: DataFrame, predict: Callable[[DataFrame], DataFrame],
                   model_version: str, generated_at=None) -> DataFrame:
    """Slice the requested days, score them once, answer one nested row per request."""
    scored = predict(requested_rows(matrix, requests))
    answers = hourly_response(scored, model_version, generated_at)
    return requests.select("zone", F.to_date("date").alias("date")).join(answers, ["zone", "date"])


def served_versions(predictions: DataFrame, knowledge_time=None) -> DataFrame:
    """Served quantiles as bitemporal versions (non-null only), under the real valid times."""
    return bitemporal.forecasts_to_versions(predictions, ENSEMBLE_SERIES, knowledge_time)


__all__ = ["split_requests", "history_start", "requested_rows", "hourly_response", "batch_forecast",
           "served_versions", "delivery_day"]
