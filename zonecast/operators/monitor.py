"""Threshold alerts, drift reports, retrain gate, promotion history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.operators.metrics import monitoring_metrics
from zonecast.sources.dims import BASELINE_DAYS, WINDOW_DAYS, lookup_required

ALERT = "struct<metric:string,value:double,threshold:double,reason:string>"


def _alert(when: Column, metric: str, value: Column, threshold: Column, reason: Column) -> Column:
    body = F.struct(F.lit(metric).alias("metric"), F.round(value, 4).alias("value"),
                    threshold.alias("threshold"), reason.alias("reason"))
    return F.when(F.coalesce(when, F.lit(False)), body.cast(ALERT))


def with_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics per zone plus ``alerts``; ``baseline_pinball_q50`` may be null. All comparisons are strict.

    Zones with fewer aligned hours than the minimum raise nothing; a zone without thresholds fails the job. Coverage
    below its minimum is not also tested against the maximum.
    """
    joined = lookup_required(metrics, thresholds, "zone", "min_hours", "threshold zone")
    rmae, pin, cov = F.col("rmae"), F.col("pinball_q50"), F.col("coverage_rate")
    base = F.col("baseline_pinball_q50")
    limit = base * F.col("pinball_q50_multiplier")
    candidates = F.array(
        _alert(rmae > F.col("rmae_max"), "rmae", rmae, F.col("rmae_max"),
               F.format_string("Relative error %.3f above its limit %.2f; against yesterday's price the error changes by %+.1f%%",
                               rmae, F.col("rmae_max"), (rmae - 1) * 100)),
        _alert((base > 0) & (pin > limit), "pinball_q50", pin, F.round(limit, 4),
               F.format_string("Median loss %.2f EUR/MWh, allowed are %.1f times the long-run %.2f EUR/MWh",
                               pin, F.col("pinball_q50_multiplier"), base)),
        _alert(cov < F.col("coverage_min"), "coverage_rate", cov, F.col("coverage_min"),
               F.format_string("Bands hold %.1f%% of the prices, at least %.0f%% are wanted; widen them",
                               cov * 100, F.col("coverage_min") * 100)),
        _alert(~(cov < F.col("coverage_min")) & (cov > F.col("coverage_max")), "coverage_rate", cov, F.col("coverage_max"),
               F.format_string("Bands hold %.1f%% of the prices, at most %.0f%% are wanted; narrow them",
                               cov * 100, F.col("coverage_max") * 100)),
    )
    enough = F.col("n_hours") >= F.col("min_hours")
    alerts = F.when(enough, F.filter(candidates, lambda a: a.isNotNull())).otherwise(
        F.array().cast(f"array<{ALERT}>")
    )
    return joined.select(*metrics.columns, F.coalesce(alerts, F.array().cast(f"array<{ALERT}>")).alias("alerts"))


def threshold_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per alert."""
    return with_alerts(metrics, thresholds).select("zone", F.explode("alerts").alias("a")).select("zone", "a.*")


def drift_report(actuals: DataFrame, forecasts: DataFrame, thresholds: DataFrame, window_days: int = WINDOW_DAYS,
                 baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """One report row per zone: rounded metrics, baseline, alerts, drift flag; zones without forecasts get a warning."""
    have = forecasts.where(F.col("q50").isNotNull()).select("zone").distinct().withColumn("_has", F.lit(True))
    metrics = monitoring_metrics(actuals, forecasts, window_days, baseline_days)
    report = with_alerts(metrics, thresholds).join(have, "zone", "left")
    has = F.coalesce("_has", F.lit(False))
    names = ["mae_eur", "naive_mae_eur", "rmae", "pinball_q50", "pinball_q05", "pinball_q95", "coverage_rate"]
    return report.select(
        "zone",
        F.lit(window_days).alias("window_days"),
        F.lit(baseline_days).alias("baseline_days"),
        *[F.when(has, F.round(n, 4)).alias(n) for n in names],
        F.when(has, F.col("n_hours")).alias("n_hours"),
        F.round("baseline_pinball_q50", 4).alias("baseline_pinball_q50"),
        F.when(has, F.col("alerts")).otherwise(F.array().cast(f"array<{ALERT}>")).alias("alerts"),
        (has & (F.size("alerts") > 0)).alias("drift_detected"),
        F.when(~has, F.lit("This zone has no stored forecast")).alias("warning"),
    )


def any_drift(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("any_drift"))


def report_json(report: DataFrame, run_at: Column | None = None) -> DataFrame:
    """Nested report per zone as one JSON line; run time defaults to now."""
    stamped = report.withColumn("run_at", F.current_timestamp() if run_at is None else run_at)
    names = ["mae_eur", "naive_mae_eur", "rmae", "pinball_q50", "pinball_q05", "pinball_q95", "coverage_rate", "n_hours"]
    body = F.struct("zone", "run_at", "window_days", "baseline_days", F.struct(*names).alias("metrics"),
                    "baseline_pinball_q50", "alerts", "drift_detected", "warning")
    return stamped.select("zone", F.to_json(body).alias("report"))


def retrain_gate(prices: DataFrame, trained: DataFrame, max_gap_days: float = 7.0, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Skip training while the newest price is less than a week past the last training; unknown inputs retrain."""
    k = list(keys)
    latest = prices.groupBy(*k).agg(F.max("valid_time").alias("latest_price"))
    gap = (F.unix_seconds("latest_price") - F.unix_seconds("trained_at")) / 86400.0
    return trained.join(latest, k, "full").select(
        *k, "trained_at", "latest_price", gap.alias("gap_days"),
        F.coalesce(gap < max_gap_days, F.lit(False)).alias("skip"),
    )


def promotion_history(runs: DataFrame, model: str = "model_name", version: str = "version", mae: str = "mae") -> DataFrame:
    """Champion decision per registered run.

    A run is promoted if there is no champion with a known error or if it is strictly better than the best recorded
    (4-digit) error so far; since every champion is the best so far, a running minimum replaces the sequential rule.
    """
    before = Window.partitionBy(model).orderBy(version).rowsBetween(Window.unboundedPreceding, -1)
    champion = F.min(F.round(mae, 4)).over(before)
    out = runs.withColumn("champion_mae", champion)
    promoted = F.col("champion_mae").isNull() | F.coalesce(F.col(mae) < F.col("champion_mae"), F.lit(False))
    return out.withColumn("action", F.when(promoted, "promoted").otherwise("challenger"))


def current_champion(history: DataFrame, model: str = "model_name", version: str = "version") -> DataFrame:
    """Latest promoted version per model."""
    return history.where(F.col("action") == "promoted").groupBy(model).agg(F.max(version).alias("champion_version"))


def run_delta(runs: DataFrame, keys: Sequence[str] = ("zone", "model"), order: str = "run_time") -> DataFrame:
    """Change of MAE and coverage against the previous run (null for the first)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return runs.withColumns({
        "mae_delta": F.col("mae") - F.lag("mae").over(w),
        "coverage_delta": F.col("coverage_q5_q95") - F.lag("coverage_q5_q95").over(w),
    })


def valid_requests(requests: DataFrame, today: dt.date) -> DataFrame:
    """Forecast requests marked valid: the delivery date must be tomorrow or later."""
    ok = F.to_date("date") >= F.lit(today + dt.timedelta(days=1))
    return requests.withColumn("valid", F.coalesce(ok, F.lit(False)))
