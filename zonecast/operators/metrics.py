"""Forecast accuracy over scored frames ``zone, valid_time, [model,] y, q05, q50, q95``.

Each metric set is one conditional aggregation, so it combines on the map side and all zones and models share a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scores as S
from zonecast.operators.blocks import add_row_position, last_rows


def aligned(actuals: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("zone", "valid_time")) -> DataFrame:
    """Pairs on which both sides are known (inner join, nulls dropped)."""
    return actuals.join(forecasts, list(keys)).na.drop("any", subset=["y", "q50"])


def on_forecast_axis(actuals: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("zone", "valid_time")) -> DataFrame:
    """Every forecast row, with the actual where known."""
    return forecasts.join(actuals, list(keys), "left")


def on_actual_axis(actuals: DataFrame, forecasts: DataFrame, keys: Sequence[str] = ("zone", "valid_time")) -> DataFrame:
    """Every actual row, with the forecast where known."""
    return actuals.join(forecasts, list(keys), "left")


def point_metrics(scored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """MAE, three pinball losses and coverage; each is null on fewer than two pairs."""
    y, lo, mid, hi = F.col("y"), F.col("q05"), F.col("q50"), F.col("q95")
    return scored.groupBy(*keys).agg(
        S.mae_agg(y, mid).alias("mae_eur"),
        S.pinball_agg(y, mid, 0.5).alias("pinball_q50"),
        S.pinball_agg(y, lo, 0.05).alias("pinball_q05"),
        S.pinball_agg(y, hi, 0.95).alias("pinball_q95"),
        S.coverage_agg(y, lo, hi).alias("coverage_rate"),
    )


def with_naive(actuals: DataFrame, keys: Sequence[str] = ("zone",), lag_rows: int = 24) -> DataFrame:
    """The value ``lag_rows`` rows earlier as ``naive`` (by position, so gaps shift it), for slices of any length."""
    k = list(keys)
    ranked = add_row_position(actuals, k, "valid_time")
    earlier = ranked.select(*k, (F.col("_pos") + lag_rows).alias("_pos"), F.col("y").alias("naive"))
    return ranked.join(earlier, [*k, "_pos"], "left").drop("_pos", "_n")


def naive_mae(actuals: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Error of the same-hour-yesterday forecast; null on fewer than two pairs."""
    return with_naive(actuals, keys).groupBy(*keys).agg(S.mae_agg(F.col("y"), F.col("naive")).alias("naive_mae_eur"))


def monitoring_metrics(actuals: DataFrame, forecasts: DataFrame, window_days: int = 7, baseline_days: int = 90) -> DataFrame:
    """The eight rolling metrics and the baseline median pinball loss of every zone in one pass.

    Both windows are counted in actual rows (``days * 24`` last rows), forecasts are joined where known. Cut the
    forecasts to a sensible time range before calling when their history is much longer than the baseline.
    """
    window, longest = window_days * 24, max(window_days, baseline_days) * 24
    tail = last_rows(actuals.select("zone", "valid_time", "y"), ["zone"], "valid_time", longest, keep_age="_age")
    # at most ``longest`` rows per zone remain; the lag must not look past the rolling window
    lagged = "lag(y, 24) OVER (PARTITION BY zone ORDER BY valid_time)"
    tail = tail.withColumn("naive", F.expr(f"if(_age + 24 < {window}, {lagged}, NULL)"))
    scored = on_actual_axis(tail, forecasts.select("zone", "valid_time", "q05", "q50", "q95"))

    def within(name: str, days: int) -> Column:
        return F.expr(f"if(_age < {days * 24}, {name}, NULL)")

    y, lo, mid, hi = (within(c, window_days) for c in ("y", "q05", "q50", "q95"))
    out = scored.groupBy("zone").agg(
        S.mae_agg(y, mid).alias("mae_eur"),
        S.mae_agg(y, F.col("naive")).alias("naive_mae_eur"),
        S.pinball_agg(y, mid, 0.5).alias("pinball_q50"),
        S.pinball_agg(y, lo, 0.05).alias("pinball_q05"),
        S.pinball_agg(y, hi, 0.95).alias("pinball_q95"),
        S.coverage_agg(y, lo, hi).alias("coverage_rate"),
        F.count_if(S.all_present(y, mid)).alias("n_hours"),
        S.pinball_agg(within("y", baseline_days), within("q50", baseline_days), 0.5).alias("baseline_pinball_q50"),
    )
    return out.withColumn("rmae", S.relative_mae(F.col("mae_eur"), F.col("naive_mae_eur"))).select(
        "zone", "mae_eur", "naive_mae_eur", "rmae", "pinball_q50", "pinball_q05", "pinball_q95", "coverage_rate",
        "n_hours", "baseline_pinball_q50",
    )


def rolling_metrics(actuals: DataFrame, forecasts: DataFrame, window_days: int = 7) -> DataFrame:
    """The eight monitoring metrics over each zone's last ``window_days * 24`` actual rows."""
    return monitoring_metrics(actuals, forecasts, window_days, window_days).drop("baseline_pinball_q50")


def baseline_pinball(actuals: DataFrame, forecasts: DataFrame, baseline_days: int = 90) -> DataFrame:
    """Median pinball loss over each zone's last ``baseline_days * 24`` actual rows."""
    tail = last_rows(actuals.select("zone", "valid_time", "y"), ["zone"], "valid_time", baseline_days * 24)
    scored = on_actual_axis(tail, forecasts.select("zone", "valid_time", "q50"))
    return scored.groupBy("zone").agg(S.pinball_agg(F.col("y"), F.col("q50"), 0.5).alias("baseline_pinball_q50"))


def _mean_or_zero(value: Column, cond: Column) -> Column:
    return F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0))


def holdout_metrics(scored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Training-report metrics over rows with actual and median; empty subsets give 0, coverage is in percent."""
    y, lo, mid, hi = F.col("y"), F.col("q05"), F.col("q50"), F.col("q95")
    err = mid - y
    hit = F.coalesce(((y >= lo) & (y <= hi)).cast("double"), F.lit(0.0))
    hour = F.hour("valid_time")
    return (
        scored.where(S.all_present(y, mid))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_hours"),
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            _mean_or_zero(F.abs(err / y) * 100, F.abs(y) >= 1.0).alias("mape"),
            (F.avg(hit) * 100).alias("coverage_q5_q95"),
            _mean_or_zero(F.abs(err), y > S.SPIKE_PRICE).alias("spike_mae"),
            F.count_if(y > S.SPIKE_PRICE).alias("n_spikes"),
            _mean_or_zero(F.abs(err), hour.isin(S.NIGHT_HOURS)).alias("night_mae"),
            _mean_or_zero(F.abs(err), hour.isin(S.PEAK_HOURS)).alias("peak_mae"),
        )
    )


def mae_by_hour(scored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    return (
        scored.where(S.all_present(F.col("y"), F.col("q50")))
        .groupBy(*keys, F.hour("valid_time").alias("hour"))
        .agg(F.avg(F.abs(F.col("q50") - F.col("y"))).alias("mae"))
    )


def mae_by_hour_map(scored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Hour (as string) to MAE; at most 24 entries per key."""
    entry = F.struct(F.col("hour").cast("string").alias("key"), F.col("mae").alias("value"))
    return mae_by_hour(scored, keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("mae_by_hour")
    )


def daily_mae(scored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Mean absolute error per UTC day, empty days left out."""
    return (
        scored.where(S.all_present(F.col("y"), F.col("q50")))
        .groupBy(*keys, F.date_trunc("day", F.col("valid_time")).alias("day"))
        .agg(F.avg(F.abs(F.col("q50") - F.col("y"))).alias("mae"))
    )


def error_histogram(scored: DataFrame, keys: Sequence[str] = ("zone",), bins: int = 40) -> DataFrame:
    """Counts of ``q50 - y`` in equal-width bins between each key's smallest and largest error."""
    err = scored.where(S.all_present(F.col("y"), F.col("q50"))).select(*keys, (F.col("q50") - F.col("y")).alias("err"))
    span = err.groupBy(*keys).agg(F.min("err").alias("lo"), F.max("err").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.when(width > 0, F.floor((F.col("err") - F.col("lo")) / width)).otherwise(F.lit(0))
    binned = err.join(span, list(keys)).select(
        *keys, F.least(raw, F.lit(bins - 1)).cast("int").alias("bin"), "lo", width.alias("width")
    )
    return (
        binned.groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("_lo"), F.min("width").alias("_w"))
        .select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left_edge"), "n")
    )


def price_statistics(series: DataFrame, keys: Sequence[str] = ("zone",), value: str = "price") -> DataFrame:
    return series.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_samp(value).alias("std"),
    )


def last_forecasts(forecasts: DataFrame, n: int = 24) -> DataFrame:
    """Each zone's last ``n`` rows that have a median forecast."""
    return last_rows(forecasts.where(F.col("q50").isNotNull()), ["zone"], "valid_time", n)


def forecast_kpis(forecasts: DataFrame, n: int = 24) -> DataFrame:
    """Mean, peak and its first hour, overnight low and mean half width over the last ``n`` forecasts."""
    night = F.hour("valid_time") <= 5
    # the earliest of equal peaks wins
    rank = F.struct(F.col("q50"), -F.unix_seconds("valid_time"))
    return last_forecasts(forecasts, n).groupBy("zone").agg(
        F.avg("q50").alias("mean_q50"),
        F.max("q50").alias("peak_q50"),
        F.max_by("valid_time", rank).alias("peak_time"),
        F.min(F.when(night, F.col("q50"))).alias("overnight_low"),
        F.avg((F.col("q95") - F.col("q05")) / 2).alias("half_width"),
    )


def spike_analysis(scored: DataFrame, keys: Sequence[str] = ("zone",), threshold: float = S.SPIKE_PRICE) -> DataFrame:
    """Spike hours counts every actual above the threshold; the errors need a forecast too."""
    err = F.abs(F.col("y") - F.col("q50"))
    return scored.groupBy(*keys).agg(
        F.count_if(F.col("y") > threshold).alias("n_spikes"),
        F.avg(F.when(F.col("y") > threshold, err)).alias("spike_mae"),
        F.avg(err).alias("overall_mae"),
    )


def backtest_table(scored: DataFrame, keys: Sequence[str] = ("zone",), digits: int = 2) -> DataFrame:
    """Detail rows with both sides known, rounded for display."""
    err = F.col("q50") - F.col("y")
    rows = scored.where(S.all_present(F.col("y"), F.col("q50")))
    cols = {"actual": F.col("y"), "q50": F.col("q50"), "q05": F.col("q05"), "q95": F.col("q95"), "error": err,
            "abs_error": F.abs(err)}
    return rows.select(*keys, "valid_time", *[F.round(c, digits).alias(n) for n, c in cols.items()])


def backtest_kpis(scored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    y, lo, mid, hi = F.col("y"), F.col("q05"), F.col("q50"), F.col("q95")
    both = S.all_present(y, mid)
    hit = F.coalesce(((y >= lo) & (y <= hi)).cast("double"), F.lit(0.0))
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"),
        F.count_if(both).alias("n_forecast"),
        (F.avg(both.cast("double")) * 100).alias("forecast_share"),
        F.avg(F.when(both, F.abs(mid - y))).alias("mae"),
        (F.avg(F.when(both, hit)) * 100).alias("coverage"),
    )


def stored_vs_live(scored_live: DataFrame, scored_stored: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Stored forecasts against the live re-run: hours stored, share of the window, MAE and its difference.

    ``scored_stored`` is on the stored forecasts' own axis (the actual may be missing there).
    """
    k = list(keys)
    live = scored_live.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_window"), F.avg(F.abs(F.col("q50") - F.col("y"))).alias("mae_live")
    )
    stored = scored_stored.groupBy(*k).agg(
        F.count("q50").alias("n_stored"), F.avg(F.abs(F.col("y") - F.col("q50"))).alias("mae_stored")
    )
    return live.join(stored, k, "left").select(
        *k,
        F.coalesce("n_stored", F.lit(0)).alias("n_stored"),
        (100.0 * F.coalesce("n_stored", F.lit(0)) / F.col("n_window")).alias("stored_share"),
        "mae_stored",
        "mae_live",
        (F.col("mae_stored") - F.col("mae_live")).alias("delta_mae"),
    )


def model_comparison(metrics: DataFrame, models: Sequence[str], keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Metric by model table from holdout metrics."""
    names = ["mae", "rmse", "mape", "coverage_q5_q95"]
    long = metrics.unpivot([*keys, "model"], names, "metric", "value")
    return long.groupBy(*keys, "metric").pivot("model", list(models)).agg(F.first("value"))


def period_breakdown(metrics: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Overall, night and peak MAE as rows."""
    named = metrics.select(*keys, F.col("mae").alias("overall"), F.col("night_mae").alias("night"),
                           F.col("peak_mae").alias("peak"))
    return named.unpivot(list(keys), ["overall", "night", "peak"], "period", "mae")


def prefer_stored(stored: DataFrame, live: DataFrame, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """All forecasts of the stored source for zones that have any, the live ones for the others."""
    have = stored.where(F.col("q50").isNotNull()).select(*keys).distinct()
    cols = [*keys, "valid_time", "q05", "q50", "q95"]
    fallback = live.join(have, list(keys), "left_anti")
    return stored.join(have, list(keys), "left_semi").select(*cols, F.lit("stored").alias("source")).unionByName(
        fallback.select(*cols, F.lit("live").alias("source"))
    )


def round_forecast(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in ("q05", "q50", "q95")})
