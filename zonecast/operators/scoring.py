"""Probabilistic scores: CRPS, reliability, fold summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scores as S

METRICS = ["crps", "mae", "spike_mae", "coverage", "interval_width"]


def _valid(scored: DataFrame) -> DataFrame:
    return scored.where(S.all_present(F.col("y"), F.col("q50")))


def eval_metrics(scored: DataFrame, keys: Sequence[str] = ("zone", "model"), spike_threshold: float = S.SPIKE_PRICE) -> DataFrame:
    """One row per key with a valid pair; spike MAE is null without spikes, the CRPS covers the rows with a whole band."""
    y, lo, mid, hi = F.col("y"), F.col("q05"), F.col("q50"), F.col("q95")
    hit = F.coalesce(((y >= lo) & (y <= hi)).cast("double"), F.lit(0.0))
    return S.with_crps(_valid(scored), name="_crps").groupBy(*keys).agg(
        F.avg("_crps").alias("crps"),
        F.avg(F.abs(y - mid)).alias("mae"),
        F.avg(F.when(y > spike_threshold, F.abs(y - mid))).alias("spike_mae"),
        F.avg(hit).alias("coverage"),
        F.avg(hi - lo).alias("interval_width"),
    )


def reliability(scored: DataFrame, keys: Sequence[str] = ("zone", "model"), levels: Sequence[float] = tuple(S.NOMINAL_LEVELS)) -> DataFrame:
    """Observed share at or below each nominal level, of the rows with a whole band.

    All levels are counted in one aggregation and turned into rows afterwards, so rows are not multiplied by levels.
    """
    y, mid = F.col("y"), F.col("q50")
    sigma = S.gaussian_sigma(F.col("q05"), F.col("q95"))
    shares = [
        F.avg((y <= mid + sigma * F.lit(S.normal_quantile(p))).cast("double")).alias(f"_p{i}") for i, p in enumerate(levels)
    ]
    wide = _valid(scored).groupBy(*keys).agg(*shares)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("nominal"), F.col(f"_p{i}").alias("observed"))
                     for i, p in enumerate(levels)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.nominal", "r.observed")


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and sample deviation of every metric over folds."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*keys).agg(*aggs)


def reliability_over_folds(fold_reliability: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return fold_reliability.groupBy(*keys, "nominal").agg(F.avg("observed").alias("observed"))
