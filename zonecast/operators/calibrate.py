"""Split-conformal calibration and quantile ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scores as S
from zonecast.operators.modeltable import attach
from zonecast.operators.quantiles import exact_quantiles

TARGET_COVERAGE = 0.90


def conformal_fit(scored: DataFrame, keys: Sequence[str] = ("zone", "model"), target_coverage: float = TARGET_COVERAGE) -> DataFrame:
    """Per key: correction, calibration size, target and raw coverage.

    Score ``max(q05 - y, y - q95)``; its quantile at ``min(ceil((n+1) * coverage) / n, 1)`` is the correction. A key
    without any complete row has no result; see ``require_calibration``.
    """
    k = list(keys)
    y, lo, hi = F.col("y"), F.col("q05"), F.col("q95")
    rows = scored.where(S.all_present(y, lo, hi)).select(*k, F.greatest(lo - y, y - hi).alias("score"))
    # the floating-point path 1 - (1 - coverage) matters where (n + 1) * coverage is a whole number
    level = f"least(ceil((n + 1) * {1 - (1.0 - target_coverage)!r}D) / n, 1D)"
    # the score is <= 0 exactly where the actual lies inside the closed interval
    found = exact_quantiles(rows, k, "score", {"correction": level}, extra={"_inside": "if(_v <= 0, _m, 0)"})
    return found.select(
        *k, "correction", F.col("n").alias("n_calibration"), F.lit(target_coverage).alias("target_coverage"),
        F.expr("_inside / n").alias("raw_coverage"),
    )


def require_calibration(fit: DataFrame) -> DataFrame:
    if fit.isEmpty():
        raise ValueError("No overlapping non-null rows - cannot calibrate")
    return fit


def conformal_apply(forecasts: DataFrame, fit: DataFrame, keys: Sequence[str] = ("zone", "model"), apply: bool = True) -> DataFrame:
    """Widen by a positive correction only; the median never moves; keys without a fit pass unchanged.

    ``fit`` should be materialised: it is counted to decide how it is joined.
    """
    if not apply:
        return forecasts
    k = list(keys)
    joined = attach(forecasts, fit.select(*k, F.greatest("correction", F.lit(0.0)).alias("_c")), k)
    c = F.coalesce("_c", F.lit(0.0))
    return joined.withColumns({"q05": F.col("q05") - c, "q95": F.col("q95") + c}).drop("_c").select(*forecasts.columns)


def order_quantiles(forecasts: DataFrame, lo: str = "q05", mid: str = "q50", hi: str = "q95") -> DataFrame:
    """Pull crossing outer quantiles to the median; null if either side is null."""
    return forecasts.withColumns({
        lo: S.null_safe_least(F.col(lo), F.col(mid)),
        hi: S.null_safe_greatest(F.col(hi), F.col(mid)),
    })
