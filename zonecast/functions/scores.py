"""Loss and score formulas as columns and aggregate columns.

Inputs may be null; every aggregate looks only at rows on which its own inputs are present, so one ``agg`` call can
carry all of them.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NIGHT_HOURS = [0, 1, 2, 3, 4, 5, 23]
PEAK_HOURS = [8, 9, 17, 18, 19, 20]
NOMINAL_LEVELS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
SPIKE_PRICE = 100.0


def all_present(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull()
    return ok


def null_safe_least(a: Column, b: Column) -> Column:
    """Null if either side is null (``least`` alone skips nulls)."""
    return F.when(all_present(a, b), F.least(a, b))


def null_safe_greatest(a: Column, b: Column) -> Column:
    return F.when(all_present(a, b), F.greatest(a, b))


def abs_error(y: Column, f: Column) -> Column:
    return F.abs(y - f)


def pinball(y: Column, f: Column, q: float | Column) -> Column:
    q = F.lit(q) if isinstance(q, float) else q
    return F.when(y >= f, q * (y - f)).otherwise((1 - q) * (f - y))


def inside(y: Column, lo: Column, hi: Column) -> Column:
    return F.when(all_present(y, lo, hi), ((y >= lo) & (y <= hi)).cast("double"))


def _mean_of_pairs(value: Column, present: Column, min_pairs: int = 2) -> Column:
    kept = F.when(present, value)
    return F.when(F.count(kept) >= min_pairs, F.avg(kept))


# --- monitoring family: fewer than two pairs gives null ---


def mae_agg(y: Column, f: Column) -> Column:
    return _mean_of_pairs(abs_error(y, f), all_present(y, f))


def pinball_agg(y: Column, f: Column, q: float) -> Column:
    return _mean_of_pairs(pinball(y, f, q), all_present(y, f))


def coverage_agg(y: Column, lo: Column, hi: Column) -> Column:
    return _mean_of_pairs(inside(y, lo, hi), all_present(y, lo, hi))


def relative_mae(mae: Column, naive: Column) -> Column:
    return F.when(naive != 0, mae / naive)


# --- Gaussian scores from three quantiles ---


def gaussian_sigma(lo: Column, hi: Column) -> Column:
    """Deviation of the Gaussian with this 90 % band; null if a side is missing (``greatest`` alone skips nulls)."""
    return null_safe_greatest((hi - lo) / 3.29, F.lit(1e-3))


def with_crps(df: DataFrame, y: str = "y", mu: str = "q50", lo: str = "q05", hi: str = "q95", name: str = "crps") -> DataFrame:
    """Per-row CRPS of the Gaussian with the given median and 90 % band, in small stacked projections; null without a band.

    The error function is Abramowitz & Stegun 7.1.26 (absolute error below 1.5e-7).
    """
    df = df.withColumn("_sg", gaussian_sigma(F.col(lo), F.col(hi)))
    df = df.withColumn("_z", F.expr(f"({y} - {mu}) / _sg"))
    df = df.withColumn("_t", F.expr("1 / (1 + 0.3275911D * abs(_z) / sqrt(2D))"))
    poly = "_t * (0.254829592D + _t * (-0.284496736D + _t * (1.421413741D + _t * (-1.453152027D + _t * 1.061405429D))))"
    df = df.withColumns({"_e": F.expr("exp(-0.5D * _z * _z)"), "_p": F.expr(poly)})
    two_phi_minus_one = "signum(_z) * (1 - _p * _e)"
    crps = f"_sg * (_z * {two_phi_minus_one} + 2 * _e / sqrt(2 * pi()) - 1 / sqrt(pi()))"
    return df.withColumn(name, F.expr(crps)).drop("_sg", "_z", "_t", "_e", "_p")


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
