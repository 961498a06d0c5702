"""LEAR: one Lasso per zone and hour of day, fitted from moment matrices.

A single pass turns the rows into sums of products per ``(zone, hour, validation block)``. Means, deviations,
cross-validation errors and the final fit all follow from those sums, so the penalty search never rereads the data
and the per-group work is a 24 x 24 matrix, whatever the history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.operators.blocks import add_row_position
from zonecast.operators.modeltable import attach
from zonecast.operators.quantiles import small_group_quantile
from zonecast.session import materialize

# --- fixed values ---
ALPHAS = [1e-4, 5e-4, 1e-3, 5e-3, 1e-2, 5e-2, 1e-1, 5e-1]
RESIDUAL_ROWS = 365 * 24
MIN_ROWS = 60
N_SPLITS = 3
FEATURES = [
    "price_lag23h", "price_lag24h", "price_lag25h", "price_lag48h", "price_lag72h", "price_lag168h", "price_lag336h",
    "price_roll24h", "price_roll168h",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos", "is_holiday", "temperature",
    "wind_speed", "irradiance", "hour_x_month", "weekend_x_hour", "temp_x_hour",
]
# --- end of fixed values ---

MODEL_SCHEMA = "zone string, hour int, n long, alpha double, intercept double, coef array<double>"


def moments(width: int):
    """Per batch: sums of products of (1, features, label) by zone, hour and block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            keys, cells = [], []
            for key, part in pdf.groupby(["zone", "hour", "cv_block"], sort=False):
                a = np.column_stack([np.ones(len(part)), np.stack(part["v"].to_numpy())])
                keys.append(key)
                cells.append((a.T @ a)[np.triu_indices(width)])
            out = pd.DataFrame(keys, columns=["zone", "hour", "cv_block"])
            yield out.assign(cells=cells)

    return run


def _duality_gap(q: np.ndarray, c: np.ndarray, yy: float, beta: np.ndarray, fit: np.ndarray, penalty: float) -> float:
    """Lasso duality gap in terms of the moments (``fit`` is ``q @ beta``)."""
    slope = np.abs(c - fit).max()
    resid = max(yy - 2 * beta @ c + beta @ fit, 0.0)
    shrink = min(1.0, penalty / slope) if slope > 0 else 1.0
    primal = 0.5 * resid + penalty * np.abs(beta).sum()
    dual = shrink * (yy - beta @ c) - 0.5 * shrink**2 * resid
    return primal - dual


def _exact_on_support(q: np.ndarray, c: np.ndarray, beta: np.ndarray, penalty: float) -> np.ndarray | None:
    """Solution with the support and signs of ``beta``, if it satisfies the optimality conditions."""
    on = np.flatnonzero(beta)
    out = np.zeros(len(c))
    if len(on):
        signs = np.sign(beta[on])
        try:
            out[on] = np.linalg.solve(q[np.ix_(on, on)], c[on] - penalty * signs)
        except np.linalg.LinAlgError:
            return None
        if not np.all(np.isfinite(out)) or np.any(np.sign(out[on]) != signs):
            return None
    slope = np.abs(c - q @ out)
    return out if slope.max(initial=0.0) <= penalty * (1 + 1e-6) + 1e-9 * np.abs(c).max(initial=0.0) else None


def lasso_from_moments(gram: np.ndarray, alpha: float, start: np.ndarray | None = None, max_iter: int = 10_000,
                       tol: float = 1e-4) -> tuple[float, np.ndarray]:
    """Intercept and coefficients minimising ``|y - b0 - Xb|^2 / 2n + alpha |b|_1``; ``gram`` is of (1, X, y)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    q, c, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    penalty = n * alpha
    usable = [j for j in range(len(c)) if q[j, j] > 1e-12 * n]
    beta = np.zeros(len(c)) if start is None else start.copy()
    fit = q @ beta
    for sweep in range(max_iter):
        for j in usable:
            old = beta[j]
            rho = c[j] - fit[j] + q[j, j] * old
            new = np.sign(rho) * max(abs(rho) - penalty, 0.0) / q[j, j]
            if new != old:
                beta[j] = new
                fit += q[:, j] * (new - old)
        if sweep % 5 == 4:
            exact = _exact_on_support(q, c, beta, penalty)
            if exact is not None:
                beta = exact
                break
            if _duality_gap(q, c, yy, beta, fit, penalty) <= tol * max(yy, 1e-12):
                break
    return float(mean[-1] - mean[:-1] @ beta), beta


def _squared_error(gram: np.ndarray, b0: float, beta: np.ndarray) -> float:
    w = np.concatenate([[-b0], -beta, [1.0]])
    return float(w @ gram @ w)


def _standardise(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, p = gram[0, 0], gram.shape[0] - 2
    mean = gram[0, 1:-1] / n
    var = np.maximum(np.diag(gram)[1:-1] / n - mean**2, 0.0)
    sd = np.sqrt(var)
    sd[var <= 1e-12 * np.maximum(mean**2, 1e-12)] = 1.0
    t = np.eye(p + 2)
    t[1:-1, 1:-1] = np.diag(1.0 / sd)
    t[0, 1:-1] = -mean / sd
    return mean, sd, t


def solve_blocks(blocks: np.ndarray, alphas: Sequence[float]) -> tuple[float, float, np.ndarray]:
    """Penalty, intercept and coefficients from the moments of (1, features, label) in the expanding blocks.

    The penalty has the least mean squared error over the splits (of equals the largest); features are standardised over
    all blocks, and the result is in their own units.
    """
    total = blocks.sum(axis=0)
    mean, sd, t = _standardise(total)
    scaled = np.stack([t.T @ b @ t for b in blocks])
    ordered = sorted(alphas, reverse=True)
    errors = np.zeros(len(ordered))
    for split in range(N_SPLITS):
        train, test = scaled[: split + 1].sum(axis=0), scaled[split + 1]
        warm = None
        for i, a in enumerate(ordered):
            b0, warm = lasso_from_moments(train, a, warm)
            errors[i] += _squared_error(test, b0, warm) / max(test[0, 0], 1.0) / N_SPLITS
    best = ordered[int(np.argmin(errors))]
    b0, beta = lasso_from_moments(scaled.sum(axis=0), best)
    coef = beta / sd
    return best, b0 - float(coef @ mean), coef


def unfolded(width: int, pos: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The symmetric moment matrix of its upper triangle's cells."""
    m = np.zeros((width, width))
    upper = np.triu_indices(width)
    m[upper[0][pos], upper[1][pos]] = cell
    return m + np.triu(m, 1).T


def _solve_hour(width: int, min_rows: int, alphas: Sequence[float]):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = np.zeros((N_SPLITS + 1, width, width))
        for block, part in pdf.groupby("cv_block"):
            blocks[int(block)] = unfolded(width, part["pos"].to_numpy(), part["cell"].to_numpy())
        n = int(round(blocks[:, 0, 0].sum()))
        cols = ["zone", "hour", "n", "alpha", "intercept", "coef"]
        if n < min_rows:
            return pd.DataFrame(columns=cols)
        best, intercept, coef = solve_blocks(blocks, alphas)
        return pd.DataFrame([[key[0], int(key[1]), n, best, intercept, coef.tolist()]], columns=cols)

    return run


def linear(features: Sequence[str], coef: str = "coef", intercept: str = "intercept") -> Column:
    total = F.col(intercept)
    for i, c in enumerate(features):
        total = total + F.col(coef)[i] * F.col(c).cast("double")
    return total


def available_features(matrix: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    return [c for c in features if c in matrix.columns]


def lear_fit(matrix: DataFrame, label: str = "price", alphas: Sequence[float] = ALPHAS, min_rows: int = MIN_ROWS,
             features: Sequence[str] = FEATURES) -> DataFrame:
    """Model table ``zone, hour, n, alpha, intercept, coef, rq05, rq95``; hours with too few rows are left out.

    The residual quantiles come from each hour's last 8760 rows at most, so that group is bounded.
    """
    cols = available_features(matrix, features)
    rows = (
        matrix.withColumn("hour", F.hour("valid_time"))
        .na.drop("any", subset=[*cols, label])
        .select("zone", "hour", "valid_time", *[F.col(c).cast("double").alias(c) for c in cols if c != "hour"],
                F.col(label).cast("double").alias("_y"))
    )
    ranked = add_row_position(rows, ["zone", "hour"], "valid_time")
    size = F.floor(F.col("_n") / (N_SPLITS + 1))
    first = F.col("_n") - N_SPLITS * size
    block = F.when(F.col("_pos") <= first, F.lit(0)).otherwise(F.floor((F.col("_pos") - 1 - first) / size) + 1)
    ranked = ranked.withColumn("cv_block", block.cast("int"))
    width = len(cols) + 2
    packed = ranked.select("zone", "hour", "cv_block", F.array(*cols, "_y").alias("v"))
    partial = packed.mapInPandas(moments(width), "zone string, hour int, cv_block int, cells array<double>")
    sums = (
        partial.select("zone", "hour", "cv_block", F.posexplode("cells").alias("pos", "cell"))
        .groupBy("zone", "hour", "cv_block", "pos")
        .agg(F.sum("cell").alias("cell"))
    )
    # the groups are small but busy: an explicit partition count keeps AQE from merging them into one task
    tasks = int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    models = materialize(
        sums.repartition(tasks, "zone", "hour")
        .groupBy("zone", "hour")
        .applyInPandas(_solve_hour(width, min_rows, list(alphas)), MODEL_SCHEMA)
    )
    recent = ranked.where(F.col("_pos") > F.col("_n") - RESIDUAL_ROWS)
    resid = attach(recent, models.select("zone", "hour", "intercept", "coef"), ["zone", "hour"], "inner").select(
        "zone", "hour", (F.col("_y") - linear(cols)).alias("r")
    )
    bands = resid.groupBy("zone", "hour").agg(
        small_group_quantile("r", 0.05).alias("rq05"), small_group_quantile("r", 0.95).alias("rq95")
    )
    return materialize(models.join(bands, ["zone", "hour"]))


def lear_predict(matrix: DataFrame, models: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Every input row with ``lear_q05, lear_q50, lear_q95``; null where a feature or the hour's model is missing."""
    cols = available_features(matrix, features)
    keyed = matrix.withColumn("_hour", F.hour("valid_time"))
    table = models.select("zone", F.col("hour").alias("_hour"), "intercept", "coef", "rq05", "rq95")
    joined = attach(keyed, table, ["zone", "_hour"]).withColumn("lear_q50", linear(cols))
    return joined.withColumns({
        "lear_q05": F.col("lear_q50") + F.col("rq05"), "lear_q95": F.col("lear_q50") + F.col("rq95"),
    }).select(*matrix.columns, "lear_q05", "lear_q50", "lear_q95")


def alpha_summary(models: DataFrame) -> DataFrame:
    """Chosen penalty per zone and hour."""
    return models.select("zone", "hour", F.col("alpha").alias("best_alpha"))


def linear_contributions(matrix: DataFrame, models: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Exact contributions ``coef * (x - mean)`` per row and feature; they sum to prediction minus mean prediction."""
    cols = available_features(matrix, features)
    keyed = matrix.withColumn("_hour", F.hour("valid_time")).na.drop("any", subset=cols)
    means = keyed.groupBy("zone", "_hour").agg(F.array(*[F.avg(c) for c in cols]).alias("_mean"))
    table = models.select("zone", F.col("hour").alias("_hour"), "coef")
    joined = keyed.join(means.join(table, ["zone", "_hour"]), ["zone", "_hour"])
    parts = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col("coef")[i] * (F.col(c) - F.col("_mean")[i])).alias("phi"))
        for i, c in enumerate(cols)
    ])
    return joined.select("zone", "valid_time", F.explode(parts).alias("p")).select("zone", "valid_time", "p.*")
