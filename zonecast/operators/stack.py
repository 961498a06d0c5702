"""Ridge blend of base models, one small regression per key and quantile, from one aggregation of moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.operators.calibrate import order_quantiles
from zonecast.operators.modeltable import attach

ALPHA = 1.0
QUANTILES = ["q05", "q50", "q95"]
BASE_MODELS = ["lgbm", "xgb", "cat"]


def base_columns(quantile: str, models: Sequence[str] = BASE_MODELS) -> list[str]:
    return [f"{m}_{quantile}" for m in models]


def widen_models(long: DataFrame, models: Sequence[str] = BASE_MODELS, keys: Sequence[str] = ("zone", "valid_time")) -> DataFrame:
    """Long ``model, q05, q50, q95`` to ``{model}_{quantile}`` columns: one aggregation instead of n joins."""
    aggs = [
        F.max(F.when(F.col("model") == m, F.col(q))).alias(f"{m}_{q}") for m in models for q in QUANTILES
    ]
    return long.where(F.col("model").isin(list(models))).groupBy(*keys).agg(*aggs)


def _solve(matrix: list[list[Column]], rhs: list[Column], df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Elimination without pivoting (the matrix is positive definite); each step is materialised as columns."""
    n = len(rhs)
    names = [[f"_a{i}_{j}" for j in range(n)] + [f"_a{i}_b"] for i in range(n)]
    df = df.withColumns({names[i][j]: (matrix[i][j] if j < n else rhs[i]) for i in range(n) for j in range(n + 1)})
    for p in range(n):
        step = {}
        for i in range(p + 1, n):
            ratio = F.col(names[i][p]) / F.col(names[p][p])
            for j in range(p + 1, n + 1):
                step[names[i][j]] = F.col(names[i][j]) - ratio * F.col(names[p][j])
        if step:
            df = df.withColumns(step)
    for i in reversed(range(n)):
        acc = F.col(names[i][n])
        for j in range(i + 1, n):
            acc = acc - F.col(names[i][j]) * F.col(f"_x{j}")
        df = df.withColumn(f"_x{i}", acc / F.col(names[i][i]))
    return df, [F.col(f"_x{i}") for i in range(n)]


def _moments(features: Sequence[str], label: str, tag: str, complete: str) -> list[Column]:
    """Count, means and centred second moments over complete rows, named with ``tag``."""
    f = [f"if({complete}, CAST(`{c}` AS DOUBLE), NULL)" for c in features]
    y = f"if({complete}, CAST(`{label}` AS DOUBLE), NULL)"
    named = {f"n{tag}": f"count({y})", f"_my{tag}": f"avg({y})"}
    named |= {f"_m{i}{tag}": f"avg({f[i]})" for i in range(len(f))}
    named |= {f"_c{i}_{j}{tag}": f"covar_pop({f[i]}, {f[j]})" for i in range(len(f)) for j in range(i, len(f))}
    named |= {f"_b{i}{tag}": f"covar_pop({f[i]}, {y})" for i in range(len(f))}
    return [F.expr(e).alias(n) for n, e in named.items()]


def _complete(features: Sequence[str], label: str) -> str:
    return " AND ".join(f"`{c}` IS NOT NULL" for c in [*features, label])


def _ridge(moments: DataFrame, size: int, alpha: float) -> tuple[DataFrame, Column, list[Column]]:
    n = F.col("n")
    matrix = [
        [n * F.col(f"_c{min(i, j)}_{max(i, j)}") + (F.lit(alpha) if i == j else F.lit(0.0)) for j in range(size)]
        for i in range(size)
    ]
    solved, coef = _solve(matrix, [n * F.col(f"_b{i}") for i in range(size)], moments)
    intercept = F.col("_my")
    for i in range(size):
        intercept = intercept - coef[i] * F.col(f"_m{i}")
    return solved, intercept, coef


def ridge_fit(rows: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = ("zone",), alpha: float = ALPHA) -> DataFrame:
    """``keys, n, intercept, coef_<feature>...`` with an unpenalised intercept, over complete rows."""
    f = list(features)
    moments = rows.groupBy(*keys).agg(*_moments(f, label, "", _complete(f, label))).where("n > 0")
    solved, intercept, coef = _ridge(moments, len(f), alpha)
    return solved.select(*keys, "n", intercept.alias("intercept"), *[c.alias(f"coef_{name}") for name, c in zip(f, coef)])


def stack_fit(base: DataFrame, label: str = "y", models: Sequence[str] = BASE_MODELS, keys: Sequence[str] = ("zone",), alpha: float = ALPHA) -> DataFrame:
    """One blend per quantile: ``keys, quantile, n, intercept, w_<model>``; absent base models are left out.

    The moments of all three quantiles come from the same aggregation.
    """
    have = {q: [m for m in models if f"{m}_{q}" in base.columns] for q in QUANTILES}
    for q in QUANTILES:
        if not have[q]:
            raise ValueError(f"No base model columns found for {q}")
    if any(have[q] != have[QUANTILES[0]] for q in QUANTILES):
        raise ValueError("Every base model needs all three quantiles")
    used = have[QUANTILES[0]]
    aggs = [c for q in QUANTILES for c in _moments(base_columns(q, used), label, f"_{q}", _complete(base_columns(q, used), label))]
    wide = base.groupBy(*keys).agg(*aggs)
    names = [c[: -len("_q05")] for c in wide.columns if c.endswith("_q05")]
    rows = ", ".join(f"struct('{q}' AS quantile, " + ", ".join(f"{n}_{q} AS {n}" for n in names) + ")" for q in QUANTILES)
    moments = wide.select(*keys, F.expr(f"inline(array({rows}))")).where("n > 0")
    solved, intercept, coef = _ridge(moments, len(used), alpha)
    return solved.select(*keys, "quantile", "n", intercept.alias("intercept"), *[c.alias(f"w_{m}") for m, c in zip(used, coef)])


def stack_predict(base: DataFrame, fit: DataFrame, models: Sequence[str] = BASE_MODELS, keys: Sequence[str] = ("zone",)) -> DataFrame:
    """Blend and order: adds ``ens_q05, ens_q50, ens_q95``; rows with a missing base value stay null.

    ``fit`` should be materialised: it is counted to decide how it is joined.
    """
    k = list(keys)
    have = {q: [m for m in models if f"{m}_{q}" in base.columns and f"w_{m}" in fit.columns] for q in QUANTILES}
    wide = fit.groupBy(*k).agg(
        *[F.max(F.when(F.col("quantile") == q, F.col(c))).alias(f"_{c}_{q}")
          for q in QUANTILES for c in ["intercept", *[f"w_{m}" for m in have[q]]]]
    )
    out = attach(base, wide, k)
    for q in QUANTILES:
        total = F.col(f"_intercept_{q}")
        for m in have[q]:
            total = total + F.col(f"_w_{m}_{q}") * F.col(f"{m}_{q}")
        out = out.withColumn(f"ens_{q}", total)
    ordered = order_quantiles(out, "ens_q05", "ens_q50", "ens_q95")
    return ordered.select(*base.columns, "ens_q05", "ens_q50", "ens_q95")
