"""Exact interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. Here a bounded sketch only chooses cut points; the
exact order statistics are then picked from the two slices that hold them, so a group is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 64


def small_group_quantile(value: Column | str, p: float | Column) -> Column:
    """Exact quantile for groups with a stated bound (such as the last 8760 rows)."""
    return F.percentile(value, p)


def _sliced(rows: DataFrame, k: list[str], slices: int, *columns: str) -> DataFrame:
    """Rows with ``_slice``, the number of sketched cut points of their key below their value ``_v``."""
    probs = ", ".join(f"{i / slices}D" for i in range(1, slices))
    cuts = rows.groupBy(*k).agg(F.expr(f"percentile_approx(_v, array({probs}), 10000)").alias("_cuts"))
    return rows.join(cuts, k).select(
        *k, F.expr("coalesce(size(filter(_cuts, c -> c < _v)), 0)").alias("_slice"), "_v", *columns)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: dict[str, str | float],
    slices: int = SLICES,
    extra: dict[str, str] | None = None,
) -> DataFrame:
    """Per key the linear-interpolated quantile of ``value`` at each level, and the count as ``n``.

    A level may be an SQL expression over ``n`` (such as the finite-sample conformal level). ``extra`` are additive
    sums over the values, written over ``_v`` (value) and ``_m`` (its multiplicity).
    """
    k = list(keys)
    extra = extra or {}
    rows = df.select(*k, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    # equal values always share a slice; repeated values collapse before the shuffle (a slice is never null, which
    # keeps both uses of this exchange identical, hence shared)
    counted = _sliced(rows, k, slices).groupBy(*k, "_slice", "_v").agg(F.count(F.lit(1)).alias("_m"))
    sizes = counted.groupBy(*k, "_slice").agg(
        F.sum("_m").alias("_size"), *[F.expr(f"sum({e})").alias(n) for n, e in extra.items()]
    )
    key = ", ".join(f"`{c}`" for c in k)
    # one row per slice and key from here on
    totals = sizes.selectExpr(
        *k, "_slice", "_size",
        f"coalesce(sum(_size) OVER (PARTITION BY {key} ORDER BY _slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        f"sum(_size) OVER (PARTITION BY {key}) AS n", *[f"sum({n}) OVER (PARTITION BY {key}) AS {n}" for n in extra],
    )
    places = totals.select("*", *[F.expr(f"(n - 1) * ({e})").alias(f"_at_{name}") for name, e in levels.items()])
    inside = " OR ".join(
        f"({end}(_at_{name}) >= _before AND {end}(_at_{name}) < _before + _size)" for name in levels for end in ("floor", "ceil")
    )
    # only the slices that hold a wanted order statistic are sorted
    opened = counted.join(places.where(inside).drop("_size"), [*k, "_slice"])
    run = f"sum(_m) OVER (PARTITION BY {key}, _slice ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ordered = opened.withColumn("_last", F.expr(f"_before + {run} - 1"))

    def picked(name: str, end: str) -> str:
        return f"max(if({end}(_at_{name}) BETWEEN _last - _m + 1 AND _last, _v, NULL))"

    ends = ordered.groupBy(*k, "n", *extra, *[f"_at_{name}" for name in levels]).agg(
        *[F.expr(picked(name, end)).alias(f"_{end}_{name}") for name in levels for end in ("floor", "ceil")]
    )
    return ends.select(
        *k, "n", *extra,
        *[F.expr(f"_floor_{n} + (_at_{n} - floor(_at_{n})) * (_ceil_{n} - _floor_{n})").alias(n) for n in levels],
    )


def exact_weighted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    levels: dict[str, float],
    slices: int = SLICES,
) -> DataFrame:
    """Per key the smallest value at which the weight so far reaches each level's share of the key's weight, and the
    number of rows as ``n``.

    Levels lie in (0, 1]; rows without a value or without a positive weight are left out. As above, a sketch only cuts
    the values into slices: their weights find the one slice in which a level is reached, and only that one is sorted.
    """
    k = list(keys)
    rows = df.select(*k, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
    counted = (
        _sliced(rows.where("_v IS NOT NULL AND _w > 0"), k, slices, "_w")
        .groupBy(*k, "_slice", "_v").agg(F.sum("_w").alias("_m"), F.count(F.lit(1)).alias("_rows"))
    )
    sizes = counted.groupBy(*k, "_slice").agg(F.sum("_m").alias("_size"), F.sum("_rows").alias("_rows"))
    key = ", ".join(f"`{c}`" for c in k)
    # one row per slice and key from here on; the running sums themselves decide, so a level is reached in one slice
    running = sizes.selectExpr(*k, "_slice", "_rows", f"sum(_size) OVER (PARTITION BY {key} ORDER BY _slice) AS _upto")
    totals = running.selectExpr(
        *k, "_slice", "_upto", f"coalesce(lag(_upto) OVER (PARTITION BY {key} ORDER BY _slice), 0D) AS _before",
        f"max(_upto) OVER (PARTITION BY {key}) AS _total", f"sum(_rows) OVER (PARTITION BY {key}) AS n")
    inside = {name: f"({p!r}D * _total > _before AND {p!r}D * _total <= _upto)" for name, p in levels.items()}
    opened = counted.drop("_rows").join(totals.where(" OR ".join(inside.values())), [*k, "_slice"])
    ordered = opened.withColumn("_reach", F.expr(f"_before + sum(_m) OVER (PARTITION BY {key}, _slice ORDER BY _v)"))
    # sums in another order may end a little below the slice's weight: then it is reached at the slice's last value
    return ordered.groupBy(*k, "n").agg(*[
        F.expr(f"coalesce(min(if({inside[name]} AND _reach >= {p!r}D * _total, _v, NULL)), max(if({inside[name]}, _v, NULL)))").alias(name)
        for name, p in levels.items()
    ])
