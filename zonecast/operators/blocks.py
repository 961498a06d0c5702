"""Time blocks: window work split by ``(key, block)`` so no key has to fit into one task.

A zone's history is cut into blocks of ``block_hours``. Bounded frames (lags, rolling statistics) get the rows just
before their block as a halo; unbounded frames (forward fill, ranks, running sums) get one carried summary per block.
The per-key step then only touches one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
DEFAULT_BLOCK_HOURS = 4 * 744


def block_of(time: str, block_hours: int = DEFAULT_BLOCK_HOURS) -> Column:
    """Block number of a time expression."""
    return F.expr(f"CAST(floor(unix_seconds(CAST({time} AS TIMESTAMP)) / {block_hours * 3600}) AS BIGINT)")


def block_start(block: str = BLOCK, block_hours: int = DEFAULT_BLOCK_HOURS, shift_seconds: int = 0) -> Column:
    return F.expr(f"timestamp_seconds(({block}) * {block_hours * 3600} + ({shift_seconds}))")


def with_halo(df: DataFrame, time: str, halo_hours: int, block_hours: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Copy each row into every block whose frames may reach it; ``block_of(time) == _block`` marks the original."""
    sec, size = f"unix_seconds(CAST({time} AS TIMESTAMP))", block_hours * 3600
    reach = f"CAST(floor(({sec} + {halo_hours * 3600}) / {size}) AS BIGINT)"
    return df.withColumn(BLOCK, F.expr(f"explode(sequence(CAST(floor({sec} / {size}) AS BIGINT), {reach}))"))


def is_core(time: str, block_hours: int = DEFAULT_BLOCK_HOURS) -> Column:
    return block_of(time, block_hours) == F.col(BLOCK)


def carried_last(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    block_hours: int = DEFAULT_BLOCK_HOURS,
    all_blocks: DataFrame | None = None,
) -> DataFrame:
    """Per ``(keys, _block)``: the last non-null value of each column in all *earlier* blocks.

    ``all_blocks`` lists blocks that need a carried row even if ``df`` has none there.
    """
    rows = df.select(*keys, time, *cols, block_of(time, block_hours).alias(BLOCK))
    if all_blocks is not None:
        rows = rows.unionByName(all_blocks.select(*keys, BLOCK), allowMissingColumns=True)
    last = rows.groupBy(*keys, BLOCK).agg(
        *[F.expr(f"max_by({c}, if({c} IS NULL, NULL, {time}))").alias(c) for c in cols]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return last.select(*keys, BLOCK, *[F.last(c, ignorenulls=True).over(before).alias(c) for c in cols])


def block_prefix(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    sums: dict[str, Column],
    block_hours: int = DEFAULT_BLOCK_HOURS,
) -> DataFrame:
    """Per ``(keys, _block)``: for each named value the sum over earlier blocks and ``<name>_total`` over all."""
    parts = (
        df.select("*", block_of(time, block_hours).alias(BLOCK))
        .groupBy(*keys, BLOCK)
        .agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    out = [*keys, BLOCK]
    for n in sums:
        out += [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n), F.sum(n).over(whole).alias(f"{n}_total")]
    return parts.select(*out)


def add_row_position(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    position: str = "_pos",
    total: str = "_n",
    block_hours: int = DEFAULT_BLOCK_HOURS,
) -> DataFrame:
    """1-based position of each row in its key by time, and the key's row count."""
    offsets = block_prefix(df, keys, time, {"_before": F.lit(1)}, block_hours)
    w = Window.partitionBy(*keys, BLOCK).orderBy(time)
    return (
        df.withColumn(BLOCK, block_of(time, block_hours))
        .join(offsets, [*keys, BLOCK])
        .withColumn(position, (F.row_number().over(w) + F.col("_before")).cast("long"))
        .withColumnRenamed("_before_total", total)
        .drop("_before", BLOCK)
    )


def last_rows(df: DataFrame, keys: Sequence[str], time: str, n: int, block_hours: int = DEFAULT_BLOCK_HOURS,
              keep_age: str | None = None) -> DataFrame:
    """Last ``n`` rows of each key by time; ``keep_age`` names a column with the row's distance from the end.

    Rows are counted per block; only the last blocks that together hold ``n`` rows are ranked, so a task sees at most
    ``n`` rows and one block more, whatever the history.
    """
    k = list(keys)
    rows = df.withColumn(BLOCK, block_of(time, block_hours))
    later = Window.partitionBy(*k).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*k, BLOCK).agg(F.count(F.lit(1)).alias("_m"))
    wanted = counted.withColumn("_later", F.coalesce(F.sum("_m").over(later), F.lit(0))).where(F.col("_later") < n)
    newest = Window.partitionBy(*k).orderBy(F.desc(time))
    age = keep_age or "_age_of_row"
    kept = rows.join(wanted.select(*k, BLOCK), [*k, BLOCK]).withColumn(age, (F.row_number().over(newest) - 1).cast("long"))
    kept = kept.where(F.col(age) < n)
    return kept.drop(BLOCK) if keep_age else kept.drop(BLOCK, age)
