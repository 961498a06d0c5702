"""Weights, train/validation splits, cross-validation blocks and walk-forward folds.

Positions come from blocked row numbers; folds are found by arithmetic on time, never by a range join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators.blocks import add_row_position

HALF_LIFE_ROWS = 365 * 24
MIN_VAL_ROWS = 24 * 30
VAL_FRACTION = 0.15
MIN_FOLD_ROWS = 24
DAY = 86400


def recency_weights(df: DataFrame, keys: Sequence[str] = ("zone",), time: str = "valid_time",
                    half_life: int = HALF_LIFE_ROWS, name: str = "weight") -> DataFrame:
    """Half-life decay by row age, scaled to mean 1; the mean is the closed form of the geometric sum."""
    ranked = add_row_position(df, keys, time)
    r = 2.0 ** (-1.0 / half_life)
    mean = (1.0 - F.pow(F.lit(r), F.col("_n"))) / (1.0 - r) / F.col("_n")
    decay = F.pow(F.lit(2.0), -(F.col("_n") - F.col("_pos")) / half_life)
    return ranked.withColumn(name, decay / mean).drop("_pos", "_n")


def _n_val(n: Column, cap_half: bool) -> Column:
    size = F.greatest(F.lit(MIN_VAL_ROWS).cast("long"), F.floor(n * VAL_FRACTION))
    return F.least(size, F.floor(n / 2)) if cap_half else size


def train_val_split(df: DataFrame, keys: Sequence[str] = ("zone",), time: str = "valid_time",
                    cap_half: bool = False, name: str = "is_val") -> DataFrame:
    """The last ``max(720, 15 %)`` rows of each key validate; ``cap_half`` keeps at least half for training."""
    ranked = add_row_position(df, keys, time)
    cut = F.col("_n") - _n_val(F.col("_n"), cap_half)
    return ranked.withColumn(name, F.col("_pos") > cut).drop("_pos", "_n")


def expanding_blocks(df: DataFrame, keys: Sequence[str], time: str = "valid_time", n_splits: int = 3,
                     name: str = "cv_block") -> DataFrame:
    """Block 0 trains first; split i trains on blocks 0..i and tests on block i+1 (test size ``n // (n_splits+1)``)."""
    ranked = add_row_position(df, keys, time)
    size = F.floor(F.col("_n") / (n_splits + 1))
    first = F.col("_n") - n_splits * size
    block = F.when(F.col("_pos") <= first, F.lit(0)).otherwise(F.floor((F.col("_pos") - 1 - first) / size) + 1)
    return ranked.withColumn(name, block.cast("int")).drop("_pos", "_n")


def calendar_split(time: Column, end: dt.datetime | Column, cal_days: int = 90, test_days: int = 30) -> Column:
    """train before ``end-90d``, calibration until ``end-30d``, test until ``end``; null from ``end`` on."""
    e = F.unix_seconds((end if isinstance(end, Column) else F.lit(end)).cast("timestamp"))
    t = F.unix_seconds(time)
    return (
        F.when(t < e - cal_days * DAY, "train").when(t < e - test_days * DAY, "calibration").when(t < e, "test")
    )


def day_range(df: DataFrame, time: str = "valid_time") -> tuple[dt.datetime, dt.datetime]:
    """Start of the first day and end of the last day of a series; two values are all the driver reads."""
    first, last = df.agg(F.date_trunc("day", F.min(time)), F.date_trunc("day", F.max(time)) + F.expr("interval 1 day")).first()
    if first is None:
        raise ValueError("no rows to make folds of")
    return first, last


def fold_count(start: dt.datetime, end: dt.datetime, train_days: int, test_days: int, step_days: int) -> int:
    room = (end - start).total_seconds() / DAY - train_days - test_days
    return 0 if room < 0 else int(room // step_days) + 1


def walk_forward_folds(spark: SparkSession, start: dt.datetime, end: dt.datetime, train_days: int = 365,
                       test_days: int = 7, step_days: int = 7) -> DataFrame:
    """Fold table: train ``[c-train, c)``, test ``[c, c+test)`` with the cut-off stepping while the test fits."""
    n = fold_count(start, end, train_days, test_days, step_days)
    base = F.unix_seconds(F.lit(start).cast("timestamp"))
    cut = base + (F.lit(train_days) + F.col("id") * step_days) * DAY
    return spark.range(n).select(
        F.col("id").cast("int").alias("fold"),
        F.timestamp_seconds(cut - train_days * DAY).alias("train_start"),
        F.timestamp_seconds(cut).alias("train_end"),
        F.timestamp_seconds(cut).alias("test_start"),
        F.timestamp_seconds(cut + test_days * DAY).alias("test_end"),
    )


def _folds_covering(df: DataFrame, time: str, base: Column, n: Column, before: int, after: int, step_days: int) -> DataFrame:
    """Folds k whose cut-off ``c_k = base + k*step`` satisfies ``c_k - before <= t < c_k + after`` (days)."""
    t = (F.unix_seconds(F.col(time)) - base) / DAY
    lo = F.greatest(F.floor((t - after) / step_days) + 1, F.lit(0))
    hi = F.least(F.floor((t + before) / step_days), n - 1)
    return (
        df.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")})
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("fold", F.explode(F.sequence("_lo", "_hi")))
        .drop("_lo", "_hi")
    )


def assign_folds(df: DataFrame, start: dt.datetime, end: dt.datetime, train_days: int = 365, test_days: int = 7,
                 step_days: int = 7, time: str = "valid_time", side: str = "test") -> DataFrame:
    """Rows with the folds they test (or train) in; a test row falls into ``ceil(test/step)`` folds at most."""
    n = F.lit(fold_count(start, end, train_days, test_days, step_days))
    base = F.unix_seconds(F.lit(start).cast("timestamp")) + train_days * DAY
    if side == "test":
        return _folds_covering(df, time, base, n, 0, test_days, step_days)
    # train: c - train <= t < c  <=>  t < c_k <= t + train, i.e. before=train, after=0
    return _folds_covering(df, time, base, n, train_days, 0, step_days)


def usable_folds(df: DataFrame, start: dt.datetime, end: dt.datetime, train_days: int = 365, test_days: int = 7,
                 step_days: int = 7, keys: Sequence[str] = ("zone",), label: str = "price") -> DataFrame:
    """Folds with at least 24 labelled rows on both sides, with both counts; numbering keeps the gaps.

    Labels are counted per day first, so the overlap of training windows multiplies days, not rows.
    """
    origin = F.unix_seconds(F.lit(start).cast("timestamp"))
    day = F.timestamp_seconds(origin + F.floor((F.unix_seconds("valid_time") - origin) / DAY) * DAY)
    daily = df.groupBy(*keys, day.alias("valid_time")).agg(F.count(label).alias("_labelled"))
    k = [*keys, "fold"]

    def counted(side, name):
        rows = assign_folds(daily, start, end, train_days, test_days, step_days, side=side)
        return rows.groupBy(*k).agg(F.sum("_labelled").alias(name))

    both = counted("train", "n_train").join(counted("test", "n_test"), k)
    return both.where((F.col("n_train") >= MIN_FOLD_ROWS) & (F.col("n_test") >= MIN_FOLD_ROWS))


def require_labels(df: DataFrame, keys: Sequence[str] = ("zone",), label: str = "price", minimum: int = 720) -> DataFrame:
    """Labelled rows per key; fewer than ``minimum`` fails the job."""
    counted = df.groupBy(*keys).agg(F.count(label).alias("n_labelled"))
    ok = F.assert_true(F.col("n_labelled") >= minimum, F.lit(f"Need at least {minimum} labelled rows")).isNull()
    return counted.where(ok)


def label_coverage(df: DataFrame, keys: Sequence[str] = ("zone",), label: str = "price", minimum: int = 720) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(label).alias("n_labelled"),
        (F.count(label) >= minimum).alias("trainable"),
    )
