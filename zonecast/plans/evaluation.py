"""Walk-forward and quick evaluation around caller-supplied fit and predict functions on DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scores as S
from zonecast.operators import scoring, splits
from zonecast.session import materialize

Fit = Callable[[DataFrame], object]
# predict(matrix, fitted) -> zone, valid_time, q05, q50, q95
Predict = Callable[[DataFrame, object], DataFrame]


SCORED = (
    "fold int, model string, zone string, valid_time timestamp, y double, q05 double, q50 double, q95 double"
)


@dataclass
class EvalResult:
    folds: DataFrame
    fold_metrics: DataFrame
    summary: DataFrame
    reliability: DataFrame


def walk_forward(matrix: DataFrame, models: dict[str, tuple[Fit, Predict]], start: dt.datetime, end: dt.datetime,
                 train_days: int = 365, test_days: int = 7, step_days: int = 7,
                 spike_threshold: float = S.SPIKE_PRICE) -> EvalResult:
    """Refit on every fold's training window and score its test window.

    ``matrix`` should cover ``[start, end)`` with warm lags; pass a stored table, so each fold reads only its months. A zone joins a fold only with 24 labelled rows on both
    sides; folds keep their numbers when some are skipped. The loop runs over folds (a short list), each fit is a
    Spark job over all zones.
    """
    spark = matrix.sparkSession
    table = splits.walk_forward_folds(spark, start, end, train_days, test_days, step_days)
    usable = materialize(splits.usable_folds(matrix, start, end, train_days, test_days, step_days))
    parts = []
    for fold in table.join(usable.select("fold").distinct(), "fold", "left_semi").orderBy("fold").collect():
        members = usable.where(F.col("fold") == fold["fold"]).select("zone")
        rows = matrix.join(members, "zone", "left_semi")
        t = F.col("valid_time")
        train = rows.where((t >= F.lit(fold["train_start"])) & (t < F.lit(fold["train_end"])) & F.col("price").isNotNull())
        test = rows.where((t >= F.lit(fold["test_start"])) & (t < F.lit(fold["test_end"])))
        actual = test.select("zone", "valid_time", F.col("price").alias("y"))
        for name, (fit, predict) in models.items():
            forecast = predict(test, fit(train)).select("zone", "valid_time", "q05", "q50", "q95")
            scored = forecast.join(actual, ["zone", "valid_time"], "left").select(
                F.lit(fold["fold"]).alias("fold"), F.lit(name).alias("model"), "zone", "valid_time", "y", "q05", "q50", "q95"
            )
            parts.append(materialize(scored))
    # without a usable fold all results are empty
    scored = spark.createDataFrame([], SCORED)
    for p in parts:
        scored = scored.unionByName(p)
    return evaluated(scored, usable.join(table, "fold"), spike_threshold)


def evaluated(scored: DataFrame, folds: DataFrame, spike_threshold: float = S.SPIKE_PRICE) -> EvalResult:
    """Metrics per fold, their summary and reliability of the scored forecasts of all folds."""
    per_fold = scoring.eval_metrics(scored, ["zone", "fold", "model"], spike_threshold)
    rel = scoring.reliability(scored, ["zone", "fold", "model"])
    return EvalResult(
        folds=folds,
        fold_metrics=per_fold,
        summary=scoring.fold_summary(per_fold, ["zone", "model"]),
        reliability=scoring.reliability_over_folds(rel, ["zone", "model"]),
    )


def quick_evaluation(matrix: DataFrame, predictions: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Scores of already made predictions ``zone, valid_time, model, q05, q50, q95`` on the recorded holdout."""
    t = F.col("valid_time")
    window = matrix.where((t >= F.lit(start)) & (t < F.lit(end))).select("zone", "valid_time", F.col("price").alias("y"))
    return scoring.eval_metrics(predictions.join(window, ["zone", "valid_time"]))
