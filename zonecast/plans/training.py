"""Training of all zones on one split gold table: fits, calibration, blend, metrics, promotion, forecasts to store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import calibrate, histboost, lear, metrics, monitor, splits, stack, zoneboost
from zonecast.operators.modeltable import attach
from zonecast.session import materialize, run_together
from zonecast.sources import bitemporal, dims

BASE = stack.BASE_MODELS
QUANTILES = stack.QUANTILES
STORED_SERIES = {f"{m}_{q}": dims.SERIES[f"{m}_{q}"] for m in ("lgbm", "lear") for q in QUANTILES}


@dataclass
class TrainConfig:
    slots: dict[str, zoneboost.BoostSettings] = field(default_factory=lambda: dict(histboost.SLOTS))
    #: ``zoneboost.fit_slots`` instead fits each zone in one task: for short histories and many rounds.
    fit_slots: Callable[..., DataFrame] = histboost.fit_slots
    cal_days: int = 90
    test_days: int = 30
    min_labelled: int = 720
    target_coverage: float = calibrate.TARGET_COVERAGE
    lear_features: Sequence[str] = tuple(lear.FEATURES)
    lear_min_rows: int = lear.MIN_ROWS


PARTS = ("boosted", "lear", "conformal", "blend")


@dataclass
class TrainedModels:
    """Fitted tables: boosted slots and LEAR per zone, conformal corrections, blend weights."""

    boosted: DataFrame
    lear: DataFrame
    conformal: DataFrame | None = None
    blend: DataFrame | None = None

    def save(self, path: str) -> None:
        """One Parquet table per part below ``path``."""
        for part in PARTS:
            if (table := getattr(self, part)) is not None:
                table.write.mode("overwrite").parquet(f"{path}/{part}")

    @staticmethod
    def load(spark: SparkSession, path: str, parts: Sequence[str] = PARTS) -> TrainedModels:
        return TrainedModels(**{part: spark.read.parquet(f"{path}/{part}") for part in parts})

    def base_predictions(self, matrix: DataFrame, apply_conformal: bool = True) -> DataFrame:
        """``zone, valid_time`` and nine base columns; a zone's rows meet all its models once."""
        wide = zoneboost.predict(matrix, self.boosted, BASE)
        return widen_intervals(wide, self.conformal) if apply_conformal and self.conformal is not None else wide

    def predict(self, matrix: DataFrame) -> DataFrame:
        """``zone, valid_time, ens_q05, ens_q50, ens_q95`` for every input row."""
        blended = stack.stack_predict(self.base_predictions(matrix), self.blend)
        return blended.select("zone", "valid_time", "ens_q05", "ens_q50", "ens_q95")


def widen_intervals(wide: DataFrame, fit: DataFrame, models: Sequence[str] = tuple(BASE)) -> DataFrame:
    """Conformal correction of every base model in its wide columns (positive corrections only)."""
    per_zone = fit.groupBy("zone").agg(
        *[F.max(F.when(F.col("model") == m, F.greatest("correction", F.lit(0.0)))).alias(f"_c_{m}") for m in models]
    )
    out = attach(wide, per_zone, ["zone"])
    for m in models:
        c = F.coalesce(f"_c_{m}", F.lit(0.0))
        out = out.withColumns({f"{m}_q05": F.col(f"{m}_q05") - c, f"{m}_q95": F.col(f"{m}_q95") + c})
    return out.select(*wide.columns)


def long_form(wide: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide model columns to ``zone, valid_time, [keep,] model, q05, q50, q95``."""
    rows = ", ".join(f"struct('{m}' AS model, " + ", ".join(f"{m}_{q} AS {q}" for q in QUANTILES) + ")" for m in models)
    return wide.selectExpr("zone", "valid_time", *keep, f"inline(array({rows}))")


def fit_base(train: DataFrame, config: TrainConfig) -> TrainedModels:
    return TrainedModels(*run_together([
        lambda: materialize(config.fit_slots(train, config.slots)),
        lambda: lear.lear_fit(train, features=config.lear_features, min_rows=config.lear_min_rows),
    ]))


def calibrate_and_blend(models: TrainedModels, window: DataFrame, target_coverage: float = calibrate.TARGET_COVERAGE) -> TrainedModels:
    """Fit the conformal corrections on raw predictions of the window, then the blend on the corrected ones."""
    actual = window.select("zone", "valid_time", F.col("price").alias("y"))
    raw = materialize(models.base_predictions(window, apply_conformal=False).join(actual, ["zone", "valid_time"]))
    scored = long_form(raw, BASE, ["y"])
    models.conformal = materialize(
        calibrate.require_calibration(calibrate.conformal_fit(scored, target_coverage=target_coverage))
    )
    models.blend = materialize(stack.stack_fit(widen_intervals(raw, models.conformal), "y"))
    return models


def train(matrix: DataFrame, end: dt.datetime, config: TrainConfig | None = None) -> tuple[TrainedModels, DataFrame]:
    """Fit everything and report test metrics ``zone, model, ...`` (base models calibrated, LEAR and the blend).

    The matrix is split once by time; calibration uses only the calibration window, metrics only the test window.
    """
    config = config or TrainConfig()
    split = matrix.withColumn("split", splits.calendar_split(F.col("valid_time"), end, config.cal_days, config.test_days))
    gold = materialize(split.where(F.col("split").isNotNull()))
    rows = {s: gold.where(F.col("split") == s).drop("split") for s in ("train", "calibration", "test")}
    splits.require_labels(rows["train"], minimum=config.min_labelled).collect()

    models = fit_base(rows["train"], config)
    actual = gold.select("zone", "valid_time", F.col("price").alias("y"))
    calibrate_and_blend(models, rows["calibration"], config.target_coverage)

    test = rows["test"]
    raw_test = materialize(models.base_predictions(test, apply_conformal=False))
    wide = widen_intervals(raw_test, models.conformal)
    blended = stack.stack_predict(wide, models.blend)
    lear_rows = lear.lear_predict(test, models.lear, config.lear_features).select("zone", "valid_time", *[f"lear_{q}" for q in QUANTILES])
    everything = (
        long_form(blended, [*BASE, "ens"])
        .unionByName(long_form(lear_rows, ["lear"]))
        .unionByName(long_form(raw_test, BASE).withColumn("model", F.concat("model", F.lit("_raw"))))
        .join(actual, ["zone", "valid_time"])
    )
    report = metrics.holdout_metrics(everything, ["zone", "model"])
    base = F.regexp_replace("model", "_raw$", "")
    raw_cov = report.where(F.col("model").endswith("_raw")).select(
        "zone", base.alias("model"), F.col("coverage_q5_q95").alias("coverage_q5_q95_raw")
    )
    return models, report.where(~F.col("model").endswith("_raw")).join(raw_cov, ["zone", "model"], "left")


def forecasts_to_store(models: TrainedModels, matrix: DataFrame, knowledge_time,
                       lear_features: Sequence[str] = tuple(lear.FEATURES)) -> DataFrame:
    """Calibrated LGBM and LEAR quantiles as versions under one knowledge time, nulls dropped."""
    wide = lear.lear_predict(matrix, models.lear, lear_features).select("zone", "valid_time", *[f"lear_{q}" for q in QUANTILES])
    base = models.base_predictions(matrix).select("zone", "valid_time", *[f"lgbm_{q}" for q in QUANTILES])
    return bitemporal.forecasts_to_versions(base.join(wide, ["zone", "valid_time"]), STORED_SERIES, knowledge_time)


def register(history: DataFrame, report: DataFrame, version: int, model: str = "ens") -> DataFrame:
    """Append this run's blend error per zone and decide the champion for the whole history."""
    new = report.where(F.col("model") == model).select(
        F.concat_ws("-", F.lit("ensemble"), "zone").alias("model_name"), F.lit(version).alias("version"), "mae"
    )
    return monitor.promotion_history(history.select("model_name", "version", "mae").unionByName(new))


def train_each_zone(matrix: DataFrame, end: dt.datetime, config: TrainConfig | None = None) -> dict[str, tuple[TrainedModels, DataFrame]]:
    """Independent models per zone, one run after the other (the zone list is a short dimension).

    ``train`` on all zones is the scalable default; this keeps zones strictly apart.
    """
    zones = sorted(r.zone for r in matrix.select("zone").distinct().collect())
    return {z: train(matrix.where(F.col("zone") == z), end, config) for z in zones}
