"""Walk-forward evaluation of LEAR in one pass: no refit reads the data again.

Every fold's training window, and every validation block in it, is a range of row positions in its (zone, hour). The ends
of all ranges of all folds cut the positions into segments, each row lies in one, and its products of (1, features, label)
are summed by (zone, hour, segment) once. Moments of any block of any fold are then a difference of running sums over
segments, so all folds and penalties of an hour are solved from a small table.

What a fold must see row by row, the residuals behind its band and its test window, follows in one job for all folds:
rows meet their folds by arithmetic on time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scores as S
from zonecast.operators import lear, splits
from zonecast.operators.blocks import add_row_position
from zonecast.operators.quantiles import small_group_quantile
from zonecast.plans.evaluation import EvalResult, evaluated
from zonecast.session import materialize

MODEL_SCHEMA = "zone string, hour int, fold int, n long, alpha double, intercept double, coef array<double>, last long"
CUTS = lear.N_SPLITS + 2


def _passed(time: str, start: dt.datetime, offset: int, step: int, count: int) -> Column:
    """How many of the days ``offset + k * step`` after ``start``, k below ``count``, are not later than the row."""
    day = F.floor((F.unix_seconds(F.col(time)) - F.unix_seconds(F.lit(start).cast("timestamp"))) / splits.DAY)
    return F.greatest(F.least(F.floor((day - offset) / step) + 1, F.lit(count)), F.lit(0)).cast("int")


def _cuts(pdf: pd.DataFrame, count: int) -> np.ndarray:
    """Per fold the positions after which its blocks begin and end, from row counts by the cut-offs passed."""
    rows = pdf["rows"].to_numpy()
    begin = np.cumsum(np.bincount(pdf["begun"], rows, count + 1))[:count].astype(np.int64)
    end = np.cumsum(np.bincount(pdf["ended"], rows, count + 1))[:count].astype(np.int64)
    size = (end - begin) // (lear.N_SPLITS + 1)
    steps = [end - (lear.N_SPLITS - i) * size for i in range(lear.N_SPLITS + 1)]
    return np.stack([begin, *steps], 1)


def _segments(count: int):
    """Per (zone, hour) and stretch between cut-offs: segments before it, and the cuts inside."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["begun", "ended"])
        cuts = np.unique(_cuts(pdf, count))
        end = np.cumsum(pdf["rows"].to_numpy())
        begin = end - pdf["rows"].to_numpy()
        return pd.DataFrame({
            "zone": key[0], "hour": int(key[1]), "begun": pdf["begun"], "ended": pdf["ended"],
            "before": np.searchsorted(cuts, begin, side="right"),
            "inside": [cuts[(cuts > a) & (cuts < b)].tolist() for a, b in zip(begin, end)],
        })

    return run


def _solve_folds(width: int, count: int, min_rows: int, alphas: Sequence[float]):
    """All folds of one (zone, hour) from its segments' moments and its row counts."""

    def run(key: tuple, sums: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        cuts = _cuts(counts, count)
        places = np.unique(cuts)
        moments = np.zeros((len(places) + 1, width, width))
        for segment, part in sums.groupby("cv_block"):
            moments[int(segment)] = lear.unfolded(width, part["pos"].to_numpy(), part["cell"].to_numpy())
        running = np.cumsum(moments, axis=0)
        out = []
        for fold, own in enumerate(cuts):
            n = int(own[-1] - own[0])
            if n >= min_rows:
                upto = running[np.searchsorted(places, own)]
                best, intercept, coef = lear.solve_blocks(np.diff(upto, axis=0), alphas)
                out.append([key[0], int(key[1]), fold, n, best, intercept, coef.tolist(), int(own[-1])])
        return pd.DataFrame(out, columns=["zone", "hour", "fold", "n", "alpha", "intercept", "coef", "last"])

    return run


def fold_models(matrix: DataFrame, start: dt.datetime, end: dt.datetime, train_days: int = 365, test_days: int = 7,
                step_days: int = 7, label: str = "price", features: Sequence[str] = lear.FEATURES,
                alphas: Sequence[float] = lear.ALPHAS, min_rows: int = lear.MIN_ROWS) -> DataFrame:
    """LEAR of every fold: ``zone, hour, fold, n, alpha, intercept, coef, last, rq05, rq95``.

    Equal to ``lear_fit`` on the rows of each training window; hours with fewer than ``min_rows`` rows there are left out.
    """
    cols = lear.available_features(matrix, features)
    count = splits.fold_count(start, end, train_days, test_days, step_days)
    rows = (
        matrix.withColumn("hour", F.hour("valid_time"))
        .na.drop("any", subset=[*cols, label])
        .select("zone", "hour", "valid_time", *[F.col(c).cast("double").alias(c) for c in cols if c != "hour"],
                F.col(label).cast("double").alias("_y"))
    )
    ranked = materialize(add_row_position(rows, ["zone", "hour"], "valid_time").withColumns({
        "begun": _passed("valid_time", start, 0, step_days, count),
        "ended": _passed("valid_time", start, train_days, step_days, count),
    }))
    stretch = ["zone", "hour", "begun", "ended"]
    counts = materialize(ranked.groupBy(*stretch).agg(F.count("*").alias("rows")))
    cut = counts.groupBy("zone", "hour").applyInPandas(
        _segments(count), "zone string, hour int, begun int, ended int, before int, inside array<long>")
    # Windows overlap, segments do not: a row is summed once, whatever the number of folds.
    segment = F.col("before") + F.size(F.filter("inside", lambda c: c < F.col("_pos")))
    packed = ranked.join(cut, stretch).select(
        "zone", "hour", segment.alias("cv_block"), F.array(*cols, "_y").alias("v"))
    width = len(cols) + 2
    sums = (
        packed.mapInPandas(lear.moments(width), "zone string, hour int, cv_block int, cells array<double>")
        .select("zone", "hour", "cv_block", F.posexplode("cells").alias("pos", "cell"))
        .groupBy("zone", "hour", "cv_block", "pos").agg(F.sum("cell").alias("cell"))
    )
    models = materialize(
        sums.groupBy("zone", "hour").cogroup(counts.groupBy("zone", "hour"))
        .applyInPandas(_solve_folds(width, count, min_rows, list(alphas)), MODEL_SCHEMA))
    seen = splits.assign_folds(ranked, start, end, train_days, test_days, step_days, side="train")
    resid = seen.join(models, ["zone", "hour", "fold"]).where(F.col("_pos") > F.col("last") - lear.RESIDUAL_ROWS)
    bands = resid.select("zone", "hour", "fold", (F.col("_y") - lear.linear(cols)).alias("r")).groupBy(
        "zone", "hour", "fold").agg(small_group_quantile("r", 0.05).alias("rq05"), small_group_quantile("r", 0.95).alias("rq95"))
    return materialize(models.join(bands, ["zone", "hour", "fold"]))


def walk_forward_lear(matrix: DataFrame, start: dt.datetime, end: dt.datetime, train_days: int = 365, test_days: int = 7,
                      step_days: int = 7, features: Sequence[str] = lear.FEATURES, alphas: Sequence[float] = lear.ALPHAS,
                      min_rows: int = lear.MIN_ROWS, spike_threshold: float = S.SPIKE_PRICE) -> EvalResult:
    """What ``walk_forward`` gives for LEAR, from one fit of all folds. ``matrix`` is best a stored table."""
    cols = lear.available_features(matrix, features)
    span = (start, end, train_days, test_days, step_days)
    models = fold_models(matrix, *span, features=features, alphas=alphas, min_rows=min_rows)
    usable = materialize(splits.usable_folds(matrix, *span))
    keyed = matrix.select("zone", "valid_time", "price", *[c for c in cols if c != "hour"]).withColumn("hour", F.hour("valid_time"))
    test = splits.assign_folds(keyed, *span).join(usable.select("zone", "fold"), ["zone", "fold"], "left_semi")
    q50 = lear.linear(cols)
    scored = test.join(models, ["zone", "hour", "fold"], "left").select(
        "fold", F.lit("lear").alias("model"), "zone", "valid_time", F.col("price").cast("double").alias("y"),
        (q50 + F.col("rq05")).alias("q05"), q50.alias("q50"), (q50 + F.col("rq95")).alias("q95"))
    table = splits.walk_forward_folds(matrix.sparkSession, *span)
    return evaluated(materialize(scored), usable.join(table, "fold"), spike_threshold)
