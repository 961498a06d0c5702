"""Walk-forward LEAR in one pass, and exact weighted quantiles, against refits and brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import by, close, hours
from zonecast.operators import lear, splits
from zonecast.operators.quantiles import exact_weighted_quantiles
from zonecast.plans import evaluation, lear_walk

START = dt.datetime(2025, 1, 1)
FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def matrix(spark):
    """Two zones, gaps in labels and features, one zone that begins late, hours without rows."""
    rng = random.Random(1)
    rows = []
    for zone, first in (("a", 0), ("b", 50)):
        for t in hours(24 * 30, START)[first:]:
            if t.hour not in (5, 9, 14, 17):  # few hours keep the refits short
                continue
            x = [rng.gauss(0, 1) for _ in FEATURES]
            y = 40 + 9 * x[0] - 3 * x[1] + t.hour + rng.gauss(0, 2)
            rows.append((zone, t, None if rng.random() < 0.08 else y, *[None if rng.random() < 0.02 else v for v in x]))
    return spark.createDataFrame(rows, "zone string, valid_time timestamp, price double, x1 double, x2 double, x3 double").persist()


@pytest.mark.parametrize("span", [(10, 8, 3), (9, 8, 4)])
def test_folds_equal_separate_refits(spark, matrix, span):
    end = START + dt.timedelta(days=24)
    got = lear_walk.walk_forward_lear(matrix, START, end, *span, features=FEATURES, min_rows=8)

    def fit(train):
        return lear.lear_fit(train, min_rows=8, features=FEATURES)

    def predict(test, models):
        p = lear.lear_predict(test, models, FEATURES)
        return p.select("zone", "valid_time", *[F.col(f"lear_{q}").alias(q) for q in ("q05", "q50", "q95")])

    want = evaluation.walk_forward(matrix, {"lear": (fit, predict)}, START, end, *span)
    for name, keys in (("fold_metrics", ("zone", "fold", "model")), ("summary", ("zone", "model"))):
        a, b = by(getattr(got, name), *keys), by(getattr(want, name), *keys)
        assert a.keys() == b.keys() and a
        for k in a:
            assert all(close(x, y, 1e-6) if isinstance(x, float) else x == y for x, y in zip(a[k], b[k])), (k, a[k], b[k])
    assert by(got.folds, "zone", "fold").keys() == by(want.folds, "zone", "fold").keys()


def test_models_of_a_fold_are_those_of_its_window(spark, matrix):
    end = START + dt.timedelta(days=30)
    models = lear_walk.fold_models(matrix, START, end, 12, 4, 5, features=FEATURES, min_rows=8)
    fold = splits.walk_forward_folds(spark, START, end, 12, 4, 5).orderBy(F.desc("fold")).first()
    t = F.col("valid_time")
    train = matrix.where((t >= F.lit(fold.train_start)) & (t < F.lit(fold.train_end)))
    want = by(lear.lear_fit(train, min_rows=8, features=FEATURES), "zone", "hour")
    got = by(models.where(F.col("fold") == fold.fold), "zone", "hour")
    assert got.keys() == want.keys() and got
    for k, m in got.items():
        assert m.n == want[k].n and m.alpha == want[k].alpha and close(m.intercept, want[k].intercept, 1e-8)
        assert np.allclose(m.coef, want[k].coef, rtol=1e-8, atol=1e-10) and close(m.rq05, want[k].rq05, 1e-8)


def test_no_folds_and_no_rows(spark, matrix):
    short = START + dt.timedelta(days=5)
    assert lear_walk.walk_forward_lear(matrix, START, short, 14, 3, 3, features=FEATURES).fold_metrics.collect() == []
    empty = lear_walk.walk_forward_lear(matrix.limit(0), START, START + dt.timedelta(days=30), 14, 3, 3, features=FEATURES)
    assert empty.fold_metrics.collect() == [] and empty.folds.collect() == []


def test_weighted_quantiles(spark):
    rng = random.Random(2)
    rows = [("hot", round(rng.gauss(0, 30)), rng.random()) for _ in range(4000)]
    rows += [("whole", float(rng.randrange(50)), float(rng.randrange(4))) for _ in range(300)]
    rows += [("one", 7.0, 0.2), ("same", 1.0, 2.0), ("same", 1.0, 3.0), ("none", 1.0, 0.0), ("none", None, 1.0), ("none", 2.0, None)]
    df = spark.createDataFrame([(k, None if v is None else float(v), w) for k, v, w in rows], "k string, v double, w double").repartition(4)
    levels = {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}
    for slices in (2, 16, 64):
        got = by(exact_weighted_quantiles(df, ["k"], "v", "w", levels, slices), "k")
        assert set(got) == {("hot",), ("whole",), ("one",), ("same",)}
        for (k,), r in got.items():
            own = sorted((v, w) for key, v, w in rows if key == k and v is not None and w)
            reach = np.cumsum([w for _, w in own])
            assert r.n == len(own) and r.top == own[-1][0]
            for name in ("low", "mid", "high"):
                assert r[name] == own[int(np.searchsorted(reach, levels[name] * reach[-1] * (1 - 1e-12)))][0], (k, name)
    assert exact_weighted_quantiles(df.limit(0), ["k"], "v", "w", levels).collect() == []
