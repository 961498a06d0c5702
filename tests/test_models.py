import datetime as dt
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import START, by, close, frame, hours, seeded_prices, synthetic_matrix
from zonecast.operators import boosting, explain, features, forest, lear, zoneboost
from zonecast.operators.modeltable import attach
from zonecast.plans import evaluation, forecast, training

BOOST = boosting.BoostConfig(rounds=4, learning_rate=0.5, max_depth=3, min_leaf=20, checkpoint_every=2)
FOREST = forest.ForestConfig(trees=6, max_depth=4, min_leaf=10)
SLOTS = {p: replace(s, rounds=60, rate=0.1, min_leaf=20) for p, s in zoneboost.capped().items()}


@pytest.fixture(scope="module")
def matrix(spark):
    return synthetic_matrix(spark)


def coverage(df, prefix):
    return df.agg(F.avg(F.expr(f"IF(price BETWEEN {prefix}_q05 AND {prefix}_q95, 1D, 0D)"))).first()[0]


def test_lasso_matches_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6))
    y = 3 * x[:, 0] - x[:, 1] + rng.standard_normal(200) + 7
    a = np.column_stack([np.ones(200), x, y])
    for alpha in (1e-4, 0.1, 0.5, 10.0):
        b0, beta = lear.lasso_from_moments(a.T @ a, alpha, tol=1e-12)
        r = y - b0 - x @ beta
        assert abs(r.mean()) < 1e-8
        slope = (x - x.mean(0)).T @ r / 200
        for s, b in zip(slope, beta):
            assert (b == 0 and abs(s) <= alpha + 1e-6) or (b != 0 and abs(s - alpha * np.sign(b)) < 1e-5)


def brute_lear(rows, cols):
    """The same estimator on one hour's rows: global z-scores, expanding 3-fold search, residual quantiles."""
    x, y = rows[cols].to_numpy(float), rows["price"].to_numpy(float)
    n, size = len(x), len(x) // 4
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd < 1e-9, 1.0, sd)

    def fit(zz, yy, alpha):
        a = np.column_stack([np.ones(len(zz)), zz, yy])
        return lear.lasso_from_moments(a.T @ a, alpha, tol=1e-10)

    best = None
    for alpha in sorted(lear.ALPHAS, reverse=True):
        errs = []
        for i in range(3):
            cut = n - (3 - i) * size
            b0, b = fit(z[:cut], y[:cut], alpha)
            errs.append(np.mean((y[cut:cut + size] - b0 - z[cut:cut + size] @ b) ** 2))
        if best is None or np.mean(errs) < best[0]:
            best = (np.mean(errs), alpha)
    b0, b = fit(z, y, best[1])
    r = y - b0 - z @ b
    return best[1], b0 + z @ b, np.quantile(r, 0.05), np.quantile(r, 0.95)


def test_lear_matches_direct_fit(spark, matrix):
    cols = lear.FEATURES
    rows = matrix.where("zone = 'a'").withColumn("price", F.when(F.col("valid_time") != F.lit(dt.datetime(2025, 1, 3, 5)), F.col("price")))
    models = lear.lear_fit(rows)
    assert models.count() == 24
    table = by(models, "hour")
    scored = lear.lear_predict(rows, models).toPandas().sort_values("valid_time")
    scored["h"] = scored["valid_time"].dt.hour
    for h in (0, 5, 17):
        part = scored[scored["h"] == h]
        known = part.dropna(subset=["price"])
        alpha, fit, lo, hi = brute_lear(known, cols)
        assert table[(h,)]["alpha"] == alpha and table[(h,)]["n"] == len(known)
        assert np.allclose(known["lear_q50"], fit, atol=0.05)
        assert close(table[(h,)]["rq05"], lo, 0.02) and close(table[(h,)]["rq95"], hi, 0.02)
        assert part["lear_q50"].notna().all()
    assert lear.alpha_summary(models).columns == ["zone", "hour", "best_alpha"]
    assert lear.lear_fit(rows.limit(24 * 20)).count() == 0  # fewer than 60 rows per hour
    gap = rows.withColumn("temperature", F.when(F.hour("valid_time") != 3, F.col("temperature")))
    out = lear.lear_predict(gap, models)
    assert out.count() == rows.count() and out.where("lear_q50 IS NULL").count() == rows.where("hour = 3").count()
    phi = lear.linear_contributions(rows, models).groupBy("zone", "valid_time").agg(F.sum("phi").alias("phi"))
    check = scored.merge(phi.toPandas(), on=["zone", "valid_time"])
    centre = check.groupby("h")["lear_q50"].transform("mean")
    assert np.allclose(check["phi"], check["lear_q50"] - centre, atol=1e-6)


def test_boosting_learns_and_orders(spark, matrix):
    model = boosting.boosted_fit(matrix, config=BOOST)
    scored = boosting.boosted_predict(matrix, model).persist()
    assert scored.count() == matrix.count() and scored.where("lgbm_q50 IS NULL").count() == 0
    assert 0.7 < coverage(scored, "lgbm") <= 1.0
    mae, naive = scored.agg(F.avg(F.abs(F.col("price") - F.col("lgbm_q50"))), F.avg(F.abs(F.col("price") - 50))).first()
    assert mae < 0.7 * naive
    for b in model.boosters.values():
        losses = [h[0] for h in b.history]
        assert losses[-1] < losses[0] and 1 <= b.best_rounds <= 4
    top = boosting.mean_importance(boosting.feature_importance(model, spark), 4).collect()
    assert top[0]["feature"] == "temperature" and len(top) == 4
    hole = matrix.withColumn("wind_speed", F.when(F.col("hour") != 4, F.col("wind_speed")))
    out = boosting.boosted_predict(hole.withColumn("price", F.lit(None).cast("double")), model)
    assert out.where("lgbm_q50 IS NULL").count() == matrix.where("hour = 4").count()


def test_fits_without_rows_fail_clearly(spark, matrix):
    empty = matrix.where("price > 1e9")
    for fit in (boosting.boosted_fit, forest.forest_fit):
        with pytest.raises(ValueError, match="No labelled rows"):
            fit(empty)


def test_leaf_quantiles_from_histogram():
    rows = [{"_leaf": 0.0, "_slice": 0.0, "w": 1.0, "lo": 0.0, "hi": 1.0}, {"_leaf": 0.0, "_slice": 1.0, "w": 3.0, "lo": 2.0, "hi": 5.0}]
    assert boosting._weighted_leaf_quantiles(rows, 0.25, 2) == [1.0, 0.0]
    assert boosting._weighted_leaf_quantiles(rows, 0.5, 2)[0] == 3.0


def test_ordered_target_mean_across_blocks(spark):
    df, prices = seeded_prices(spark, 24 * 300, zones=("a", "b"), drop=0.3)
    rows = df.withColumn("hour", F.hour("valid_time"))
    got = by(boosting.ordered_target_mean(rows, "hour"), "zone", "valid_time")
    pdf = pd.DataFrame([(z, t, t.hour, p) for (z, t), p in prices.items()], columns=["zone", "valid_time", "hour", "price"]).sort_values("valid_time")
    pdf["want"] = pdf.groupby(["zone", "hour"])["price"].transform(lambda s: s.expanding().mean().shift())
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        v = got[(r.zone, r.valid_time.to_pydatetime())]["hour_target"]
        assert (v is None and r.want != r.want) or close(v, r.want, 1e-9)


def test_forest_and_shapley(spark, matrix):
    model = forest.forest_fit(matrix, config=FOREST)
    scored = forest.forest_predict(matrix, model)
    assert 0.8 < coverage(scored, "xgb") <= 1.0 and scored.where("xgb_q05 > xgb_q50 OR xgb_q50 > xgb_q95").count() == 0
    sample = explain.sample_rows(matrix.select("zone", "valid_time", *model.features), 20)
    assert sample.count() == 20 and sample.exceptAll(explain.sample_rows(matrix.select("zone", "valid_time", *model.features), 20)).count() == 0

    def score(d):
        return forest.forest_predict(d, model).withColumn("score", F.col("xgb_q50"))

    phi = explain.shapley_values(sample, model.features, score, permutations=3).persist()
    total = by(phi.groupBy("zone", "valid_time").agg(F.sum("phi").alias("phi"), F.max("base").alias("base")), "zone", "valid_time")
    for r in score(sample).collect():
        t = total[(r["zone"], r["valid_time"])]
        assert close(t["phi"] + t["base"], r["score"], 1e-6)
    summary = explain.contribution_summary(phi, 5).collect()
    assert len(summary) == 5 and summary[0]["feature"] == "temperature"
    key = next(iter(total))
    assert explain.row_breakdown(phi, *key, top=15).count() == 15


def test_model_table_join(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "zone string, v int")
    table = spark.createDataFrame([("a", 9.0), ("c", 1.0), ("d", 1.0)], "zone string, w double")
    assert {r.zone: r.w for r in attach(rows, table, ["zone"]).collect()} == {"a": 9.0, "b": None}


def test_training_end_to_end(spark, matrix, tmp_path):
    end = dt.datetime(2025, 1, 1) + dt.timedelta(hours=1500)
    config = training.TrainConfig(slots=SLOTS, fit_slots=zoneboost.fit_slots, cal_days=20, test_days=8, min_labelled=720, lear_min_rows=30)
    models, report = training.train(matrix, end, config)
    rows = by(report, "zone", "model")
    assert set(rows) == {(z, m) for z in "ab" for m in ("lgbm", "xgb", "cat", "ens", "lear")}
    for (z, m), r in rows.items():
        assert r["n_hours"] == 192 and r["mae"] < 10
        if m in ("lgbm", "xgb", "cat"):
            assert r["coverage_q5_q95"] >= r["coverage_q5_q95_raw"] - 1e-9
        else:
            assert r["coverage_q5_q95_raw"] is None
    history = spark.createDataFrame([("ensemble-a", 1, 0.001), ("ensemble-b", 1, 999.0)], "model_name string, version int, mae double")
    decided = by(training.register(history, report, 2), "model_name", "version")
    assert decided[("ensemble-a", 2)]["action"] == "challenger" and decided[("ensemble-b", 2)]["action"] == "promoted"
    tail = matrix.where(F.col("valid_time") >= F.lit(end - dt.timedelta(days=2)))
    stored = training.forecasts_to_store(models, tail, end)
    assert {r["series_id"] for r in stored.select("series_id").distinct().collect()} == {20, 21, 22, 30, 31, 32}
    assert stored.count() == tail.count() * 6

    day = (end - dt.timedelta(days=1)).date()
    models.save(f"{tmp_path}/models")
    again = training.TrainedModels.load(spark, f"{tmp_path}/models")
    assert sorted(map(tuple, again.predict(tail).collect())) == sorted(map(tuple, models.predict(tail).collect()))

    requests = spark.createDataFrame([("a", day), ("b", day)], "zone string, date date")
    good, bad = forecast.split_requests(requests.unionByName(requests.withColumn("date", F.lit(START.date() - dt.timedelta(days=999)))), day - dt.timedelta(days=1))
    assert good.count() == 2 and bad.count() == 2
    answers = forecast.batch_forecast(matrix, good, models.predict, "7").collect()
    assert len(answers) == 2
    for a in answers:
        assert [h["hour"] for h in a["forecast"]] == list(range(24)) and a["model_version"] == "7"
        assert all(h["q05"] <= h["point"] <= h["q95"] for h in a["forecast"])
    served = forecast.served_versions(models.predict(tail), end)
    assert {r["series_id"] for r in served.select("series_id").distinct().collect()} == {23, 24, 25}
    with pytest.raises(Exception, match="Expected 24"):
        forecast.batch_forecast(matrix, requests.withColumn("date", F.lit(dt.date(2031, 1, 1))), models.predict, "7").collect()


def test_walk_forward_and_quick_evaluation(spark, matrix):
    def fit(train):
        return train.groupBy("zone").agg(F.avg("price").alias("m"))

    def predict(test, fitted):
        return test.join(fitted, "zone").selectExpr("zone", "valid_time", "m - 20 AS q05", "m AS q50", "m + 20 AS q95")

    start = dt.datetime(2025, 1, 1)
    result = evaluation.walk_forward(matrix, {"mean": (fit, predict), "again": (fit, predict)}, start, start + dt.timedelta(days=40), 20, 7, 7)
    assert result.folds.select("fold").distinct().count() == 2 and result.fold_metrics.count() == 2 * 2 * 2
    s = result.summary.first()
    assert s["mae_mean"] > 0 and s["coverage_mean"] > 0.8 and s["mae_std"] is not None
    assert result.reliability.count() == 2 * 2 * 7
    quick = evaluation.quick_evaluation(matrix, predict(matrix, fit(matrix)).withColumn("model", F.lit("m")), start, start + dt.timedelta(days=3))
    assert quick.count() == 2
    none = evaluation.walk_forward(matrix, {"mean": (fit, predict)}, start, start + dt.timedelta(days=5), 20, 7, 7)
    assert none.summary.count() == 0 and none.folds.count() == 0


def test_zone_boosting_beats_the_median_and_keeps_its_share(spark, matrix):
    models = zoneboost.fit_slots(matrix, zoneboost.capped()).persist()
    rows = {(r.zone, r.prefix, r.quantile): r for r in models.collect()}
    assert set(rows) == {(z, p, q) for z in "ab" for p in zoneboost.SLOTS for q in ("q05", "q50", "q95")}
    for r in rows.values():
        assert 1 <= r.rounds <= len(r.val_loss) <= r.rounds + 50 and r.val_loss[r.rounds - 1] == min(r.val_loss)
    scored = matrix.join(zoneboost.predict(matrix, models, list(zoneboost.SLOTS)), ["zone", "valid_time"]).persist()
    assert scored.count() == matrix.count()
    for p in zoneboost.SLOTS:
        assert 0.75 < coverage(scored, p) <= 1.0
        mae, naive = scored.agg(F.avg(F.abs(F.col("price") - F.col(f"{p}_q50"))), F.avg(F.abs(F.col("price") - 50))).first()
        assert mae < 0.6 * naive
    top = zoneboost.importance(models).where("quantile = 'q50'").groupBy("feature").agg(F.avg("importance").alias("i"))
    assert top.orderBy(F.desc("i")).first()["feature"] == "temperature"
    hole = matrix.withColumn("wind_speed", F.when(F.col("hour") != 4, F.col("wind_speed")))
    unknown = hole.unionByName(hole.limit(5).withColumn("zone", F.lit("new")))
    assert zoneboost.predict(unknown, models).where("lgbm_q50 IS NULL").count() == matrix.where("hour = 4").count() + 5


def test_zone_boosting_details(spark, matrix):
    rng = np.random.default_rng(3)
    leaf, r, w = rng.integers(0, 4, 200), rng.normal(size=200), rng.uniform(0.1, 2, 200)
    got = zoneboost.leaf_quantiles(leaf, r, w, 0.3, 5)
    for k in range(4):
        order = np.argsort(r[leaf == k])
        ok = np.cumsum(w[leaf == k][order]) >= 0.3 * w[leaf == k].sum()
        assert got[k] == r[leaf == k][order][ok.argmax()]
    assert got[4] == 0
    with pytest.raises(Exception, match="leave none to fit"):
        zoneboost.fit(matrix.where("hour = 3"), zoneboost.LGBM).collect()
    frame_ = pd.DataFrame({"c": [1, 1, 2, 1, 2, 3]})
    y, val = np.array([1.0, 3.0, 5.0, 7.0, 9.0, 11.0]), np.array([False] * 4 + [True] * 2)
    columns, codes, prior = zoneboost._encoded(frame_, ["c"], y, val)
    assert prior == 4.0 and columns["c_target"].tolist() == [4.0, 1.0, 4.0, 2.0, 5.0, 4.0]
    assert {k["code"]: k["mean"] for k in codes} == {1: 11 / 3, 2: 5.0}


def test_training_row_filters(spark, matrix):
    hole = matrix.withColumn("price", F.when(F.col("hour") != 1, F.col("price")))
    assert features.training_rows(hole).count() == matrix.where("hour <> 1").count()
    assert dict(features.categorical_int(matrix.withColumn("hour", F.col("hour").cast("double"))).dtypes)["hour"] == "int"
    assert frame(spark, hours(2), "v double", [1.0, 2.0]).count() == 2
