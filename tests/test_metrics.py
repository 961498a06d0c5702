import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, by, close, frame, hours, scored
from zonecast.operators import calibrate, metrics, monitor, quantiles, scoring, splits, stack
from zonecast.sources import dims

Z = "SE3"


def band(spark, ys, fs, width=5.0, start=START, zone=Z):
    rows = [(zone, t, y, None if f is None else f - width, f, None if f is None else f + width)
            for t, y, f in zip(hours(len(ys), start), ys, fs)]
    return scored(spark, rows)


def test_point_metrics_by_hand(spark):
    m = metrics.point_metrics(band(spark, [10.0, 20.0, 30.0], [12.0, 18.0, 33.0])).first()
    assert close(m["mae_eur"], 7 / 3) and close(m["pinball_q50"], 7 / 6) and m["coverage_rate"] == 1.0
    m = metrics.point_metrics(band(spark, [10.0, None, 30.0], [12.0, 18.0, 33.0])).first()
    assert m["mae_eur"] == 2.5
    assert metrics.point_metrics(band(spark, [10.0, None], [12.0, 1.0])).first()["mae_eur"] is None
    two = scored(spark, [(Z, START, 10.0, None, None, 8.0), (Z, START + dt.timedelta(hours=1), 10.0, None, None, 12.0)])
    m = metrics.point_metrics(two).first()
    assert close(m["pinball_q95"], (0.95 * 2 + 0.05 * 2) / 2) and m["coverage_rate"] is None
    cov = scored(spark, [(Z, START, 55.0, 40.0, 50.0, 60.0), (Z, START + dt.timedelta(hours=1), 200.0, 40.0, 50.0, 60.0)])
    assert metrics.point_metrics(cov).first()["coverage_rate"] == 0.5


def monitored(spark, ys, fs, width=5.0):
    s = band(spark, ys, fs, width)
    return s.select("zone", "valid_time", "y"), s.select("zone", "valid_time", "q05", "q50", "q95")


def test_step_series(spark):
    ys = [50.0] * 24 + [70.0] * 24
    m = metrics.rolling_metrics(*monitored(spark, ys, [None] * 24 + [50.0] * 24)).first()
    assert m["naive_mae_eur"] == 20.0 and m["rmae"] == 1.0
    assert metrics.rolling_metrics(*monitored(spark, ys, ys)).first()["rmae"] == 0.0
    flat = metrics.rolling_metrics(*monitored(spark, [5.0] * 48, [5.0] * 48)).first()
    assert flat["naive_mae_eur"] == 0.0 and flat["rmae"] is None


def test_window_limits_rows_and_the_naive_lag(spark):
    rng = random.Random(1)
    ys = [rng.uniform(0, 100) for _ in range(24 * 14)]
    a, f = monitored(spark, ys, [y + rng.gauss(0, 5) for y in ys], 10)
    row = metrics.rolling_metrics(a, f).first().asDict()
    assert set(row) == {"zone", "mae_eur", "naive_mae_eur", "rmae", "pinball_q50", "pinball_q05", "pinball_q95", "coverage_rate", "n_hours"}
    assert row["n_hours"] == 168
    tail = ys[-168:]
    assert close(row["naive_mae_eur"], sum(abs(tail[i] - tail[i - 24]) for i in range(24, 168)) / 144)
    both = metrics.monitoring_metrics(a, f, 7, 10).first()
    assert close(both["baseline_pinball_q50"], metrics.baseline_pinball(a, f, 10).first()[1])
    assert close(both["mae_eur"], row["mae_eur"])


def test_holdout_metrics_and_hour_map(spark):
    rng = random.Random(2)
    ys = [rng.choice([0.5, 50.0, 150.0]) * rng.random() * 2 for _ in range(200)]
    fs = [y + rng.gauss(0, 10) for y in ys]
    s = band(spark, ys, fs, 12)
    m = metrics.holdout_metrics(s).first()
    err = [f - y for y, f in zip(ys, fs)]
    assert m["n_hours"] == 200 and close(m["mae"], np.mean(np.abs(err))) and close(m["rmse"], math.sqrt(np.mean(np.square(err))))
    big = [abs(e / y) * 100 for e, y in zip(err, ys) if abs(y) >= 1]
    assert close(m["mape"], np.mean(big)) and close(m["coverage_q5_q95"], 100 * np.mean([abs(e) <= 12 for e in err]))
    assert m["n_spikes"] == sum(y > 100 for y in ys)
    night = [abs(e) for e, t in zip(err, hours(200)) if t.hour in (0, 1, 2, 3, 4, 5, 23)]
    assert close(m["night_mae"], np.mean(night))
    calm = metrics.holdout_metrics(band(spark, [0.5, 0.5], [1.0, 1.0]).withColumn("valid_time", F.lit(START + dt.timedelta(hours=12)))).first()
    assert calm["mape"] == calm["spike_mae"] == calm["night_mae"] == calm["peak_mae"] == 0.0
    by_hour = metrics.mae_by_hour_map(s).first()["mae_by_hour"]
    assert len(by_hour) == 24 and close(by_hour["7"], np.mean([abs(e) for e, t in zip(err, hours(200)) if t.hour == 7]))
    hist = metrics.error_histogram(s).collect()
    assert sum(r["n"] for r in hist) == 200 and max(r["bin"] for r in hist) <= 39
    comparison = metrics.model_comparison(metrics.holdout_metrics(s.withColumn("model", F.lit("m")), ["zone", "model"]), ["m"])
    assert comparison.count() == 4 and metrics.period_breakdown(metrics.holdout_metrics(s)).count() == 3
    assert metrics.daily_mae(s).count() == 9 and metrics.backtest_table(s).count() == 200


def test_dashboard_metrics(spark):
    ys = [50.0] * 30
    fs = [float(i) for i in range(29)] + [None]
    s = band(spark, ys, fs, 4)
    k = metrics.forecast_kpis(s).first()
    assert k["peak_q50"] == 28.0 and k["peak_time"] == START + dt.timedelta(hours=28)
    assert k["mean_q50"] == sum(range(5, 29)) / 24 and k["half_width"] == 4.0
    assert k["overnight_low"] == 5.0
    live = s.withColumn("y", F.lit(10.0))
    stored = live.where(F.col("q50") < 3)
    d = metrics.stored_vs_live(live, stored).first()
    assert d["n_stored"] == 3 and d["stored_share"] == 10.0 and d["mae_stored"] == 9.0
    assert metrics.backtest_kpis(s).first()["n_forecast"] == 29
    other = band(spark, ys, fs, zone="SE1")
    got = metrics.prefer_stored(s, s.unionByName(other)).groupBy("zone", "source").count().collect()
    assert {(r["zone"], r["source"]) for r in got} == {(Z, "stored"), ("SE1", "live")}
    assert metrics.round_forecast(s.withColumn("q50", F.lit(1.234))).first()["q50"] == 1.23
    assert metrics.aligned(s.select("zone", "valid_time", "y"), s.drop("y")).count() == 29


def test_scores_against_direct_formula(spark):
    rng = random.Random(4)
    ys = [rng.gauss(50, 20) for _ in range(300)]
    s = band(spark, ys, [y + rng.gauss(0, 8) for y in ys], 13).withColumn("model", F.lit("m"))
    rows = s.collect()
    m = scoring.eval_metrics(s, spike_threshold=1e9).first()

    def crps(r):
        sg = max((r.q95 - r.q05) / 3.29, 1e-3)
        z = (r.y - r.q50) / sg
        return sg * (z * (2 * NormalDist().cdf(z) - 1) + 2 * NormalDist().pdf(z) - 1 / math.sqrt(math.pi))

    assert close(m["crps"], np.mean([crps(r) for r in rows]), 1e-5) and m["spike_mae"] is None and close(m["interval_width"], 26.0)
    rel = by(scoring.reliability(s), "nominal")
    assert len(rel) == 7
    want = np.mean([r.y <= r.q50 + (r.q95 - r.q05) / 3.29 * NormalDist().inv_cdf(0.9) for r in rows])
    assert close(rel[(0.9,)]["observed"], want)
    degenerate = scored(spark, [(Z, START, 5.0, 5.0, 5.0, 5.0)]).withColumn("model", F.lit("m"))
    assert close(scoring.eval_metrics(degenerate).first()["crps"], 1e-3 * (2 / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)), 1e-4)


def metric_row(spark, rmae=0.8, pin=10.0, cov=0.9, n=168, base=10.0, zone=Z):
    return spark.createDataFrame([(zone, rmae, pin, cov, n, base)], "zone string, rmae double, pinball_q50 double, "
                                 "coverage_rate double, n_hours long, baseline_pinball_q50 double")


@pytest.mark.parametrize("change, want", [
    ({}, set()), ({"n": 47, "rmae": 9.0}, set()), ({"rmae": 1.2}, set()), ({"rmae": 1.35}, {"rmae"}), ({"rmae": None}, set()),
    ({"pin": 15.0}, set()), ({"pin": 15.1}, {"pinball_q50"}), ({"pin": 99.0, "base": None}, set()), ({"pin": 99.0, "base": 0.0}, set()),
    ({"cov": 0.8}, set()), ({"cov": 0.75}, {"coverage_rate"}), ({"cov": 0.98}, {"coverage_rate"}), ({"cov": None}, set()),
    ({"rmae": 1.5, "pin": 99.0, "cov": 0.1}, {"rmae", "pinball_q50", "coverage_rate"}),
])
def test_thresholds(spark, change, want):
    alerts = monitor.threshold_alerts(metric_row(spark, **change), dims.thresholds(spark)).collect()
    assert {a["metric"] for a in alerts} == want and all(a["reason"] for a in alerts)


def test_a_zone_without_thresholds_fails(spark):
    with pytest.raises(Exception, match="threshold zone"):
        monitor.threshold_alerts(metric_row(spark, zone="unknown", rmae=0.5), dims.thresholds(spark)).collect()


def test_crossed_coverage_limits_raise_one_alert(spark):
    table = dims.thresholds(spark).withColumns({"coverage_min": F.lit(0.96), "coverage_max": F.lit(0.9)})
    alerts = monitor.threshold_alerts(metric_row(spark, cov=0.93), table).collect()
    assert [(a["metric"], a["threshold"]) for a in alerts] == [("coverage_rate", 0.96)]


def test_rows_without_a_whole_band_have_no_crps(spark):
    rows = [(Z, START, 10.0, 0.0, 12.0, 30.0), (Z, START + dt.timedelta(hours=1), 50.0, None, 10.0, 30.0),
            (Z, START + dt.timedelta(hours=2), 50.0, 5.0, 10.0, None)]
    whole, broken = (scored(spark, r).withColumn("model", F.lit("m")) for r in (rows[:1], rows))
    assert close(scoring.eval_metrics(broken).first()["crps"], scoring.eval_metrics(whole).first()["crps"])
    assert scoring.eval_metrics(broken).first()["mae"] > scoring.eval_metrics(whole).first()["mae"]
    assert [r["observed"] for r in scoring.reliability(broken).collect()] == [r["observed"] for r in scoring.reliability(whole).collect()]


def test_drift_report(spark):
    rng = random.Random(5)
    ys = [rng.uniform(0, 100) for _ in range(24 * 10)]
    a, f = monitored(spark, ys, [y + 80 for y in ys])
    quiet = a.withColumn("zone", F.lit("SE1"))
    rep = by(monitor.drift_report(a.unionByName(quiet), f, dims.thresholds(spark)), "zone")
    assert rep[(Z,)]["drift_detected"] and {x["metric"] for x in rep[(Z,)]["alerts"]} == {"rmae", "coverage_rate"}
    assert not rep[("SE1",)]["drift_detected"] and rep[("SE1",)]["warning"] and rep[("SE1",)]["n_hours"] is None
    frame_ = monitor.drift_report(a.unionByName(quiet), f, dims.thresholds(spark))
    assert monitor.any_drift(frame_).first()["any_drift"]
    assert '"metrics":{"mae_eur":80.0' in monitor.report_json(frame_.where(F.col("zone") == Z)).first()["report"]


def test_promotion_gate_and_delta(spark):
    maes = [None, 12.0, 10.00004, 10.00003, 9.0, 9.0, None, 8.0]
    runs = spark.createDataFrame([("m", i, v) for i, v in enumerate(maes)], "model_name string, version int, mae double")
    got = [r["action"] for r in monitor.promotion_history(runs).orderBy("version").collect()]
    assert got == ["promoted", "promoted", "promoted", "challenger", "promoted", "challenger", "challenger", "promoted"]
    assert monitor.current_champion(monitor.promotion_history(runs)).first()["champion_version"] == 7
    prices = frame(spark, [START + dt.timedelta(days=7)], "price double", [1.0], zone="a")
    trained = spark.createDataFrame([("a", START), ("b", START)], "zone string, trained_at timestamp")
    gate = by(monitor.retrain_gate(prices, trained), "zone")
    assert not gate[("a",)]["skip"] and not gate[("b",)]["skip"]
    assert by(monitor.retrain_gate(prices.withColumn("valid_time", F.expr("valid_time - interval 1 hour")), trained), "zone")[("a",)]["skip"]
    runs = spark.createDataFrame([("z", "m", 1, 5.0, 80.0), ("z", "m", 2, 4.0, 90.0)], "zone string, model string, run_time int, mae double, coverage_q5_q95 double")
    delta = by(monitor.run_delta(runs), "run_time")
    assert delta[(1,)]["mae_delta"] is None and delta[(2,)]["mae_delta"] == -1.0 and delta[(2,)]["coverage_delta"] == 10.0


def test_exact_quantiles_with_ties_and_a_hot_key(spark):
    rng = random.Random(6)
    rows = [("hot", rng.choice([1.0, 1.0, 1.0, rng.gauss(0, 5)])) for _ in range(3000)]
    rows += [("small", v) for v in (3.0, 1.0, 2.0)] + [("one", 7.0)] + [("flat", 2.0)] * 50 + [("small", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = by(quantiles.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "med": 0.5, "p999": 0.999, "top": "1.0D", "own": "(n - 1) / n"}), "k")
    for k in ("hot", "small", "one", "flat"):
        vals = [v for kk, v in rows if kk == k and v is not None]
        n = len(vals)
        assert got[(k,)]["n"] == n
        for name, p in (("p10", 0.1), ("med", 0.5), ("p999", 0.999), ("top", 1.0), ("own", (n - 1) / n)):
            assert close(got[(k,)][name], float(np.quantile(vals, p)), 1e-9), (k, name)


def test_conformal(spark):
    rng = random.Random(8)
    ys = [rng.gauss(0, 10) for _ in range(500)]
    s = band(spark, ys, [0.0] * 500, 5).withColumn("model", F.lit("m"))
    fit = calibrate.conformal_fit(s).first()
    sc = [max(-5 - y, y - 5) for y in ys]
    assert close(fit["correction"], float(np.quantile(sc, min(np.ceil(501 * 0.9) / 500, 1)))) and fit["n_calibration"] == 500
    assert close(fit["raw_coverage"], np.mean([abs(y) <= 5 for y in ys]))
    wide = calibrate.conformal_apply(s, calibrate.conformal_fit(s))
    assert wide.where("y BETWEEN q05 AND q95").count() / 500 >= 0.9
    assert calibrate.conformal_apply(s, calibrate.conformal_fit(s), apply=False).first()["q05"] == -5.0
    # a band that is wide enough already gives c <= 0 and stays
    easy = band(spark, ys, [0.0] * 500, 500).withColumn("model", F.lit("m"))
    negative = calibrate.conformal_fit(easy)
    assert negative.first()["correction"] < 0 and calibrate.conformal_apply(easy, negative).first()["q95"] == 500.0
    with pytest.raises(ValueError, match="calibrate"):
        calibrate.require_calibration(calibrate.conformal_fit(s.where("y > 1e9")))
    tiny = calibrate.conformal_fit(s.limit(3)).first()
    assert tiny["n_calibration"] == 3


def test_quantile_ordering_nulls(spark):
    rows = scored(spark, [(Z, START, None, 9.0, 5.0, 1.0), (Z, START, None, 9.0, None, 1.0), (Z, START, None, None, 5.0, 7.0)])
    got = [(r.q05, r.q50, r.q95) for r in calibrate.order_quantiles(rows).collect()]
    assert got == [(5.0, 5.0, 5.0), (None, None, None), (None, 5.0, 7.0)]


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(50, 10, (n, 9))
    y = x[:, :3].mean(axis=1) + x[:, 3] * 0.1 + rng.normal(0, 1, n)
    names = [f"{m}_{q}" for m in ("lgbm", "xgb", "cat") for q in ("q05", "q50", "q95")]
    rows = [("z", t, *map(float, r), float(v)) for t, r, v in zip(hours(n), x, y)]
    rows.append(("z", START, None, *[1.0] * 8, 5.0))
    df = spark.createDataFrame(rows, "zone string, valid_time timestamp, " + ", ".join(f"{c} double" for c in names) + ", y double")
    fit = by(stack.stack_fit(df), "quantile")
    for q in ("q05", "q50", "q95"):
        cols = [names.index(f"{m}_{q}") for m in ("lgbm", "xgb", "cat")]
        use, target = x[:, cols], y
        if q != "q05":
            use, target = np.vstack([use, [[1.0] * 3]]), np.append(y, 5.0)
        c, d = use - use.mean(0), target - target.mean()
        w = np.linalg.solve(c.T @ c + np.eye(3), c.T @ d)
        row = fit[(q,)]
        assert row["n"] == len(target)
        for m, v in zip(("lgbm", "xgb", "cat"), w):
            assert close(row[f"w_{m}"], float(v), 1e-7)
        assert close(row["intercept"], float(target.mean() - w @ use.mean(0)), 1e-7)
    out = stack.stack_predict(df, stack.stack_fit(df)).select("ens_q05", "ens_q50", "ens_q95").collect()
    assert all(r[0] <= r[1] <= r[2] for r in out if r[0] is not None) and sum(r[0] is None for r in out) == 1
    with pytest.raises(ValueError, match="No base model"):
        stack.stack_fit(df.select("zone", "y"))
    one = stack.stack_fit(df.select("zone", "y", *[c for c in names if c.startswith("xgb")]))
    assert one.columns[-1] == "w_xgb" and one.count() == 3
    long = df.selectExpr("zone", "valid_time", "'xgb' AS model", "xgb_q05 AS q05", "xgb_q50 AS q50", "xgb_q95 AS q95")
    assert "lgbm_q05" in stack.widen_models(long).columns


def test_weights_and_splits(spark):
    n = 2000
    df = frame(spark, hours(n), "price double", [1.0] * n, zone="a").unionByName(frame(spark, hours(10), "price double", [1.0] * 10, zone="b"))
    w = splits.recency_weights(df, half_life=100)
    a = [r["weight"] for r in w.where("zone = 'a'").orderBy("valid_time").collect()]
    decay = np.exp(-np.log(2) * np.arange(n)[::-1] / 100)
    assert np.allclose(a, decay / decay.mean())
    assert splits.train_val_split(df).where("zone = 'a' AND is_val").count() == 720
    assert splits.train_val_split(df, cap_half=True).where("zone = 'b' AND is_val").count() == 5
    big = frame(spark, hours(6000), "price double", [1.0] * 6000)
    assert splits.train_val_split(big).where("is_val").count() == 900
    blocks = [r["cv_block"] for r in splits.expanding_blocks(df.where("zone = 'b'"), ["zone"]).orderBy("valid_time").collect()]
    assert blocks == [0] * 4 + [1, 1, 2, 2, 3, 3]
    end = START + dt.timedelta(days=100)
    s = frame(spark, hours(2410), "price double", [1.0] * 2410).withColumn("split", splits.calendar_split(F.col("valid_time"), end))
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 240, "calibration": 1440, "test": 720, None: 10}
    with pytest.raises(Exception, match="720"):
        splits.require_labels(df).collect()
    assert by(splits.label_coverage(df), "zone")[("b",)]["trainable"] is False


@pytest.mark.parametrize("train, test, step, days", [(10, 3, 2, 25), (5, 1, 1, 6), (9, 4, 5, 40), (9, 4, 5, 12)])
def test_folds_against_the_loop(spark, train, test, step, days):
    end = START + dt.timedelta(days=days)
    want, cursor = [], START + dt.timedelta(days=train)
    while cursor + dt.timedelta(days=test) <= end:
        want.append((cursor - dt.timedelta(days=train), cursor, cursor + dt.timedelta(days=test)))
        cursor += dt.timedelta(days=step)
    table = splits.walk_forward_folds(spark, START, end, train, test, step).orderBy("fold").collect()
    assert [(r["train_start"], r["train_end"], r["test_end"]) for r in table] == want
    times = hours(24 * (days + 3), START - dt.timedelta(days=1))
    df = frame(spark, times, "price double", [1.0 if t.day % 5 else None for t in times])
    for side in ("train", "test"):
        got = {(r["valid_time"], r["fold"]) for r in splits.assign_folds(df, START, end, train, test, step, side=side).collect()}
        expect = {(t, i) for i, (a, b, c) in enumerate(want) for t in times if (a <= t < b if side == "train" else b <= t < c)}
        assert got == expect
    usable = {r["fold"]: (r["n_train"], r["n_test"]) for r in splits.usable_folds(df, START, end, train, test, step).collect()}
    labelled = [t for t in times if t.day % 5]
    for i, (a, b, c) in enumerate(want):
        counts = (sum(a <= t < b for t in labelled), sum(b <= t < c for t in labelled))
        assert usable.get(i) == (counts if min(counts) >= 24 else None)
