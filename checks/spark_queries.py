"""The registered queries. Doubles are rounded and times are UTC without zone, so results compare across engines."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import roles as R
from zonecast.functions import scores as S
from zonecast.functions.calendar import add_calendar, with_swedish_holiday
from zonecast.operators import (
    boosting, calibrate, exchange, explain, features, forest, histboost, lear, metrics, monitor, pit, quality, quantiles,
    scoring, splits, stack, zoneboost,
)
from zonecast.plans import evaluation, forecast, lear_walk, training
from zonecast.session import ensure_checkpoint_dir, materialize
from zonecast.sources import bitemporal, bronze, dims, gold, silver

FOLD = {"train_days": 14, "test_days": 3, "step_days": 3}
FEATURE_FOR_PIT = ["price_lag24h", "price_roll24h", "hour"]


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for name, kind in df.dtypes:
        c = f"`{name}`"
        if kind in ("double", "float"):
            # the shift moves exact halves, which the engines round differently; adding 0 turns -0.0 into 0.0
            c = f"round({c} + 1e-9D, {digits}) + 0D"
        elif kind in ("timestamp", "timestamp_ltz"):
            c = f"CAST({c} AS TIMESTAMP_NTZ)"
        elif kind in ("int", "smallint", "tinyint"):
            c = f"CAST({c} AS BIGINT)"
        cols.append(f"{c} AS `{name}`")
    return df.selectExpr(*cols)


def hourly_series(spark, sf):
    return out(R.prices(spark, sf))


def spine_reindex(spark, sf):
    return out(R.dense(spark, sf))


def price_lags(spark, sf):
    return out(R.forecasts_wide(spark, sf).select("zone", "valid_time", "price", *features.LAG_COLS))


def rolling_stats(spark, sf):
    return out(R.forecasts_wide(spark, sf).select("zone", "valid_time", *features.ROLL_COLS))


def calendar_features(spark, sf):
    return out(add_calendar(R.dense(spark, sf)).drop("price"))


def weather_ffill(spark, sf):
    cols = features.WEATHER_COLS
    filled = features.forward_fill(features.reindex_hourly(R.weather(spark, sf), cols), cols)
    return out(filled.withColumns(features.weather_interactions("hour(valid_time)")))


def feature_matrix(spark, sf):
    return out(R.matrix(spark, sf))


def inference_slice(spark, sf):
    last = dt.date(2024, 1, 29)
    rows = features.inference_features(
        R.prices(spark, sf), last, weather=R.weather(spark, sf), generation=R.generation_hourly(spark, sf),
        load=R.load_hourly(spark, sf), flows=R.ring_flows(spark, sf))
    return out(rows)


def silver_generation(spark, sf):
    wide = bronze.normalize_generation(R.fuel_long(spark, sf), list(R.FUELS.values()))
    return out(silver.silver_generation(exchange.fuel_totals(wide)))


def silver_load(spark, sf):
    return out(silver.silver_load(R.region_load(spark, sf)), 2)


def silver_crossborder(spark, sf):
    return out(silver.silver_crossborder(R.region_flows(spark, sf)))


def net_exchange(spark, sf):
    return out(exchange.net_exchange(R.region_flows(spark, sf)))


def imports_exports(spark, sf):
    return out(exchange.imports_exports(R.region_flows(spark, sf)))


def dq_prices(spark, sf):
    return out(quality.check_prices(R.events(spark, sf).select("valid_time", "value", "zone")))


def dq_weather(spark, sf):
    w = features.reindex_hourly(R.weather(spark, sf), features.WEATHER_COLS).select(
        "valid_time", F.col("temperature").alias("temperature_2m"), F.col("wind_speed").alias("wind_speed_10m"),
        F.col("irradiance").alias("shortwave_radiation"), "zone")
    return out(quality.check_weather(w))


def dq_generation(spark, sf):
    wide = bronze.normalize_generation(R.fuel_long(spark, sf), list(R.FUELS.values()))
    return out(quality.check_generation(wide))


def dq_silver_load(spark, sf):
    return out(quality.check_silver(silver.silver_load(R.region_load(spark, sf)), "silver_load"))


def read_latest(spark, sf):
    return out(bitemporal.read_latest(R.versions(spark, sf)))


def read_latest_wide(spark, sf):
    ids = {n: dims.SERIES[n] for n in ("lgbm_q05", "lgbm_q50", "lgbm_q95")}
    return out(bitemporal.read_latest_wide(R.versions(spark, sf), ids))


def read_versions(spark, sf):
    return out(bitemporal.with_series_name(R.versions(spark, sf), dims.series(spark)).drop("retention"))


def read_as_of(spark, sf):
    return out(bitemporal.read_as_of(R.versions(spark, sf), dt.datetime(2024, 1, 15, 23, 59),
                                     dt.date(2024, 1, 3), dt.date(2024, 1, 20)))


def read_relative(spark, sf):
    return out(bitemporal.read_relative(R.versions(spark, sf)))


def provenance(spark, sf):
    return out(bitemporal.provenance(R.versions(spark, sf), ["zone", "knowledge_time"]))


def retention(spark, sf):
    kept = bitemporal.apply_retention(R.versions(spark, sf), dt.datetime(2024, 1, 31), {"short": 7, "medium": 20})
    return out(kept)


def _pit_inputs(spark, sf):
    feats = add_calendar(R.forecasts_wide(spark, sf))
    ents = R.events(spark, sf).select("event_id", "zone", F.col("ts").alias("valid_time"), F.col("value").alias("price"))
    return ents, feats


def pit_join(spark, sf):
    ents, feats = _pit_inputs(spark, sf)
    return out(pit.point_in_time_join(ents, feats, FEATURE_FOR_PIT, hourly_features=True))


def pit_join_ttl(spark, sf):
    """Short time-to-live against the sparse observed hours, so old features drop out."""
    ents, _ = _pit_inputs(spark, sf)
    feats = R.prices(spark, sf).select("zone", (F.col("valid_time") + F.expr("interval 1 hour")).alias("valid_time"),
                                       F.col("price").alias("last_price"))
    return out(pit.point_in_time_join(ents, feats, ["last_price"], ttl_hours=1))


def feature_service(spark, sf):
    """All features of the three views for every event, each view with its own times and time-to-live."""
    ents, _ = _pit_inputs(spark, sf)
    rows = gold.select_views(materialize(R.matrix(spark, sf)))
    grid = rows.where("temperature_2m IS NOT NULL AND hour(valid_time) % 3 = 0").withColumn("known", F.expr("valid_time + INTERVAL 90 MINUTES"))
    views = [pit.View(rows, gold.VIEWS["price_features"]), pit.View(rows, gold.VIEWS["calendar_features"], ttl_hours=0.5),
             pit.View(grid, gold.VIEWS["grid_weather_features"], ttl_hours=4, time="known")]
    return out(pit.service_join(ents, views))


def online_latest(spark, sf):
    _, feats = _pit_inputs(spark, sf)
    asked = R.events(spark, sf).select("zone").distinct().unionByName(
        R.events(spark, sf).select(F.concat("zone", F.lit("_unknown")).alias("zone")).distinct())
    return out(pit.online_features(asked, feats, FEATURE_FOR_PIT))


def feature_views(spark, sf):
    return out(gold.select_views(R.matrix(spark, sf)))


def metric_bundle(spark, sf):
    return out(metrics.rolling_metrics(R.actuals(spark, sf), R.scored_one(spark, sf)))


def point_metrics(spark, sf):
    return out(metrics.point_metrics(R.scored(spark, sf), ["zone", "model"]))


def baseline_pinball(spark, sf):
    return out(metrics.baseline_pinball(R.actuals(spark, sf), R.scored_one(spark, sf), 20))


def holdout_metrics(spark, sf):
    return out(metrics.holdout_metrics(R.scored(spark, sf), ["zone", "model"]))


def mae_by_hour(spark, sf):
    return out(metrics.mae_by_hour(R.scored(spark, sf), ["zone", "model"]))


def daily_mae(spark, sf):
    return out(metrics.daily_mae(R.scored(spark, sf), ["zone", "model"]))


def error_histogram(spark, sf):
    return out(metrics.error_histogram(R.scored(spark, sf), ["zone", "model"]))


def price_statistics(spark, sf):
    return out(metrics.price_statistics(R.prices(spark, sf)))


def forecast_kpis(spark, sf):
    return out(metrics.forecast_kpis(R.scored_one(spark, sf)))


def last_forecasts(spark, sf):
    return out(metrics.last_forecasts(R.scored_one(spark, sf)))


def spike_analysis(spark, sf):
    return out(metrics.spike_analysis(R.scored(spark, sf), ["zone", "model"]))


def backtest_table(spark, sf):
    return out(metrics.backtest_table(R.scored(spark, sf), ["zone", "model"], digits=12))


def backtest_kpis(spark, sf):
    return out(metrics.backtest_kpis(R.scored(spark, sf), ["zone", "model"]))


def stored_vs_live(spark, sf):
    """Gate-closure reads of the stored median against the live lag forecast."""
    live = R.scored_one(spark, sf)
    stored = bitemporal.read_relative(R.versions(spark, sf).where(F.col("series_id") == dims.SERIES["lgbm_q50"]))
    stored = stored.select("zone", "valid_time", F.col("value").alias("q50"))
    return out(metrics.stored_vs_live(live, metrics.on_forecast_axis(R.actuals(spark, sf), stored)))


def model_comparison(spark, sf):
    m = metrics.holdout_metrics(R.scored(spark, sf), ["zone", "model"])
    return out(metrics.model_comparison(m, list(R.MODELS)))


def period_breakdown(spark, sf):
    return out(metrics.period_breakdown(metrics.holdout_metrics(R.scored(spark, sf), ["zone", "model"]), ["zone", "model"]))


def prefer_stored(spark, sf):
    """Zones whose stored forecasts became known early keep them, the others use the live ones."""
    stored = bitemporal.read_as_of(R.versions(spark, sf), dt.datetime(2023, 12, 29, 2))
    stored = stored.groupBy("zone", "valid_time").agg(
        *[F.max(F.when(F.col("series_id") == i, F.col("value"))).alias(q) for q, i in (("q05", 20), ("q50", 21), ("q95", 22))])
    return out(metrics.prefer_stored(stored, R.scored_one(spark, sf)))


def crps(spark, sf):
    return out(scoring.eval_metrics(R.scored(spark, sf)))


def reliability(spark, sf):
    return out(scoring.reliability(R.scored(spark, sf)))


def _fold_scores(spark, sf):
    return splits.assign_folds(R.scored(spark, sf), *splits.day_range(R.prices(spark, sf)), **FOLD)


def fold_metrics(spark, sf):
    return out(scoring.eval_metrics(_fold_scores(spark, sf), ["zone", "fold", "model"]))


def fold_summary(spark, sf):
    per = scoring.eval_metrics(_fold_scores(spark, sf), ["zone", "fold", "model"])
    return out(scoring.fold_summary(per, ["zone", "model"]))


def fold_reliability(spark, sf):
    per = scoring.reliability(_fold_scores(spark, sf), ["zone", "fold", "model"])
    return out(scoring.reliability_over_folds(per, ["zone", "model"]))


def walk_forward_folds(spark, sf):
    df = R.dense(spark, sf)
    days = splits.day_range(R.prices(spark, sf))
    table = splits.walk_forward_folds(spark, *days, **FOLD)
    return out(splits.usable_folds(df, *days, **FOLD).join(table, "fold"))


def conformal_fit(spark, sf):
    return out(calibrate.conformal_fit(R.scored(spark, sf)))


def conformal_apply(spark, sf):
    scored = R.scored(spark, sf)
    return out(calibrate.conformal_apply(scored, materialize(calibrate.conformal_fit(scored, target_coverage=0.97))))


def quantile_ordering(spark, sf):
    """Lags as quantiles cross often."""
    f = R.forecasts_wide(spark, sf).select("zone", "valid_time", F.col("price_lag48h").alias("q05"),
                                           F.col("price_lag24h").alias("q50"), F.col("price_lag72h").alias("q95"))
    return out(calibrate.order_quantiles(f))


def _base(spark, sf):
    wide = stack.widen_models(R.scored(spark, sf))
    return wide.join(R.actuals(spark, sf), ["zone", "valid_time"], "left")


def base_predictions(spark, sf):
    return out(stack.widen_models(R.scored(spark, sf)))


def ridge_stack(spark, sf):
    return out(stack.stack_fit(_base(spark, sf)), 5)


def stack_predict(spark, sf):
    base = _base(spark, sf)
    scored = stack.stack_predict(base, materialize(stack.stack_fit(base)))
    return out(scored.select("zone", "valid_time", "ens_q05", "ens_q50", "ens_q95"), 5)


def recency_weights(spark, sf):
    return out(splits.recency_weights(R.prices(spark, sf), half_life=240), 8)


def weighted_quantiles(spark, sf):
    """Exact quantiles of the prices of each zone under recency weights."""
    rows = splits.recency_weights(R.prices(spark, sf), half_life=240)
    return out(quantiles.exact_weighted_quantiles(rows, ["zone"], "price", "weight", {"q05": 0.05, "q50": 0.5, "q95": 0.95, "top": 1.0}))


def train_val_split(spark, sf):
    return out(splits.train_val_split(R.prices(spark, sf), cap_half=True))


def expanding_blocks(spark, sf):
    return out(splits.expanding_blocks(R.prices(spark, sf), ["zone"]))


def calendar_split(spark, sf):
    split = splits.calendar_split(F.col("valid_time"), dt.datetime(2024, 1, 30), 12, 4)
    return out(R.prices(spark, sf).withColumn("split", split))


def label_coverage(spark, sf):
    return out(splits.label_coverage(R.dense(spark, sf)))


def promotion_history(spark, sf):
    """Each fold is a registered run of its zone's lag model."""
    per = scoring.eval_metrics(_fold_scores(spark, sf), ["zone", "fold", "model"])
    runs = per.select(F.concat_ws("-", "zone", "model").alias("model_name"), F.col("fold").alias("version"), "mae")
    return out(monitor.promotion_history(runs))


def run_delta(spark, sf):
    runs = metrics.holdout_metrics(_fold_scores(spark, sf), ["zone", "model", "fold"])
    return out(monitor.run_delta(runs, order="fold").select("zone", "model", "fold", "mae", "mae_delta",
                                                            "coverage_q5_q95", "coverage_delta"))


def retrain_gate(spark, sf):
    trained = R.prices(spark, sf).groupBy("zone").agg(
        (F.min("valid_time") + F.expr("interval 23 days") + F.expr("interval 1 hour") * F.length("zone")).alias("trained_at"))
    return out(monitor.retrain_gate(R.prices(spark, sf), trained))


def _tight(spark, sf):
    zones = [z for z, _ in R.RING]
    return spark.createDataFrame(
        [(z, 0.9 + 0.1 * i, 0.8 + 0.2 * i, 0.80 + 0.04 * i, 0.9, 48) for i, z in enumerate(zones)], dims.THRESHOLD_SCHEMA)


def threshold_alerts(spark, sf):
    m = metrics.monitoring_metrics(R.actuals(spark, sf), R.scored_one(spark, sf), 7, 20)
    return out(monitor.threshold_alerts(m, _tight(spark, sf)).drop("reason"), 4)


def drift_report(spark, sf):
    rep = monitor.drift_report(R.actuals(spark, sf), R.scored_one(spark, sf), _tight(spark, sf), 7, 20)
    return out(rep.withColumn("n_alerts", F.size("alerts")).drop("alerts"), 4)


def training_rows(spark, sf):
    rows = features.training_rows(R.matrix(spark, sf))
    return out(rows.select("zone", "valid_time", "price", "price_lag336h", "temp_x_hour"))


# --- fitted models at library defaults; the tables hold one month, so validation is capped, LEAR asks for fewer rows and boosting takes few rounds ---

LEAR_ROWS = 10


def _fitted_matrix(spark, sf):
    return materialize(R.observed_matrix(spark, sf))


def target_encoding(spark, sf):
    rows = R.prices(spark, sf).withColumn("hour", F.hour("valid_time"))
    return out(boosting.ordered_target_mean(rows, "hour"))


def lear_models(spark, sf):
    return out(lear.lear_fit(_fitted_matrix(spark, sf), min_rows=LEAR_ROWS).drop("coef"))


def lear_forecast(spark, sf):
    m = _fitted_matrix(spark, sf)
    scored = lear.lear_predict(m, lear.lear_fit(m, min_rows=LEAR_ROWS))
    return out(scored.select("zone", "valid_time", "lear_q05", "lear_q50", "lear_q95"))


#: Few rounds: every level of a tree is a job.
GBT_SLOTS = {p: replace(s, rounds=4, rate=0.4, depth=2, cap_half=True) for p, s in histboost.SLOTS.items()}


def quantile_gbt(spark, sf):
    """All three boosted slots."""
    m = _fitted_matrix(spark, sf)
    return out(zoneboost.predict(m, materialize(histboost.fit_slots(m, GBT_SLOTS)), list(GBT_SLOTS)))


STUMP = zoneboost.BoostSettings(rounds=1, rate=1.0, depth=1, min_leaf=1, row_share=1.0, column_share=1.0, l1=0.0, l2=0.0,
                                val_share=0.0, half_life=None)


def boosted_leaves(spark, sf):
    """One tree of one split: each half of the day gets the quantiles of its own prices. Saved, loaded, then scored."""
    rows = R.prices(spark, sf).withColumn("late", (F.hour("valid_time") >= 12).cast("double"))
    path = f"{ensure_checkpoint_dir(spark)}/boosted-leaves-{uuid.uuid4().hex}"
    zoneboost.save(histboost.fit(rows, STUMP, features=["late"]), path)
    return out(zoneboost.predict(rows, zoneboost.load(spark, path)))


def boosted_two_levels(spark, sf):
    """One tree of two levels, whose splits are chosen by penalised gain among the day's quarters and the weekend."""
    rows = R.prices(spark, sf).withColumns({
        "part": F.floor(F.hour("valid_time") / 6).cast("double"), "weekend": F.dayofweek("valid_time").isin(1, 7).cast("double")})
    settings = replace(STUMP, depth=2, min_leaf=24, l1=0.3, l2=0.3)
    return out(zoneboost.predict(rows, histboost.fit(rows, settings, features=["part", "weekend"])))


def quantile_forest(spark, sf):
    m = _fitted_matrix(spark, sf)
    scored = forest.forest_predict(m, forest.forest_fit(m))
    return out(scored.select("zone", "valid_time", "xgb_q05", "xgb_q50", "xgb_q95"))


def contributions(spark, sf):
    """Mean absolute contribution per feature of the forest's median over every row it can score."""
    m = _fitted_matrix(spark, sf)
    model = forest.forest_fit(m)
    rows = m.where(features.scorable(model.features)).select("zone", "valid_time", *model.features)
    values = explain.shapley_values(
        rows, model.features, lambda d: forest.forest_predict(d, model).withColumn("score", F.col("xgb_q50")))
    return out(explain.contribution_summary(values))


def _seasonal_fit(train):
    return train.groupBy("zone", F.hour("valid_time").alias("_h")).agg(
        F.min("price").alias("q05"), F.avg("price").alias("q50"), F.max("price").alias("q95"))


def _seasonal_predict(test, fitted):
    return test.select("zone", "valid_time", F.hour("valid_time").alias("_h")).join(fitted, ["zone", "_h"], "left").drop("_h")


def walk_forward(spark, sf):
    """Refit per fold: hour-of-day mean and range of the training window."""
    result = evaluation.walk_forward(R.dense(spark, sf), {"seasonal": (_seasonal_fit, _seasonal_predict)},
                                     *splits.day_range(R.prices(spark, sf)), **FOLD)
    return out(result.fold_metrics)


def walk_forward_lear(spark, sf):
    """LEAR on one lag in every fold, all folds from one pass; one feature has a closed form."""
    result = lear_walk.walk_forward_lear(
        R.forecasts_wide(spark, sf), *splits.day_range(R.prices(spark, sf)), **FOLD, features=["price_lag24h"], min_rows=LEAR_ROWS)
    return out(result.fold_metrics)


def batch_forecast(spark, sf):
    """Base models on all but the last week, calibration and blend on that week but its last two days, which are asked for."""
    m = _fitted_matrix(spark, sf)
    t, (_, end) = F.col("valid_time"), splits.day_range(m)
    fit_end, day = end - dt.timedelta(days=7), end - dt.timedelta(days=2)
    config = training.TrainConfig(slots=GBT_SLOTS, lear_min_rows=LEAR_ROWS)
    window = m.where((t >= F.lit(fit_end)) & (t < F.lit(day)))
    models = training.calibrate_and_blend(training.fit_base(m.where(t < F.lit(fit_end)), config), window)
    requests = m.select("zone").distinct().withColumn("date", F.lit(day).cast("date"))
    answers = forecast.batch_forecast(m, requests, models.predict, "v1", day - dt.timedelta(hours=12))
    hours = answers.select("zone", "date", F.explode("forecast").alias("h"))
    return out(hours.select("zone", F.col("date").cast("string").alias("date"), "h.*"))


# --- normalisers, scans and single functions ---


def normalize_prices(spark, sf):
    return out(bronze.normalize_prices(R.dense(spark, sf), value="price"))


def normalize_load(spark, sf):
    dense = features.reindex_hourly(R.load_hourly(spark, sf), ["value_mw"])
    return out(bronze.normalize_load(dense.select("valid_time", "value_mw", "zone")))


def normalize_generation(spark, sf):
    return out(bronze.normalize_generation(R.fuel_long(spark, sf), list(R.FUELS.values())))


def normalize_crossborder(spark, sf):
    return out(bronze.normalize_crossborder(R.region_flows(spark, sf).withColumnRenamed("value_mw", "value")))


def normalize_weather(spark, sf):
    return out(bronze.normalize_weather(R.weather_payload(spark, sf)))


def weather_wide(spark, sf):
    return out(bronze.weather_wide(bronze.normalize_weather(R.weather_payload(spark, sf))))


def holiday_flags(spark, sf):
    days = R.table(spark, sf, "orders").selectExpr("CAST(o_orderdate AS TIMESTAMP) AS valid_time").distinct()
    return out(with_swedish_holiday(days))


def scan_window(spark, sf):
    rows = silver.scan_window(R.events(spark, sf), "view", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6, 12), ordered=False)
    return out(rows.select("event_id", "valid_time", "value"))


def explorer_window(spark, sf):
    return out(metrics.price_statistics(silver.between_dates(R.prices(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 9))))


def naive_mae(spark, sf):
    return out(metrics.naive_mae(R.actuals(spark, sf)))


def any_drift(spark, sf):
    rep = monitor.drift_report(R.actuals(spark, sf), R.scored_one(spark, sf), _tight(spark, sf), 7, 20)
    return out(monitor.any_drift(rep))


def spike_hours(spark, sf):
    return out(R.prices(spark, sf).where(F.col("price") > S.SPIKE_PRICE))


QUERIES = {
    f.__name__: f
    for f in [
        hourly_series, spine_reindex, price_lags, rolling_stats, calendar_features, weather_ffill, feature_matrix,
        inference_slice, silver_generation, silver_load, silver_crossborder, net_exchange, imports_exports, dq_prices,
        dq_weather, dq_generation, dq_silver_load, read_latest, read_latest_wide, read_versions, read_as_of,
        read_relative, provenance, retention, pit_join, pit_join_ttl, feature_service, online_latest, feature_views, metric_bundle,
        point_metrics, baseline_pinball, holdout_metrics, mae_by_hour, daily_mae, error_histogram, price_statistics,
        forecast_kpis, last_forecasts, spike_analysis, backtest_table, backtest_kpis, stored_vs_live, model_comparison,
        period_breakdown, prefer_stored, crps, reliability, fold_metrics, fold_summary, fold_reliability,
        walk_forward_folds, conformal_fit, conformal_apply, quantile_ordering, base_predictions, ridge_stack,
        stack_predict, recency_weights, weighted_quantiles, train_val_split, expanding_blocks, calendar_split, label_coverage,
        promotion_history, run_delta, retrain_gate, threshold_alerts, drift_report, training_rows,
        target_encoding, walk_forward, walk_forward_lear, lear_models, lear_forecast, quantile_gbt, boosted_leaves,
        boosted_two_levels, quantile_forest, contributions,
        batch_forecast, normalize_prices, normalize_load, normalize_generation, normalize_crossborder, normalize_weather,
        weather_wide, holiday_flags, scan_window, explorer_window, naive_mae, any_drift, spike_hours,
    ]
}
