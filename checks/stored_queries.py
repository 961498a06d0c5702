"""Queries that write with the library's sinks, read back, and look up; their DuckDB counterparts are at the end.

Every query writes into a fresh folder of the checkpoint directory, so runs never meet.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks import duckdb_queries as Q
from checks import roles as R
from checks.spark_queries import _tight, out
from zonecast.operators import features, metrics, monitor, quality, splits
from zonecast.plans import forecast, training
from zonecast.session import ensure_checkpoint_dir
from zonecast.sources import bitemporal, bronze, dims, export, gold, gold_refresh, runs, silver


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bronze_days(spark, sf):
    """All days written, one of them replaced by corrected prices, then a range of days read."""
    root, rows = _folder(spark, "bronze"), R.prices(spark, sf).select("valid_time", F.col("price").alias("value"), "zone")
    first = splits.day_range(rows)[0]
    bronze.bronze_write(rows, root, "prices")
    day = first + dt.timedelta(days=5)
    corrected = rows.where(F.to_date("valid_time") == F.lit(day).cast("date")).withColumn("value", F.col("value") + 1000)
    bronze.bronze_write(corrected, root, "prices")
    got = bronze.bronze_read_range(spark, root, "prices", (first + dt.timedelta(days=3)).date(), (first + dt.timedelta(days=10)).date())
    return out(got.select("zone", "valid_time", "value"))


def stored_versions(spark, sf):
    """Two appends of versions; the newest of two series in a range of valid times."""
    path, rows = _folder(spark, "versions"), R.versions(spark, sf)
    for part in (F.col("value") < 50, ~(F.col("value") < 50)):
        bitemporal.write_series(rows.where(part), path, knowledge_time=F.col("knowledge_time"))
    got = bitemporal.read_versions(spark, path, [20, 22], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 7))
    return out(bitemporal.read_latest(got))


def retained_versions(spark, sf):
    """Stored versions rewritten without what their tier no longer keeps."""
    path, kept = _folder(spark, "versions"), _folder(spark, "retained")
    rows = R.versions(spark, sf)
    for tier in ("short", "medium", "forever"):
        bitemporal.write_series(rows.where(F.col("retention") == tier), path, knowledge_time=F.col("knowledge_time"), retention=tier)
    bitemporal.rewrite_retained(spark, path, kept, dt.datetime(2024, 2, 10), {"short": 20, "medium": 30})
    return out(bitemporal.read_versions(spark, kept))


def write_once_runs(spark, sf):
    """Two runs, both written twice, the second also torn half-way before; the newest of two series in a range."""
    root, rows = _folder(spark, "runs"), R.versions(spark, sf)
    low, high = rows.where("value < 50"), rows.where("NOT value < 50")
    runs.write_run(low, root, "low")
    runs.write_rows(high.where("series_id < 22"), root)
    for name, part in (("low", low), ("high", high), ("high", high)):
        runs.write_run(part, root, name)
    return out(bitemporal.read_latest(runs.read_runs(spark, root, [20, 22], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 7))))


def retained_months(spark, sf):
    """Retention in place: all of one tier goes as folders, the month that holds the other limit is read."""
    root = _folder(spark, "runs")
    runs.write_run(R.versions(spark, sf), root, "all")
    runs.drop_expired(spark, root, dt.datetime(2024, 2, 10), {"short": 5, "medium": 30})
    return out(runs.read_runs(spark, root).drop("run"))


def persisted_forecasts(spark, sf):
    """Six forecast series stored as one run by a training that was started twice, read back side by side."""
    root, known = _folder(spark, "runs"), dt.datetime(2024, 2, 1)
    scored = R.scored(spark, sf).where(F.col("model").isin("lgbm", "lear"))
    wide = scored.groupBy("zone", "valid_time").agg(*[
        F.max(F.when(F.col("model") == m, F.col(q))).alias(f"{m}_{q}") for m in ("lgbm", "lear") for q in training.QUANTILES])
    for _ in range(2):
        runs.write_run(bitemporal.forecasts_to_versions(wide, training.STORED_SERIES, known), root, known.isoformat())
    return out(bitemporal.read_latest_wide(runs.read_runs(spark, root), training.STORED_SERIES))


def served_forecasts(spark, sf):
    """Answers to two requests for forecasts, each stored under the time it was served; what each run holds."""
    root, one = _folder(spark, "runs"), R.scored_one(spark, sf).drop("y")
    served = one.withColumnsRenamed({q: f"ens_{q}" for q in training.QUANTILES})
    for day in (20, 25):
        of_day = served.where(F.to_date("valid_time") >= F.lit(dt.date(2024, 1, day)))
        runs.write_run(forecast.served_versions(of_day, dt.datetime(2024, 1, day - 1, 11)), root, f"served-{day}")
    return out(runs.read_runs(spark, root).drop("retention"))


def silver_table(spark, sf):
    """Full refresh of a month-partitioned table, read by an ordered half-open range."""
    path = _folder(spark, "silver")
    silver.refresh_table(silver.silver_load(R.region_load(spark, sf)), "load_actual", path)
    rows = silver.scan_window(silver.read_table(spark, "load_actual", path), "ASIA", dt.datetime(1996, 2, 10), dt.datetime(1997, 5, 3))
    return out(rows.select("valid_time", "zone", "value_mw"), 2)


def gold_table(spark, sf):
    """The feature matrix stored by zone and month; its last month is written a second time."""
    path, rows = _folder(spark, "gold"), R.matrix(spark, sf)
    gold.write_gold(rows, path)
    gold.write_gold(rows.where(F.month("valid_time") == 1), path)
    return out(gold.read_gold(spark, path).select(*rows.columns))


def gold_refreshed(spark, sf):
    """Gold from the events of the first 20 days, then brought up to date with the late ones of some zones and hours."""
    path, ev = _folder(spark, "gold"), R.events(spark, sf)
    late = F.expr("ts >= TIMESTAMP '2024-01-21' OR (zone IN ('click', 'view') AND event_id % 7 = 0)")

    def sources(rows):
        return {"price": R.prices(spark, sf, rows), "weather": R.weather(spark, sf, rows), "generation": R.generation_hourly(spark, sf, rows),
                "load": R.load_hourly(spark, sf, rows), "flows": R.ring_flows(spark, sf, rows)}

    def changed(rows):
        hours = rows.select("zone", "valid_time").distinct()
        return dict.fromkeys(("price", "weather", "generation", "load"), hours) | {"flows": gold_refresh.changed_ends(R.ring_flows(spark, sf, rows))}

    early = ev.where(~late)
    gold_refresh.refresh_gold(spark, path, changed(early), first_build=True, **sources(early))
    gold_refresh.refresh_gold(spark, path, changed(ev.where(late)), **sources(ev))
    return out(gold.read_gold(spark, path).select(*features.MATRIX_COLS))


def csv_table(spark, sf):
    path = _folder(spark, "csv")
    export.write_csv(R.prices(spark, sf).withColumn("price", F.col("price") + 1e-9), path)
    return out(spark.read.option("header", "true").schema("zone string, valid_time timestamp, price double").csv(path))


def json_reports(spark, sf):
    """Drift reports as JSON lines, parsed again."""
    report = monitor.drift_report(R.actuals(spark, sf), R.scored_one(spark, sf), _tight(spark, sf), 7, 20)
    path = _folder(spark, "reports")
    export.write_json(monitor.report_json(report), path)
    parsed = F.from_json("report", "zone string, metrics struct<mae_eur: double, rmae: double, n_hours: bigint>, "
                                   "baseline_pinball_q50 double, drift_detected boolean, alerts array<struct<metric: string>>")
    rows = spark.read.schema("zone string, report string").json(path).select(parsed.alias("r"))
    return out(rows.select("r.zone", "r.metrics.mae_eur", "r.metrics.rmae", "r.metrics.n_hours", "r.baseline_pinball_q50",
                           "r.drift_detected", F.size("r.alerts").alias("n_alerts")), 4)


def zone_lookup(spark, sf):
    """Customers dealt to zones by nation, zone ids resolved to codes."""
    ids = F.array(*[F.lit(z[0]) for z in dims.ZONES])
    facts = R.table(spark, sf, "customer").select("c_custkey", F.get(ids, F.pmod("c_nationkey", F.lit(len(dims.ZONES))).cast("int")).alias("zone"))
    return out(dims.resolve_zone_ids(facts))


def inference_rows(spark, sf):
    """Rows that a model can score, with or without a known price, and integer categories."""
    rows = features.categorical_int(R.matrix(spark, sf))
    return out(rows.where(features.scorable(features.MODEL_FEATURES)).select("zone", "valid_time", "hour", "month", "price_lag168h"))


def valid_requests(spark, sf):
    requests = R.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("zone"), F.col("o_orderdate").cast("date").alias("date"))
    checked = monitor.valid_requests(requests.distinct(), dt.date(1998, 3, 4))
    return out(checked.select("zone", F.col("date").cast("string").alias("date"), "valid"))


def display_forecast(spark, sf):
    """Quantiles as displayed, with two digits."""
    shifted = [(F.col(q) + 1e-9).alias(q) for q in training.QUANTILES]
    return out(metrics.round_forecast(R.scored_one(spark, sf).select("zone", "valid_time", *shifted)), 2)


def aligned_pairs(spark, sf):
    return out(metrics.aligned(R.actuals(spark, sf), R.scored_one(spark, sf).drop("y")))


def dq_silver_generation(spark, sf):
    from zonecast.operators import exchange

    wide = bronze.normalize_generation(R.fuel_long(spark, sf), list(R.FUELS.values()))
    return out(quality.check_silver(exchange.fuel_totals(wide), "silver_generation"))


def silver_generation_rows(spark, sf):
    """The values that ``dq_silver_generation`` checks: total, wind and solar per hour and zone."""
    from zonecast.operators import exchange

    return out(exchange.fuel_totals(bronze.normalize_generation(R.fuel_long(spark, sf), list(R.FUELS.values()))))


def dq_silver_crossborder(spark, sf):
    return out(quality.check_silver(silver.silver_crossborder(R.region_flows(spark, sf)), "silver_crossborder"))


QUERIES = {f.__name__: f for f in [
    bronze_days, stored_versions, retained_versions, write_once_runs, retained_months, persisted_forecasts, served_forecasts,
    silver_table, gold_table, gold_refreshed, csv_table, json_reports, zone_lookup,
    inference_rows, valid_requests, display_forecast, aligned_pairs, dq_silver_generation, silver_generation_rows,
    dq_silver_crossborder,
]}

_r, _rr, _S = Q.r, Q.rr, Q.S
_not_null = " AND ".join(f"price_lag{h}h IS NOT NULL" for h in Q.LAGS) + " AND price_roll24h IS NOT NULL AND price_roll168h IS NOT NULL"
_zones = ", ".join(f"({i}, '{z[1]}')" for i, z in enumerate(dims.ZONES))

_pairs = [(m, q) for m in ("lgbm", "lear") for q in ("q05", "q50", "q95")]
_six = ", ".join(f"max({q}) FILTER (WHERE model = '{m}') AS {m}_{q}" for m, q in _pairs)
_ens = ", ".join("{'sid': %d, 'v': %s}" % (dims.SERIES[f"ens_{q}"], q) for q in ("q05", "q50", "q95"))



def _fuel_sum(names):
    return " + ".join(f'coalesce("{n}", 0)' for n in names)


ORACLE = {
    "bronze_days": f"""WITH {_S}, f AS (SELECT CAST(min(valid_time) AS DATE) AS d FROM s)
 SELECT zone, valid_time, {_r('price + CASE WHEN CAST(valid_time AS DATE) = d + 5 THEN 1000 ELSE 0 END')} AS value FROM s, f
 WHERE CAST(valid_time AS DATE) BETWEEN d + 3 AND d + 10""",
    "stored_versions": f"WITH {Q.V} " + Q.LATEST % ("v WHERE series_id IN (20, 22) AND valid_time >= TIMESTAMP '2024-01-05' "
                                                  "AND valid_time < TIMESTAMP '2024-01-20 07:00'"),
    "retained_versions": f"""WITH {Q.V} SELECT zone, series_id, valid_time, value, knowledge_time, retention FROM v
 WHERE NOT (retention = 'short' AND valid_time < TIMESTAMP '2024-01-21') AND NOT (retention = 'medium' AND valid_time < TIMESTAMP '2024-01-11')""",
    "retained_months": f"""WITH {Q.V} SELECT zone, series_id, valid_time, value, knowledge_time, retention FROM v
 WHERE retention = 'forever' OR (retention = 'medium' AND valid_time >= TIMESTAMP '2024-01-11')""",
    "persisted_forecasts": f"""WITH {Q.SC}, w AS (SELECT zone, valid_time, {_six} FROM sc GROUP BY 1, 2)
 SELECT zone, valid_time, {_rr([f'{m}_{q}' for m, q in _pairs])} FROM w WHERE coalesce({', '.join(f'{m}_{q}' for m, q in _pairs)}) IS NOT NULL""",
    "served_forecasts": f"""WITH {Q.ONE}, days AS (SELECT unnest([20, 25]) AS day),
 u AS (SELECT zone, valid_time, unnest([{_ens}]) AS e FROM one),
 f AS (SELECT zone, valid_time, e.sid AS series_id, e.v AS value FROM u WHERE e.v IS NOT NULL)
 SELECT zone, series_id, valid_time, {_r('value')} AS value, make_timestamp(2024, 1, day - 1, 11, 0, 0) AS knowledge_time, 'served-' || day AS run
 FROM f, days WHERE CAST(valid_time AS DATE) >= make_date(2024, 1, day)""",
    "silver_table": f"""WITH {Q.RLOAD} SELECT valid_time, zone, {_r('value_mw', 2)} AS value_mw FROM rl WHERE value_mw > 0 AND zone = 'ASIA'
 AND valid_time >= TIMESTAMP '1996-02-10' AND valid_time < TIMESTAMP '1997-05-03'""",
    "gold_table": Q.ORACLE["feature_matrix"],
    "gold_refreshed": Q.ORACLE["feature_matrix"],
    "csv_table": f"WITH {_S} SELECT zone, valid_time, {_r('price', 2)} AS price FROM s",
    "json_reports": f"""WITH {Q.TAIL}, c AS (SELECT zone, count(*) AS k FROM alerts GROUP BY 1)
 SELECT al.zone, {", ".join(f"{_r(f'round({n}, 4)', 4)} AS {n}" for n in ('mae_eur', 'rmae', 'baseline_pinball_q50'))},
 n_hours, coalesce(k, 0) > 0 AS drift_detected, coalesce(k, 0) AS n_alerts FROM al LEFT JOIN c USING (zone)""",
    "zone_lookup": f"SELECT c_custkey, eic AS zone FROM customer JOIN (VALUES {_zones}) z(i, eic) ON c_nationkey % {len(dims.ZONES)} = i",
    "inference_rows": f"""WITH {Q.D}, {Q.matrix('spine')}, m AS ({Q.MATRIX_SELECT}) SELECT zone, valid_time, hour, month, price_lag168h FROM m
 WHERE temperature IS NOT NULL AND {_not_null}""",
    "valid_requests": """SELECT DISTINCT o_custkey::VARCHAR AS zone, o_orderdate::DATE::VARCHAR AS date, o_orderdate::DATE >= DATE '1998-03-05' AS valid FROM orders""",
    "display_forecast": f"WITH {Q.ONE} SELECT zone, valid_time, {_rr(['q05', 'q50', 'q95'], 2)} FROM one",
    "aligned_pairs": f"WITH {Q.ONE} SELECT zone, valid_time, {_rr(['y', 'q05', 'q50', 'q95'])} FROM one WHERE y IS NOT NULL AND q50 IS NOT NULL",
    "dq_silver_generation": f"""WITH {Q.FUEL}, t AS (SELECT valid_time, zone, {_fuel_sum(R.FUELS.values())} AS total_mw, {_fuel_sum(['Wind Onshore'])} AS wind_mw,
 {_fuel_sum(['Solar'])} AS solar_mw FROM fuel) """ + Q.quality("t", "silver_generation", [
        *[(c, "exists", "0") for c in quality.SILVER_NOT_NULL["silver_generation"]],
        *[(c, "not_null", Q.failing("t", f"{c} IS NULL")) for c in quality.SILVER_NOT_NULL["silver_generation"]]]),
    "silver_generation_rows": f"""WITH {Q.FUEL} SELECT valid_time, zone, {_r(_fuel_sum(R.FUELS.values()))} AS total_mw,
 {_r(_fuel_sum(['Wind Onshore']))} AS wind_mw, {_r(_fuel_sum(['Solar']))} AS solar_mw FROM fuel""",
    "dq_silver_crossborder": f"WITH {Q.RFLOW} " + Q.quality("rf", "silver_crossborder", [
        *[(c, "exists", "0") for c in quality.SILVER_NOT_NULL["silver_crossborder"]],
        *[(c, "not_null", Q.failing("rf", f"{c} IS NULL")) for c in quality.SILVER_NOT_NULL["silver_crossborder"]]]),
}
ORACLE["write_once_runs"] = ORACLE["stored_versions"]
