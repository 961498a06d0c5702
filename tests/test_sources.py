import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import START, ZONE, by, frame, hours
from zonecast.operators import pit, quality
from zonecast.sources import bitemporal as B
from zonecast.sources import bronze, dims, export, gold, silver

DAY = dt.datetime(2026, 6, 25)


def test_dimensions(spark):
    ids = list(dims.SERIES.values())
    assert len(ids) == len(set(ids)) == 20 and dims.series(spark).count() == 20
    assert dims.zone_by_id(spark, "SE3").first()["entsoe_eic"] == ZONE and dims.zones(spark).count() == 4
    with pytest.raises(ValueError, match="Unknown zone"):
        dims.zone_by_id(spark, "XX")
    with pytest.raises(KeyError):
        dims.thresholds_by_zone(dims.thresholds(spark), "XX")
    assert dims.thresholds_by_zone(dims.thresholds(spark), "SE1").first()["window_days"] == 7
    pairs = dims.zone_pairs(spark)
    assert pairs.count() == 3
    with pytest.raises(ValueError):
        dims.zone_pairs(spark, [("SE1", "NO1")])
    facts = spark.createDataFrame([("SE3", 1.0)], "zone string, v double")
    assert dims.resolve_zone_ids(facts).first()["zone"] == ZONE
    with pytest.raises(Exception, match="Unknown zone"):
        dims.resolve_zone_ids(facts.withColumn("zone", F.lit("XX"))).collect()
    now = dt.datetime(2026, 5, 4, 10, 30)
    assert dims.ingest_window("prices", now, START)[1] == dt.datetime(2026, 5, 6)
    assert dims.ingest_window("load", now, START)[1] == dt.datetime(2026, 5, 4, 10)


def test_normalisers(spark):
    raw = spark.createDataFrame([("2026-06-25T00:00:00Z", 50.0, ZONE), ("2026-06-25T01:00:00Z", None, ZONE),
                                 ("2026-06-25T02:00:00Z", float("nan"), ZONE)], "valid_time string, value double, zone string")
    p = bronze.normalize_prices(raw)
    assert p.columns == ["valid_time", "value", "zone"] and p.count() == 1 and p.first()["valid_time"] == DAY
    load = bronze.normalize_load(raw.withColumnRenamed("value", "Actual Load"))
    assert load.columns == ["valid_time", "actual_load", "zone"] and load.count() == 1
    flows = bronze.normalize_crossborder(raw.select("valid_time", "value"), F.lit("a"), F.lit("b"))
    assert flows.columns == ["valid_time", "value", "from_zone", "to_zone"] and flows.count() == 1
    pairs = spark.createDataFrame([("a", "b")], "from_zone string, to_zone string")
    assert bronze.wanted_pairs(flows, pairs).count() == 1
    gen = spark.createDataFrame(
        [(DAY, ZONE, "Solar", "Actual Aggregated", 1.0), (DAY, ZONE, "Solar", "Actual Consumption", 9.0),
         (DAY, ZONE, "Nuclear", "Actual Aggregated", 3.0), (DAY + dt.timedelta(hours=1), ZONE, "Solar", "Actual Aggregated", None)],
        "valid_time timestamp, zone string, fuel string, kind string, value double")
    wide = bronze.normalize_generation(gen)
    assert wide.columns == ["valid_time", "Nuclear", "Solar", "zone"] and wide.count() == 1 and wide.first()["Solar"] == 1.0


def test_weather_payload(spark):
    start = int(DAY.replace(tzinfo=dt.timezone.utc).timestamp())
    payload = spark.createDataFrame(
        [(ZONE, start, start + 3 * 3600, 3600, [1.0, None, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, None])],
        "zone string, start_s long, end_s long, step_s long, temperature_2m array<double>, wind_speed_10m array<double>, "
        "shortwave_radiation array<double>")
    long = bronze.normalize_weather(payload)
    assert long.groupBy("variable").count().where("count = 2").count() == 2 and long.count() == 7
    wide = by(bronze.weather_wide(long), "valid_time")
    # hour 1 has no value of the first variable, so it is not on the spine
    assert sorted(k[0].hour for k in wide) == [0, 2] and wide[(DAY + dt.timedelta(hours=2),)]["shortwave_radiation"] is None


def test_bronze_days_are_idempotent_and_pruned(spark, tmp_path):
    root = str(tmp_path / "bronze")
    df = frame(spark, hours(48, DAY), "value double", [50.0] * 48)
    bronze.bronze_write(df, root, "prices")
    bronze.bronze_write(df.where(F.to_date("valid_time") == DAY.date()).withColumn("value", F.lit(60.0)), root, "prices")
    back = bronze.bronze_read_range(spark, root, "prices", DAY.date(), DAY.date() + dt.timedelta(days=5), ZONE)
    assert back.count() == 48 and back.where("value = 60").count() == 24
    one = bronze.bronze_read_range(spark, root, "prices", DAY.date(), DAY.date())
    assert one.count() == 24
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert bronze.bronze_read_range(spark, root, "load", DAY.date(), DAY.date()).count() == 0
    gen = frame(spark, [DAY], "Solar double", [1.0])
    bronze.bronze_write(gen, root, "generation")
    bronze.bronze_write(frame(spark, [DAY + dt.timedelta(days=1)], "Hydro double", [2.0]), root, "generation")
    both = bronze.bronze_read_range(spark, root, "generation", DAY.date(), DAY.date() + dt.timedelta(days=1), merge=True)
    assert {"Solar", "Hydro"} <= set(both.columns) and both.count() == 2
    assert bronze.union_days([df, gen]).count() == 49


def test_silver_rules_and_layout(spark, tmp_path):
    gen = spark.createDataFrame([(DAY, "z", 3.0, 1.0, 0.0), (DAY, "z", -1.0, 1.0, 0.0), (DAY, "z", 3.0, None, 0.0), (None, "z", 1.0, 1.0, 1.0)],
                                "valid_time timestamp, zone string, total_mw double, wind_mw double, solar_mw double")
    assert silver.silver_generation(gen).count() == 1 and "loaded_at" in silver.silver_generation(gen, audit=True).columns
    load = spark.createDataFrame([(DAY, "z", 0.0), (DAY, "z", 5.0), (DAY, None, 5.0)], "valid_time timestamp, zone string, value_mw double")
    assert silver.silver_load(load).count() == 1
    flow = spark.createDataFrame([(DAY, "a", "b", -5.0), (DAY, "a", "b", None), (DAY, None, "b", 1.0)],
                                 "valid_time timestamp, from_zone string, to_zone string, value_mw double")
    assert silver.silver_crossborder(flow).count() == 2
    path = str(tmp_path / "load")
    rows = frame(spark, hours(24 * 60), "value_mw double", [1.0] * 24 * 60)
    silver.write_silver(rows, path, ["zone", "valid_time"])
    silver.write_silver(rows, path, ["zone", "valid_time"], mode="ignore")
    scan = silver.scan_window(spark.read.parquet(path), ZONE, START, START + dt.timedelta(days=1))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 24 and "ym" in plan.split("PartitionFilters")[1][:60] and "GreaterThanOrEqual(valid_time" in plan
    assert silver.read_or_empty(spark, "no_such_table", "a int").count() == 0
    assert silver.between_dates(rows, START.date(), START.date()).count() == 24
    assert silver.recent_days(rows, START + dt.timedelta(days=60), 1).count() == 24


def version_rows():
    t = DAY
    k = lambda h: DAY - dt.timedelta(hours=h)
    return [("z", 21, t, 1.0, k(30), "forever"), ("z", 21, t, 2.0, k(12), "forever"), ("z", 21, t, 3.0, k(2), "forever"),
            ("z", 21, t, 9.0, k(2), "forever"), ("z", 22, t, 5.0, k(40), "medium"), ("y", 21, t, 7.0, k(1), "short")]


def test_bitemporal_reads(spark):
    v = spark.createDataFrame(version_rows(), B.SCHEMA)
    latest = by(B.read_latest(v), "zone", "series_id")
    assert latest[("z", 21)]["value"] == 9.0  # equal knowledge times: the larger value
    asof = by(B.read_as_of(v, DAY - dt.timedelta(hours=12)), "zone", "series_id")
    assert asof[("z", 21)]["value"] == 1.0 and ("y", 21) not in asof  # strictly before
    assert B.read_as_of(v, DAY, DAY.date() + dt.timedelta(days=1)).count() == 0
    gate = by(B.read_relative(v), "zone", "series_id")
    assert gate[("z", 21)]["value"] == 2.0 and ("y", 21) not in gate  # noon of the day before, inclusive
    assert by(B.read_relative(v, 2, dt.time(0, 0)), "zone", "series_id") == {}
    wide = by(B.read_latest_wide(v, {"m": 21, "hi": 22, "none": 99}), "zone")
    assert wide[("z",)]["m"] == 9.0 and wide[("z",)]["hi"] == 5.0 and wide[("z",)]["none"] is None
    names = by(B.with_series_name(v.withColumn("series_id", F.when(F.col("zone") == "y", 99).otherwise(F.col("series_id"))), dims.series(spark)), "zone", "value")
    assert names[("z", 5.0)]["name"] == "lgbm_q95" and names[("y", 7.0)]["name"] == "99"
    now = DAY + dt.timedelta(days=100)
    assert B.apply_retention(v, now).where("retention = 'short'").count() == 0
    assert B.apply_retention(v, now).where("retention = 'medium'").count() == 1
    assert B.apply_retention(v, DAY + dt.timedelta(days=1096)).where("retention = 'medium'").count() == 0


def test_versions_are_appended(spark, tmp_path):
    path = str(tmp_path / "series")
    df = frame(spark, hours(24), "value double", [1.0] * 24)
    B.write_series(df, path, series_id=21, knowledge_time=START)
    B.write_series(df.withColumn("value", F.lit(2.0)), path, series_id=21, knowledge_time=START + dt.timedelta(hours=1))
    v = B.read_versions(spark, path, [21], START, START + dt.timedelta(hours=12))
    assert v.count() == 24 and B.read_latest(v).where("value = 2").count() == 12
    p = by(B.provenance(v), "knowledge_time")
    assert p[(START,)]["hours_stored"] == 12
    f = frame(spark, hours(3), "lgbm_q50 double, lear_q50 double", [1.0, None, 3.0], [4.0, 5.0, 6.0])
    stored = B.forecasts_to_versions(f, {"lgbm_q50": 21, "lear_q50": 31, "absent": 1}, START)
    assert stored.count() == 5 and stored.where("series_id = 31").count() == 3


def test_gold_views(spark, tmp_path):
    from zonecast.operators import features as X

    price = frame(spark, hours(48), "price double", [1.0] * 48)
    m = X.build_features(price)
    path = str(tmp_path / "gold")
    gold.write_gold(m, path)
    gold.write_gold(m, path)
    back = gold.read_gold(spark, path)
    assert back.count() == 48 and set(m.columns) == set(back.columns)
    views = gold.select_views(back)
    assert len(views.columns) == 2 + 11 + 14 + 9
    assert dict(views.dtypes)["hour"] == "bigint" and dict(views.dtypes)["hour_x_month"] == "double"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456)], "zone string, v double")
    export.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["v"] == "1.23"
    export.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["v"] == 1.23456
    assert export.to_json_lines(df).first()["report"] == '{"zone":"a","v":1.23456}'


def brute_pit(entities, feats, ttl):
    out = {}
    for i, z, t in entities:
        known = [(ft, v) for fz, ft, v in feats if fz == z and ft <= t and t - ft <= ttl]
        out[i] = max(known)[1] if known else None
    return out


@pytest.mark.parametrize("hourly", [True, False])
def test_point_in_time_join_against_brute_force(spark, hourly):
    import random

    rng = random.Random(3)
    ttl = dt.timedelta(hours=30)
    feats = [(z, START + dt.timedelta(hours=h), float(h)) for z in "ab" for h in range(0, 600) if rng.random() < 0.04]
    ents = [(i, rng.choice("abc"), START + dt.timedelta(minutes=rng.randrange(-600, 600 * 60))) for i in range(400)]
    ents += [(1000 + i, z, t) for i, (z, t, _) in enumerate(feats[:20])]  # equal times see the feature
    ents += [(2000 + i, "a", feats[0][1] + ttl) for i in range(200)]  # one hot time, exactly at the limit
    e = spark.createDataFrame([(i, z, t, 1.0) for i, z, t in ents], "id int, zone string, valid_time timestamp, price double")
    f = spark.createDataFrame(feats, "zone string, valid_time timestamp, x double")
    got = pit.point_in_time_join(e, f, ["x"], ttl_hours=30, hourly_features=hourly).collect()
    assert len(got) == len(ents) and {r["id"]: r["x"] for r in got} == brute_pit(ents, feats, ttl)


def test_online_features(spark):
    f = spark.createDataFrame([("a", START, 1.0), ("a", START + dt.timedelta(hours=1), 2.0)], "zone string, valid_time timestamp, x double")
    asked = spark.createDataFrame([("a",), ("q",)], "zone string")
    got = by(pit.online_features(asked, f, ["x"]), "zone")
    assert got[("a",)]["x"] == 2.0 and got[("q",)]["x"] is None


def failures(result):
    return {(r["column"], r["expectation"]): r["n_failed"] for r in result.collect() if not r["success"]}


def test_price_suite(spark):
    good = frame(spark, hours(24, DAY), "value double", [50.0] * 24)
    assert failures(quality.check_prices(good)) == {}
    assert failures(quality.check_prices(good.withColumn("value", F.when(F.hour("valid_time") == 3, None).otherwise(50.0)))) == {("value", "not_null"): 1}
    assert failures(quality.check_prices(good.unionByName(good.limit(1)))) == {("valid_time", "unique"): 2}
    for bad in (10000.0, -1000.0):
        assert failures(quality.check_prices(good.withColumn("value", F.lit(bad)))) == {("value", "between"): 24}
    assert failures(quality.check_prices(good.drop("zone"))) == {("zone", "exists"): 1}
    assert failures(quality.check_prices(good.withColumn("zone", F.lit(None).cast("string")))) == {("zone", "not_null"): 24}


def test_weather_and_generation_suites(spark):
    w = frame(spark, hours(24, DAY), "temperature_2m double, wind_speed_10m double, shortwave_radiation double", [15.0] * 24, [5.0] * 24, [200.0] * 24)
    assert failures(quality.check_weather(w)) == {}
    for col, bad in (("temperature_2m", 75.0), ("temperature_2m", -70.0), ("wind_speed_10m", -1.0), ("shortwave_radiation", -1.0)):
        assert failures(quality.check_weather(w.withColumn(col, F.lit(bad)))) == {(col, "between"): 24}
    assert failures(quality.check_weather(w.drop("wind_speed_10m"))) == {("wind_speed_10m", "exists"): 1}
    g = frame(spark, hours(24, DAY), "`Wind Onshore` double, Solar double", [500.0] * 24, [100.0] * 24)
    assert failures(quality.check_generation(g)) == {}
    assert failures(quality.check_generation(g.withColumn("Solar", F.lit(-50.0)))) == {("Solar", "between"): 24}
    assert failures(quality.check_generation(g.select("valid_time", "zone"))) == {("*", "column_count"): 1}
    assert ("zone", "exists") in failures(quality.check_generation(g.drop("zone")))
    assert failures(quality.check_silver(g.selectExpr("valid_time", "zone", "Solar AS value_mw"), "silver_load")) == {}
