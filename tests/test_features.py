import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from helpers import START, ZONE, by, close, frame, hours, seeded_prices
from zonecast.functions.calendar import add_calendar, with_easter_offset, with_swedish_holiday
from zonecast.operators import features as X
from zonecast.operators.blocks import add_row_position, last_rows
from zonecast.operators.exchange import columns_containing, fuel_totals, net_exchange


def brute_features(prices, zone, first, last):
    """Row-by-row rolling features on the dense axis."""
    axis = [first + dt.timedelta(hours=i) for i in range(int((last - first).total_seconds() // 3600) + 1)]
    p = [prices.get((zone, t)) for t in axis]
    out = {}
    for i, t in enumerate(axis):
        row = {f"price_lag{h}h": p[i - h] if i >= h else None for h in X.LAGS}

        def window(n):
            return [v for v in p[max(0, i - 24 - n + 1): max(0, i - 24 + 1)] if v is not None]

        for n, name in ((24, "price_roll24h"), (168, "price_roll168h")):
            row[name] = statistics.fmean(window(n)) if window(n) else None
        for n in (168, 720):
            row[f"price_roll{n}h_std"] = statistics.stdev(window(n)) if len(window(n)) > 1 else None
        out[t] = row
    return out


@pytest.mark.parametrize("block_hours", [X.DEFAULT_BLOCK_HOURS, 800, 100])
def test_lags_and_rolling_match_brute_force_for_any_block_size(spark, block_hours):
    df, prices = seeded_prices(spark, 1000, zones=("a", "b"), drop=0.1)
    got = by(X.price_features(df, block_hours=block_hours), "zone", "valid_time")
    for zone in ("a", "b"):
        times = sorted(t for z, t in prices if z == zone)
        want = brute_features(prices, zone, times[0], times[-1])
        assert len([k for k in got if k[0] == zone]) == len(want)
        for t, row in want.items():
            for name, value in row.items():
                assert close(got[(zone, t)][name], value, 1e-8), (zone, t, name)


def test_constant_price_has_zero_deviation(spark):
    df = frame(spark, hours(300), "price double", [50.0] * 300)
    rows = X.price_features(df).orderBy("valid_time").collect()
    assert rows[-1]["price_roll168h_std"] == 0.0 and rows[-1]["price_roll24h"] == 50.0
    assert rows[24]["price_roll168h_std"] is None and rows[24]["price_roll24h"] == 50.0


def test_reindex_fills_gaps_and_respects_bounds(spark):
    df = frame(spark, [START, START + dt.timedelta(hours=5)], "price double", [1.0, 2.0])
    rows = X.reindex_hourly(df, ["price"], START, START + dt.timedelta(hours=5), df.select("zone").distinct()).collect()
    assert len(rows) == 5 and sum(r["price"] is not None for r in rows) == 1


def full_sources(spark, n=400, start=START):
    t = hours(n, start)
    price, _ = seeded_prices(spark, n, start=start)
    weather = frame(spark, t[: n - 24], "temperature double, wind_speed double, irradiance double",
                    [5.0] * (n - 24), [3.0] * (n - 24), [100.0] * (n - 24))
    gen = frame(spark, t[:24], "wind_mw double, solar_mw double", [500.0] * 24, [100.0] * 24)
    load = frame(spark, t[:24], "value_mw double", [12000.0] * 24)
    flows = spark.createDataFrame([(t[0], ZONE, "x", 30.0), (t[0], "x", ZONE, 100.0), (t[1], ZONE, "x", 7.0)],
                                  "valid_time timestamp, from_zone string, to_zone string, value_mw double")
    zones = spark.createDataFrame([(ZONE,)], "zone string")
    return price, weather, gen, load, flows, zones, t


def test_matrix_shape_order_and_values(spark):
    price, weather, gen, load, flows, zones, t = full_sources(spark)
    m = X.build_features(price, weather, gen, load, flows, t[0], t[-1] + dt.timedelta(hours=1), zones)
    assert m.columns[:3] == ["valid_time", "zone", "price"] and len(m.columns) == 37
    rows = by(m, "valid_time")
    assert len(rows) == 400
    assert rows[(t[0],)]["net_exchange_mw"] == 70.0 and rows[(t[1],)]["net_exchange_mw"] == -7.0
    assert rows[(t[2],)]["net_exchange_mw"] is None and rows[(t[30],)]["load_mw"] is None
    last = rows[(t[-1],)]
    assert last["temperature"] == 5.0 and last["temp_x_wind"] == 15.0  # carried over the forecast horizon
    assert last["temp_x_hour"] == 5.0 * t[-1].hour


def test_matrix_without_silver_sources(spark):
    price, *_ , zones, t = full_sources(spark, 48)
    m = X.build_features(price, start=t[0], end=t[-1] + dt.timedelta(hours=1), zones=zones)
    row = m.orderBy("valid_time").first()
    assert m.count() == 48 and row["wind_mw"] is None and row["temperature"] is None


def test_forward_fill_crosses_many_blocks(spark):
    n = 400
    t = hours(n)
    price, _ = seeded_prices(spark, n)
    weather = frame(spark, t[:1], "temperature double, wind_speed double, irradiance double", [1.0], [2.0], [3.0])
    m = X.build_features(price, weather, start=t[0], end=t[-1] + dt.timedelta(hours=1),
                         zones=price.select("zone").distinct(), block_hours=24)
    assert m.where("temperature = 1 AND wind_speed = 2 AND irradiance = 3").count() == n
    dense = X.reindex_hourly(price.withColumn("temperature", F.when(F.col("valid_time") == F.lit(t[3]), 9.0)), ["temperature"])
    filled = X.forward_fill(dense, ["temperature"], block_hours=24)
    assert filled.where("temperature = 9").count() == n - 3


def test_warmup_fills_first_lags_and_gate_safe_nulls_hour_23(spark):
    price, *_ , zones, t = full_sources(spark, 800)
    start, end = t[760], t[799] + dt.timedelta(hours=1)
    cold = X.build_features(price, start=start, end=end, zones=zones)
    warm = X.build_features(price, start=start, end=end, zones=zones, warmup_hours=744, gate_safe=True)
    assert cold.where("price_lag336h IS NOT NULL").count() == 0
    assert warm.count() == 40 and warm.where("price_lag336h IS NULL").count() == 0
    assert warm.where("hour = 23 AND price_lag23h IS NOT NULL").count() == 0
    assert warm.where("hour <> 23 AND price_lag23h IS NULL").count() == 0


def test_delivery_day_needs_exactly_24_rows(spark):
    price, *_ , zones, t = full_sources(spark, 800)
    day = t[799].date() - dt.timedelta(days=1)
    assert X.inference_features(price, day, zones).count() == 24
    m = X.build_features(price, start=t[0], end=t[790], zones=zones)
    with pytest.raises(Exception, match="Expected 24"):
        X.delivery_day(m, t[790].date()).collect()
    with pytest.raises(ValueError, match="No feature data"):
        X.require_day(m, dt.date(2030, 1, 1))


def easter(y):
    a, b, c = y % 19, y // 100, y % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    return dt.date(y, (h + m - 7 * n + 114) // 31, (h + m - 7 * n + 114) % 31 + 1)


def test_easter_and_holidays(spark):
    days = spark.sql("SELECT explode(sequence(timestamp'1900-01-01', timestamp'2100-12-31', interval 1 day)) AS valid_time")
    found = with_easter_offset(days).where("from_easter = 0").select(F.to_date("valid_time").alias("d")).collect()
    assert {r.d for r in found} == {easter(y) for y in range(1900, 2101)}
    marked = with_swedish_holiday(days).where("is_holiday = 1 AND year(valid_time) = 2026")
    assert {str(r.valid_time.date()) for r in marked.collect()} == {
        "2026-01-01", "2026-01-06", "2026-04-03", "2026-04-05", "2026-04-06", "2026-05-01", "2026-05-14", "2026-05-24",
        "2026-06-06", "2026-06-19", "2026-06-20", "2026-10-31", "2026-12-24", "2026-12-25", "2026-12-26", "2026-12-31"}
    plain = with_swedish_holiday(days, include_eves=False).where("is_holiday = 1 AND year(valid_time) = 2026")
    assert plain.count() == 13


def test_calendar_values(spark):
    rows = add_calendar(frame(spark, hours(24 * 14), "price double", [1.0] * 24 * 14)).collect()
    for r in rows:
        t = r["valid_time"]
        assert r["hour"] == t.hour and r["weekday"] == t.weekday() and r["month"] == t.month
        assert r["is_weekend"] == int(t.weekday() >= 5) and r["hour_of_week"] == t.weekday() * 24 + t.hour
        assert close(r["hour_sin"], math.sin(2 * math.pi * t.hour / 24)) and close(r["month_cos"], math.cos(2 * math.pi * (t.month - 1) / 12))
        assert r["hour_x_month"] == t.hour * t.month and close(r["weekend_x_hour"], r["is_weekend"] * r["hour_sin"])


def test_row_positions_over_small_blocks(spark):
    df, prices = seeded_prices(spark, 500, zones=("a", "b"), drop=0.2)
    for zone in ("a", "b"):
        want = {t: i + 1 for i, t in enumerate(sorted(t for z, t in prices if z == zone))}
        got = by(add_row_position(df, ["zone"], "valid_time", block_hours=48).where(F.col("zone") == zone), "valid_time")
        assert {k[0]: r["_pos"] for k, r in got.items()} == want and all(r["_n"] == len(want) for r in got.values())
    assert last_rows(df, ["zone"], "valid_time", 30, block_hours=48).count() == 60


def test_net_exchange_and_fuel_totals(spark):
    flows = spark.createDataFrame([(START, "a", "b", 5.0), (START, "b", "a", 2.0), (START, "a", "c", None)],
                                  "valid_time timestamp, from_zone string, to_zone string, value_mw double")
    got = by(net_exchange(flows), "zone")
    assert got[("a",)]["net_exchange_mw"] == -3.0 and got[("b",)]["net_exchange_mw"] == 3.0
    assert got[("c",)]["net_exchange_mw"] is None
    wide = spark.createDataFrame([(START, 1.0, 2.0, None, "z"), (START, None, None, None, "y")],
                                 "valid_time timestamp, `Wind Onshore` double, `Wind.Offshore` double, Solar double, zone string")
    assert columns_containing(wide, "WIND") == ["Wind Onshore", "Wind.Offshore"]
    rows = by(fuel_totals(wide), "zone")
    assert rows[("z",)]["wind_mw"] == 3.0 and rows[("z",)]["solar_mw"] == 0.0 and rows[("y",)]["total_mw"] == 0.0
