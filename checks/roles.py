"""How the given tables play the library's inputs.

events    -> hourly prices (zone = event type), weather, load, generation, ring flows, bitemporal versions
orders    -> load by customer region and day, entity rows of the point-in-time join
lineitem  -> generation by fuel (day x line status), cross-border edges between regions
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import features as X
from zonecast.session import utc

RING = [("click", "error"), ("error", "purchase"), ("purchase", "signup"), ("signup", "view"), ("view", "click")]
FUELS = {"A": "Wind Onshore", "N": "Solar", "R": "Nuclear"}
MODELS = {"lgbm": "price_lag24h", "xgb": "price_roll24h", "cat": "price_lag48h", "lear": "price_lag168h"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> DataFrame:
    """Raw rows with their zone and hour."""
    return table(spark, sf, "events").selectExpr(
        "event_id", "event_type AS zone", "date_trunc('hour', CAST(ts AS TIMESTAMP)) AS valid_time",
        "CAST(ts AS TIMESTAMP) AS ts", "user_id", "value",
    )


def _hourly(ev: DataFrame, **named: str) -> DataFrame:
    return ev.groupBy("zone", "valid_time").agg(*[F.expr(e).alias(n) for n, e in named.items()])


def prices(spark, sf, ev: DataFrame | None = None) -> DataFrame:
    return _hourly(ev or events(spark, sf), price="avg(value)")


def weather(spark, sf, ev: DataFrame | None = None) -> DataFrame:
    """Sparse on purpose: hours with a single event have no weather."""
    return _hourly(ev or events(spark, sf), temperature="if(count(*) >= 2, min(value), NULL)",
                   wind_speed="if(count(*) >= 2, max(value), NULL)", irradiance="if(count(*) >= 2, avg(user_id), NULL)")


def generation_hourly(spark, sf, ev: DataFrame | None = None) -> DataFrame:
    return _hourly(ev or events(spark, sf), wind_mw="sum(least(value, 50D))", solar_mw="sum(greatest(value - 50D, 0D))")


def load_hourly(spark, sf, ev: DataFrame | None = None) -> DataFrame:
    return _hourly(ev or events(spark, sf), value_mw="sum(value)")


def ring_flows(spark, sf, ev: DataFrame | None = None) -> DataFrame:
    """Each event type exports to the next one in the ring."""
    to = "CASE zone " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RING) + " END"
    return (ev or events(spark, sf)).selectExpr("valid_time", "zone AS from_zone", f"{to} AS to_zone", "value AS value_mw")


def dense(spark, sf) -> DataFrame:
    return X.reindex_hourly(prices(spark, sf), ["price"])


def matrix(spark, sf, **options) -> DataFrame:
    ev = events(spark, sf)
    return X.build_features(
        prices(spark, sf, ev), weather(spark, sf, ev), generation_hourly(spark, sf, ev), load_hourly(spark, sf, ev),
        ring_flows(spark, sf, ev), **options,
    )


def filled_matrix(spark, sf) -> DataFrame:
    """The matrix on gap-filled prices, so that the lags models need are present on sparse data too."""
    ev = events(spark, sf)
    filled = X.forward_fill(X.reindex_hourly(prices(spark, sf, ev), ["price"]), ["price"])
    return X.build_features(filled, weather(spark, sf, ev))


def observed_matrix(spark, sf) -> DataFrame:
    """The matrix with lags from gap-filled prices and only observed prices as labels."""
    inputs = filled_matrix(spark, sf).drop("price")
    return inputs.join(prices(spark, sf), ["zone", "valid_time"], "left")


def forecasts_wide(spark, sf) -> DataFrame:
    """Naive forecasts of four models next to the actual, on the dense axis."""
    return X.price_features(prices(spark, sf))


def scored(spark, sf) -> DataFrame:
    """``zone, valid_time, model, y, q05, q50, q95``: median from a lag, band from the weekly deviation."""
    per_model = ", ".join(f"struct('{m}' AS model, {c} AS mid)" for m, c in MODELS.items())
    band = "1.645D * price_roll168h_std"
    return (
        forecasts_wide(spark, sf)
        .selectExpr("zone", "valid_time", "price", "price_roll168h_std", f"inline(array({per_model}))")
        .selectExpr("zone", "valid_time", "model", "price AS y", f"mid - {band} AS q05", "mid AS q50", f"mid + {band} AS q95")
    )


def scored_one(spark, sf, model: str = "lgbm") -> DataFrame:
    return scored(spark, sf).where(F.col("model") == model).drop("model")


def actuals(spark, sf) -> DataFrame:
    return prices(spark, sf).withColumnRenamed("price", "y")


def versions(spark, sf) -> DataFrame:
    """Every event is one version; knowledge time lies 0 to 72 hours before valid time."""
    known = F.timestamp_seconds(F.unix_seconds("valid_time") - F.pmod(F.col("event_id") * 7, F.lit(73)) * 3600)
    tier = F.when(F.col("value") < 20, "short").when(F.col("value") < 60, "medium").otherwise("forever")
    return events(spark, sf).select(
        "zone", (20 + F.pmod("event_id", F.lit(3))).cast("int").alias("series_id"), "valid_time",
        "value", known.alias("knowledge_time"), tier.alias("retention"),
    )


def fuel_long(spark, sf) -> DataFrame:
    """Long generation payload: day x line status, fuel from the return flag; some values are negative."""
    fuel = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in FUELS.items()])
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").cast("timestamp").alias("valid_time"), F.col("l_linestatus").alias("zone"),
                 fuel.alias("fuel"))
        .agg(F.sum(F.col("l_quantity") - 15).alias("value"))
        .withColumn("kind", F.lit("Actual Aggregated"))
    )


def region_load(spark, sf) -> DataFrame:
    """Daily load by customer region; quiet days come out negative."""
    region = _nation_region(spark, sf)
    customers = table(spark, sf, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "r_name"
    )
    return (
        table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderdate").cast("timestamp").alias("valid_time"), F.col("r_name").alias("zone"))
        .agg(F.sum(F.col("o_totalprice") - 150000).alias("value_mw"))
    )


def _nation_region(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")


def region_flows(spark, sf) -> DataFrame:
    """Order-day edges from supplier region to customer region, value = shipped quantity."""
    region = _nation_region(spark, sf)
    sup = table(spark, sf, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("r_name").alias("from_zone"))
    cus = table(spark, sf, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("r_name").alias("to_zone"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(
        cus, F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderdate").cast("timestamp").alias("valid_time"), "from_zone", "to_zone")
        .agg(F.sum("l_quantity").alias("value_mw"))
    )


def weather_payload(spark, sf) -> DataFrame:
    """One payload row per zone and day: time range, step and one array per variable (an entry per hour)."""
    hourly = X.reindex_hourly(weather(spark, sf), X.WEATHER_COLS)
    names = {"temperature": "temperature_2m", "wind_speed": "wind_speed_10m", "irradiance": "shortwave_radiation"}
    day = hourly.groupBy("zone", F.expr("date_trunc('day', valid_time)").alias("day")).agg(
        F.expr("array_sort(collect_list(struct(unix_seconds(valid_time) AS t, temperature, wind_speed, irradiance)))").alias("h")
    )
    return day.selectExpr("zone", "h[0].t AS start_s", "h[size(h) - 1].t + 3600 AS end_s", "CAST(3600 AS BIGINT) AS step_s",
                          *[f"h.{a} AS {b}" for a, b in names.items()])
