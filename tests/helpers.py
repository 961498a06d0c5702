"""Fixtures as DataFrames and row access."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

ZONE = "10Y1001A1001A46L"
START = dt.datetime(2026, 1, 1)


def hours(n, start=START):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def frame(spark, times, schema, *cols, zone=ZONE):
    """Rows (zone, valid_time, *values)."""
    rows = [(zone, t, *vals) for t, *vals in zip(times, *cols)]
    return spark.createDataFrame(rows, "zone string, valid_time timestamp, " + schema)


def seeded_prices(spark, n=400, seed=42, start=START, zones=(ZONE,), drop=0.0, low=20, high=200):
    """Hourly prices, uniform, optionally with gaps; returns the frame and {(zone, time): price}."""
    rng = random.Random(seed)
    rows = [(z, t, rng.uniform(low, high)) for z in zones for t in hours(n, start)]
    rows = [r for r in rows if rng.random() >= drop]
    df = spark.createDataFrame(rows, "zone string, valid_time timestamp, price double")
    return df, {(z, t): p for z, t, p in rows}


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def scored(spark, rows, schema="zone string, valid_time timestamp, y double, q05 double, q50 double, q95 double"):
    return spark.createDataFrame(rows, schema)


def synthetic_matrix(spark, n=1500, seed=7, zones=("a", "b")):
    """All model features as noise (calendar columns real), price = 50 + 10 hour_sin + 5 temperature + noise."""
    from zonecast.functions.calendar import CALENDAR_COLS, add_calendar
    from zonecast.operators.features import MODEL_FEATURES

    other = [c for c in MODEL_FEATURES if c not in CALENDAR_COLS]
    base = spark.createDataFrame([(z, t) for z in zones for t in hours(n, dt.datetime(2025, 1, 1))],
                                 "zone string, valid_time timestamp")
    df = add_calendar(base)
    df = df.select("*", *[F.randn(seed + i).alias(c) for i, c in enumerate(other)])
    noise = F.randn(seed + 99) * 3
    out = df.withColumn("price", 50 + 10 * F.col("hour_sin") + 5 * F.col("temperature") + noise)
    return out.persist()
