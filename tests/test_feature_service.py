"""Several views with their own times and lifetimes, resolved in one pass, against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.helpers import START
from zonecast.operators import pit


def brute(entities, rows, ttl):
    """Per entity the largest value of the newest row not older than ``ttl``; rows are (zone, time, value)."""
    out = {}
    for i, z, t in entities:
        known = [(ft, v) for fz, ft, v in rows if z is not None and t is not None and fz == z and ft <= t]
        ft, v = max(known) if known else (None, None)
        out[i] = v if known and t - ft <= dt.timedelta(hours=ttl) else None
    return out


def test_views_against_brute_force(spark):
    rng = random.Random(5)
    minutes = lambda n: START + dt.timedelta(minutes=n)
    span = 500 * 60
    views = {"x": ([(rng.choice("ab"), minutes(rng.randrange(span)), rng.random()) for _ in range(150)], 30),
             "y": ([("a", minutes(60 * h), float(h)) for h in range(0, 500, 2)], 0.5),
             "w": ([("b", minutes(7), 3.0)], 24 * 365)}  # one old row, carried over many blocks
    views["x"][0].extend([(z, t, 2.0 + v) for z, t, v in views["x"][0][:20]])  # equal times: the larger row
    ents = [(i, rng.choice("abc"), minutes(rng.randrange(-600, span + 600))) for i in range(400)]
    ents += [(1000 + i, z, t) for i, (z, t, _) in enumerate(views["x"][0][:30])]  # the very time of a row
    ents += [(2000 + i, "a", minutes(30)) for i in range(100)]  # one hot time, at the very end of y's lifetime
    ents += [(3000, None, minutes(5)), (3001, "a", None)]
    e = spark.createDataFrame(ents, "id int, zone string, valid_time timestamp")
    frames = [pit.View(spark.createDataFrame([*rows, ("a", None, 99.0)], f"zone string, known timestamp, {c} double"), [c], ttl, "known")
              for c, (rows, ttl) in views.items()]
    for hours in (24, 168):
        got = pit.service_join(e, frames, block_hours=hours).collect()
        assert len(got) == len(ents)
        for c, (rows, ttl) in views.items():
            assert {r["id"]: r[c] for r in got} == brute(ents, rows, ttl)


def test_one_shuffle_of_the_stack_whatever_the_number_of_views(spark):
    rows = spark.range(100).selectExpr("'a' AS zone", "timestamp_seconds(id * 3600) AS valid_time", "id AS x", "id AS y", "id AS z")
    e = rows.select("zone", "valid_time", F.lit(1.0).alias("price"))

    def exchanges(n):
        joined = pit.service_join(e, [pit.View(rows, [c]) for c in "xyz"[:n]])
        return joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(1) == exchanges(3)


def test_an_empty_view_gives_nulls(spark):
    rows = spark.range(3).selectExpr("'a' AS zone", "timestamp_seconds(id * 3600) AS valid_time", "id AS x")
    got = pit.service_join(rows.drop("x"), [pit.View(rows.where("false"), ["x"]), pit.View(rows.withColumnRenamed("x", "y"), ["y"])])
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(None, 0), (None, 1), (None, 2)]
