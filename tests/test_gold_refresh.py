"""Incremental gold against full rebuilds."""

import datetime as dt
import pathlib
import random

import pytest

from tests.helpers import by, close
from zonecast.operators.features import build_features
from zonecast.sources import gold, gold_refresh
from zonecast.sources import bitemporal as B

FIRST, DAYS = dt.datetime(2023, 1, 10), 330
H = dt.timedelta(hours=1)
COLS = {"price": ["price"], "weather": ["temperature", "wind_speed", "irradiance"], "generation": ["wind_mw", "solar_mw"],
        "load": ["load_mw"]}


def at(month, day, hour=0):
    return dt.datetime(2023, month, day, hour)


def world():
    """Hours of two zones by source; the weather of zone a is silent from 20 March to 5 June."""
    rng, out = random.Random(11), {}
    for name, cols in COLS.items():
        rows = {}
        for z in "ab":
            for i in range(DAYS * 24):
                t = FIRST + i * H
                silent = name == "weather" and z == "a" and at(3, 20) <= t < at(6, 5)
                if rng.random() < {"price": 0.9, "weather": 0.3}.get(name, 0.8) and not silent:
                    rows[z, t] = tuple(None if name == "weather" and rng.random() < 0.2 else rng.uniform(1, 90) for _ in cols)
        out[name] = rows
    out["weather"]["a", FIRST - 30 * H] = (1.0, 2.0, 3.0)  # older than the axis
    out["flows"] = {("a", "b", FIRST + i * H): (float(i % 50),) for i in range(0, DAYS * 24, 3)}
    return out


def frames(spark, data):
    out = {n: spark.createDataFrame([(*k, *v) for k, v in data[n].items()],
                                    "zone string, valid_time timestamp, " + ", ".join(f"{c} double" for c in cols))
           for n, cols in COLS.items()}
    out["flows"] = spark.createDataFrame([(*k, *v) for k, v in data["flows"].items()],
                                         "from_zone string, to_zone string, valid_time timestamp, value_mw double")
    return out


def files(path):
    return {p.relative_to(path).as_posix() for p in pathlib.Path(path).rglob("*.parquet")}


def folder(name):
    zone, year, month = name.split("/")[:3]
    return zone[5:], int(year[5:]) * 12 + int(month[9:]) - 1


def same(left, right):
    left, right = by(left, "zone", "valid_time"), by(right, "zone", "valid_time")
    assert left.keys() == right.keys()
    for k, a in left.items():
        b = right[k].asDict()
        for c, v in a.asDict().items():
            assert close(v, b[c], 1e-6) if isinstance(v, float) else v == b[c], (k, c, v, b[c])


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    data, path = world(), str(tmp_path_factory.mktemp("gold") / "gold")
    now = frames(spark, data)
    done = gold_refresh.refresh_gold(spark, path, {"price": now["price"]}, first_build=True, **now)
    assert done.count() == 2 * 12
    same(gold.read_gold(spark, path), build_features(**now))
    return data, path


def refreshed(spark, built, edits):
    """Apply edits ``source -> {key: values}`` and refresh; the folders replaced, by file names."""
    data, path = built
    held = files(path)
    for name, rows in edits.items():
        data[name].update(rows)
    now = frames(spark, data)
    changed = {}
    for n in edits:
        keys = [(z, k[-1]) for k in edits[n] for z in k[:-1]]
        changed[n] = spark.createDataFrame(keys, "zone string, valid_time timestamp")
    done = gold_refresh.refresh_gold(spark, path, changed, **now)
    same(gold.read_gold(spark, path), build_features(**now))
    replaced = {folder(f) for f in held ^ files(path)}
    assert replaced == {(r["zone"], r["_month"]) for r in done.collect()}
    return sorted((z, m % 12 + 1) for z, m in replaced)


def test_no_change_writes_nothing(spark, built):
    assert refreshed(spark, built, {"price": {}}) == []


def test_a_late_price_reaches_744_hours(spark, built):
    got = refreshed(spark, built, {"price": {("a", at(2, 10, 5)): (500.0,), ("b", at(7, 31, 23)): (-3.0,)}})
    assert got == [("a", 2), ("a", 3), ("b", 7), ("b", 8)]


def test_weather_is_carried_through_silent_months(spark, built):
    got = refreshed(spark, built, {"weather": {("a", at(3, 19, 23)): (77.0, 78.0, 79.0)}})
    assert got == [("a", 3), ("a", 4), ("a", 5), ("a", 6)]


def test_weather_before_the_axis(spark, built):
    got = refreshed(spark, built, {"weather": {("b", FIRST - 50 * H): (5.0, 6.0, 7.0)}})
    assert got == [("b", 1)]


def test_flows_change_both_zones_and_only_their_months(spark, built):
    got = refreshed(spark, built, {"flows": {("a", "b", at(9, 1, 0)): (1234.0,)}, "load": {("b", at(2, 1)): (7.0,)}})
    assert got == [("a", 9), ("b", 2), ("b", 9)]


def test_the_axis_grows_at_both_ends_and_by_new_zones(spark, built):
    end = FIRST + DAYS * 24 * H
    got = refreshed(spark, built, {"price": {("a", end + 40 * 24 * H): (5.0,), ("b", at(1, 1) - 3 * H): (6.0,), ("c", at(5, 5)): (1.0,)}})
    assert ("c", 5) in got and ("a", 12) in got and ("b", 12) in got and ("b", 1) in got
    assert not {("a", m) for m in range(2, 12)} & set(got) and not {("b", m) for m in range(3, 12)} & set(got)


def test_changed_hours_of_versions(spark):
    rows = [("z", 21, at(1, 1), 1.0, at(1, 1), "forever"), ("z", 21, at(1, 2), 1.0, at(1, 2), "forever"), ("z", 22, at(1, 2), 1.0, at(1, 3), "forever")]
    v = spark.createDataFrame(rows, B.SCHEMA)
    assert [r["valid_time"] for r in gold_refresh.changed_since(v, at(1, 1)).collect()] == [at(1, 2)]
    flows = spark.createDataFrame([("a", "b", at(1, 1), 1.0)], "from_zone string, to_zone string, valid_time timestamp, value_mw double")
    assert {r["zone"] for r in gold_refresh.changed_ends(flows).collect()} == {"a", "b"}
