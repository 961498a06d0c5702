import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.operators import histboost, zoneboost

EXACT = zoneboost.BoostSettings(rounds=3, rate=0.5, depth=3, min_leaf=10, bins=64, row_share=1.0, column_share=1.0,
                                val_share=0.2, val_least=20, early_stop=2, half_life=200.0)
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for zone, n in (("x", 900), ("y", 150)):
        a, b, c = rng.integers(0, 5, n), rng.integers(0, 2, n), rng.integers(0, 9, n)
        y = 10.0 * a - 7 * b * (a > 2) + 0.3 * c + rng.normal(0, 2, n)
        out += [(zone, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v), float(p), float(q), float(r))
                for i, (v, p, q, r) in enumerate(zip(y, a, b, c))]
    return spark.createDataFrame(out, "zone string, valid_time timestamp, price double, a double, b double, c double").cache()


def keyed(df):
    return {(r["zone"], r["valid_time"]): r.asDict() for r in df.collect()}


def test_equals_boosting_with_each_zone_in_one_task(spark, rows):
    both = [m.fit(rows, EXACT, features=NAMES) for m in (histboost, zoneboost)]
    here, there = ({(r.zone, r.quantile): r for r in m.collect()} for m in both)
    assert set(here) == set(there) and len(here) == 6
    for k, r in here.items():
        assert r.rounds == there[k].rounds and r.base == there[k].base
        assert np.allclose(r.train_loss, there[k].train_loss) and np.allclose(r.val_loss, there[k].val_loss)
        assert np.allclose(r.gain, there[k].gain, atol=1e-6)
    scored = [keyed(zoneboost.predict(rows, m)) for m in both]
    for k, r in scored[0].items():
        for q in ("q05", "q50", "q95"):
            assert abs(r[f"lgbm_{q}"] - scored[1][k][f"lgbm_{q}"]) < 1e-9


def test_categories_give_the_same_target_means(spark, rows):
    data = rows.withColumn("hour", F.hour("valid_time"))
    s = replace(EXACT, rounds=1)
    here, there = (m.fit(data, s, features=["a"], prefix="cat", categories=["hour"]).collect() for m in (histboost, zoneboost))
    means = [{(r.zone, k["code"]): k["mean"] for r in found for k in r["codes"]} for found in (here, there)]
    assert means[0].keys() == means[1].keys()
    assert all(abs(v - means[1][k]) < 1e-9 for k, v in means[0].items())
    assert {r["zone"]: round(r["prior"], 9) for r in here} == {r["zone"]: round(r["prior"], 9) for r in there}
    assert here[0]["names"] == ["a", "hour_target"]


def test_drawn_rows_and_columns_repeat_and_fit(spark, rows):
    s = replace(EXACT, rounds=4, row_share=0.7, column_share=0.7, early_stop=4)
    once, again = (sorted(histboost.fit(rows, s, features=NAMES).collect(), key=lambda r: (r.zone, r.quantile)) for _ in range(2))
    assert [(r.value, r.cut) for r in once] == [(r.value, r.cut) for r in again]
    for r in once:
        assert min(r.train_loss) < r.train_loss[0] and len(set(np.array(r.feature)[np.array(r.child) >= 0])) > 1


def test_defined_results_at_the_edges(spark, rows, monkeypatch):
    assert histboost.fit(rows.limit(0), EXACT, features=NAMES).count() == 0
    assert zoneboost.predict(rows, histboost.fit(rows.limit(0), EXACT, features=NAMES)).where("lgbm_q50 IS NULL").count() == 1050
    with pytest.raises(Exception, match="leave none to fit"):
        histboost.fit(rows, replace(EXACT, val_least=150), features=NAMES).collect()
    odd = rows.unionByName(rows.limit(3).withColumn("zone", F.lit(None).cast("string"))).withColumn(
        "price", F.when(F.hour("valid_time") != 5, F.col("price"))).withColumn("_edges", F.lit("extra"))
    models = histboost.fit(odd, replace(EXACT, rounds=1), features=NAMES).persist()
    assert {r.zone for r in models.collect()} == {"x", "y"}
    hole = odd.withColumn("b", F.when(F.col("a") != 1, F.col("b")))
    whole = zoneboost.predict(hole, models)
    unscored = hole.where("zone IS NULL OR a = 1").count()
    assert whole.count() == 1053 and whole.where("lgbm_q50 IS NULL").count() == unscored
    monkeypatch.setattr(zoneboost, "MODEL_BYTES", 1)
    parts = zoneboost.predict(hole, models)
    assert keyed(parts) == keyed(whole)


def test_large_tables_of_trees_are_joined_by_shuffle(spark, rows, monkeypatch):
    s = replace(EXACT, rounds=1, depth=2)
    sent = histboost.fit(rows, s, features=NAMES).collect()
    monkeypatch.setattr(histboost, "TABLE_BYTES", 0)
    joined = histboost.fit(rows, s, features=NAMES).collect()
    # sums end in another order, so only losses and gains may differ, in their last digits
    sent, joined = (sorted(found, key=lambda r: (r.zone, r.quantile)) for found in (sent, joined))
    for r, o in zip(sent, joined, strict=True):
        assert (r.zone, r.quantile, r.feature, r.cut, r.child, r.value) == (o.zone, o.quantile, o.feature, o.cut, o.child, o.value)
        assert np.allclose(r.train_loss, o.train_loss, rtol=1e-12) and np.allclose(r.gain, o.gain, rtol=1e-9)
