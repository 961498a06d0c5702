"""Contribution summaries: a bounded row sample, permutation Shapley values, top-k tables."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 200
TOP = 15


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 0, keys: Sequence[str] = ("zone", "valid_time")) -> DataFrame:
    """Deterministic sample of at most ``n`` rows: the smallest seeded key hashes (a distributed top-n)."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def shapley_values(
    sample: DataFrame,
    features: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    permutations: int = 8,
    seed: int = 0,
    keys: Sequence[str] = ("zone", "valid_time"),
    score_col: str = "score",
) -> DataFrame:
    """Contributions ``keys, feature, phi, base`` relative to the sample's mean row.

    Every sampled row is expanded to ``permutations * (features + 1)`` mixed rows which are scored as one Spark job;
    for each row the contributions add up to ``score(row) - base`` exactly.
    """
    f, k = list(features), list(keys)
    rng = random.Random(seed)
    orders = [rng.sample(range(len(f)), len(f)) for _ in range(permutations)]
    place = [[order.index(j) for order in orders] for j in range(len(f))]

    means = sample.agg(*[F.avg(c).alias(f"_b_{c}") for c in f]).withColumn("_one", F.lit(1))
    rows = sample.select(*k, *f).withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one").drop("_one")
    mixed = rows.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn(
        "_step", F.explode(F.sequence(F.lit(0), F.lit(len(f))))
    )

    def at(values, index="_perm"):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(index) + 1)

    mixed = mixed.select(
        *k, "_perm", "_step",
        *[F.when(at(place[j]) < F.col("_step"), F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c) for j, c in enumerate(f)],
    )
    scored = score(mixed).select(*k, "_perm", "_step", F.col(score_col).alias("_s"))
    # one group holds features + 1 rows
    w = Window.partitionBy(*k, "_perm").orderBy("_step")
    names = F.array(*[F.array(*[F.lit(f[j]) for j in order]) for order in orders])
    steps = scored.withColumn("_d", F.col("_s") - F.lag("_s").over(w)).withColumn("_s0", F.first("_s").over(w))
    added = F.element_at(F.element_at(names, F.col("_perm") + 1), F.col("_step"))
    return (
        steps.where(F.col("_step") > 0)
        .select(*k, added.alias("feature"), "_d", "_s0")
        .groupBy(*k, "feature")
        .agg(F.avg("_d").alias("phi"), F.avg("_s0").alias("base"))
    )


def contribution_summary(contributions: DataFrame, top: int = TOP) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return (
        contributions.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
        .orderBy(F.desc("mean_abs"), "feature").limit(top)
    )


def row_breakdown(contributions: DataFrame, zone: str, valid_time, top: int = TOP) -> DataFrame:
    """Signed contributions of one row, largest magnitude first."""
    one = contributions.where((F.col("zone") == zone) & (F.col("valid_time") == F.lit(valid_time)))
    return one.select("feature", "phi").orderBy(F.desc(F.abs("phi")), "feature").limit(top)
