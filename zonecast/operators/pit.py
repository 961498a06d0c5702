"""Point-in-time feature joins and latest feature rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.operators.blocks import BLOCK, block_of

TTL_HOURS = 30 * 24
BLOCK_HOURS = 7 * 24


def point_in_time_join(
    entities: DataFrame,
    features: DataFrame,
    feature_cols: Sequence[str],
    key: str = "zone",
    time: str = "valid_time",
    ttl_hours: int = TTL_HOURS,
    hourly_features: bool = False,
    block_hours: int = BLOCK_HOURS,
) -> DataFrame:
    """Each entity row with the newest feature row at or before its time and not older than the TTL.

    Distinct entity times (not entity rows) are stacked with the features and resolved by one ``last`` window per
    ``(key, block)``. Blocks are short; what crosses a border is one row per block, the newest feature before it.
    ``hourly_features`` states that feature times are whole hours; entity times then collapse to hours before the
    shuffle. Entity columns pass through.
    """
    ask = F.date_trunc("hour", F.col(time)) if hourly_features else F.col(time)
    asked = entities.withColumn("_ask", ask)
    times = asked.select(key, "_ask").where(F.col(key).isNotNull() & F.col("_ask").isNotNull()).distinct()
    row = F.struct(F.col(time).alias("_feature_time"), *feature_cols)
    block = block_of("_ask", block_hours).alias(BLOCK)
    given = features.select(key, F.col(time).alias("_ask"), row.alias("_f")).select("*", F.lit(0).alias("_who"), block)
    times = times.select("*", F.lit(1).alias("_who"), block)
    ends = given.groupBy(key, BLOCK).agg(F.max_by("_f", "_ask").alias("_f")).unionByName(
        times.select(key, BLOCK).distinct(), allowMissingColumns=True).groupBy(key, BLOCK).agg(
        F.first("_f", ignorenulls=True).alias("_f"))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_f", F.last("_f", ignorenulls=True).over(before)).withColumn("_who", F.lit(-1))
    stacked = given.unionByName(times, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # the carried row has no time and sorts first; a feature at the very same time is visible, so it sorts before it
    w = (
        Window.partitionBy(key, BLOCK)
        .orderBy("_ask", "_who")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    resolved = (
        stacked.withColumn("_f", F.last("_f", ignorenulls=True).over(w))
        .where(F.col("_who") == 1)
        .select(key, "_ask", "_f")
    )
    fresh = F.unix_micros(F.col(time)) - F.unix_micros(F.col("_f._feature_time")) <= ttl_hours * 3600 * 1000000
    out = asked.join(resolved, [key, "_ask"], "left")
    return out.select(*entities.columns, *[F.when(fresh, F.col(f"_f.{c}")).alias(c) for c in feature_cols])


@dataclass
class View:
    """Feature rows ``key, time, *cols`` that an entity may read up to ``ttl_hours`` after their time."""

    rows: DataFrame
    cols: Sequence[str]
    ttl_hours: float = TTL_HOURS
    time: str = "valid_time"


def service_join(entities: DataFrame, views: Sequence[View], key: str = "zone", time: str = "valid_time",
                 block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Each entity row with the newest row of every view at or before its time, each within the view's own TTL.

    All views and the distinct entity times are stacked, shuffled once by ``(key, block)`` and resolved by one window
    that keeps a struct per view; a block begins with one carried row that holds the newest struct of every view. So
    the work is that of one join, however many views there are. Of rows with equal times the largest counts (by the
    view's columns in order). Entities without a key or time get nulls.
    """
    states = [f"_f{i}" for i in range(len(views))]
    times = entities.select(key, F.col(time).alias("_ask")).where(F.col(key).isNotNull() & F.col("_ask").isNotNull()).distinct()
    stacked = times.withColumn("_who", F.lit(1))
    for f, v in zip(states, views):
        row = F.struct(F.col(v.time).alias("_feature_time"), *v.cols).alias(f)
        stacked = stacked.unionByName(v.rows.select(key, F.col(v.time).alias("_ask"), row, F.lit(0).alias("_who")), allowMissingColumns=True)
    stacked = stacked.where(F.col("_ask").isNotNull()).withColumn(BLOCK, block_of("_ask", block_hours))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = stacked.groupBy(key, BLOCK).agg(*[F.max(f).alias(f) for f in states]).withColumns(
        {f: F.last(f, ignorenulls=True).over(before) for f in states} | {"_who": F.lit(-1)}
    )
    # the carried row has no time and sorts first; rows of a view at one time stand in their own order, the asking time last
    upto = Window.partitionBy(key, BLOCK).orderBy("_ask", "_who", *states).rowsBetween(Window.unboundedPreceding, 0)
    resolved = (
        stacked.unionByName(carried, allowMissingColumns=True)
        .withColumns({f"{f}_seen": F.last(f, ignorenulls=True).over(upto) for f in states})
        .where("_who = 1")
        .select(key, F.col("_ask").alias(time), *[F.col(f"{f}_seen").alias(f) for f in states])
    )
    out = entities.join(resolved, [key, time], "left")
    read = []
    for f, v in zip(states, views):
        age = F.unix_micros(F.col(time)) - F.unix_micros(F.col(f"{f}._feature_time"))
        read += [F.when(age <= int(v.ttl_hours * 3_600_000_000), F.col(f"{f}.`{c}`")).alias(c) for c in v.cols]
    return out.select(*entities.columns, *read)


def latest_rows(features: DataFrame, feature_cols: Sequence[str], key: str = "zone", time: str = "valid_time") -> DataFrame:
    """Newest feature row per key: one aggregation, combined on the map side."""
    newest = features.groupBy(key).agg(F.max(F.struct(time, *feature_cols)).alias("_r"))
    return newest.select(key, F.col(f"_r.{time}").alias(time), *[F.col(f"_r.{c}").alias(c) for c in feature_cols])


def online_features(requested: DataFrame, features: DataFrame, feature_cols: Sequence[str], key: str = "zone") -> DataFrame:
    """Newest features of every requested key; unknown keys get nulls."""
    wanted = features.join(requested.select(key).distinct(), key, "left_semi")
    return requested.select(key).join(latest_rows(wanted, feature_cols, key), key, "left")
