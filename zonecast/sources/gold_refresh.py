"""Incremental gold: only the months that new versions can reach are computed again.

A changed price reaches the lags and rolling frames of the 744 hours after it, a changed weather value is carried
forward until the weather is observed again, other sources count in their own hour. The months touched in this way are rebuilt for their zones alone, each run
of adjoining months on an axis of its own that starts 744 hours earlier, and replace their folders; all other files stay.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.operators.exchange import net_exchange
from zonecast.operators.features import LONGEST_FRAME, WEATHER_COLS, build_features
from zonecast.session import materialize
from zonecast.sources.gold import write_gold

MONTH = "_month"


def changed_since(versions: DataFrame, known: dt.datetime | Column) -> DataFrame:
    """Hours with a version that became known after ``known``."""
    known = known if isinstance(known, Column) else F.lit(known)
    return versions.where(F.col("knowledge_time") > known).select("zone", "valid_time").distinct()


def changed_ends(flows: DataFrame) -> DataFrame:
    """Hours of both zones of changed flows."""
    return flows.selectExpr("valid_time", "explode(array(from_zone, to_zone)) AS zone").select("zone", "valid_time").distinct()


def _month(time: str) -> Column:
    return F.expr(f"year({time}) * 12 + month({time}) - 1")


def _month_start(month: str) -> Column:
    return F.expr(f"make_timestamp(CAST(({month}) div 12 AS INT), ({month}) % 12 + 1, 1, 0, 0, 0)")


def _axis(gold: DataFrame | None, price_changes: DataFrame) -> DataFrame:
    """``zone, lo, hi`` (first and last hour) after the changes, and ``old_lo, old_hi`` as stored."""
    new = price_changes.groupBy("zone").agg(F.date_trunc("hour", F.min("valid_time")).alias("new_lo"), F.max("valid_time").alias("new_hi"))
    if gold is None:
        old = new.selectExpr("zone", "CAST(NULL AS TIMESTAMP) AS old_lo", "CAST(NULL AS TIMESTAMP) AS old_hi")
    else:
        old = gold.groupBy("zone").agg(F.min("valid_time").alias("old_lo"), F.max("valid_time").alias("old_hi"))
    both = old.join(new, "zone", "full")
    return both.selectExpr("zone", "least(old_lo, new_lo) AS lo", "greatest(old_hi, new_hi) AS hi", "old_lo", "old_hi")


def _reached_by_weather(changes: DataFrame, weather: DataFrame) -> DataFrame:
    """``zone, _month, _next``: changed months, and the one in which every weather column is observed after the change.

    That is the changed month itself, or the next month that observes all columns; null if there is none.
    """
    on_axis = F.date_trunc("hour", F.col("valid_time")) == F.col("valid_time")
    last = [F.max(F.when(F.col(c).isNotNull(), F.col("valid_time"))).alias(c) for c in WEATHER_COLS if c in weather.columns]
    observed = weather.where(on_axis).groupBy("zone", _month("valid_time").alias(MONTH)).agg(*last)
    cols = observed.columns[2:]
    whole = observed.na.drop("any", subset=cols).select("zone", MONTH, F.array_min(F.array(*cols)).alias("_seen"), F.col(MONTH).alias("_whole"))
    months = changes.groupBy("zone", _month("valid_time").alias(MONTH)).agg(F.max("valid_time").alias("_changed"))
    both = months.unionByName(whole, allowMissingColumns=True).groupBy("zone", MONTH).agg(
        *[F.max(c).alias(c) for c in ("_changed", "_seen", "_whole")]
    )
    later = Window.partitionBy("zone").orderBy(MONTH).rangeBetween(1, Window.unboundedFollowing)
    reach = both.withColumn("_next", F.when(F.col("_seen") > F.col("_changed"), F.col(MONTH)).otherwise(F.min("_whole").over(later)))
    return reach.where("_changed IS NOT NULL").select("zone", MONTH, "_next")


def dirty_months(axis: DataFrame, changed: dict[str, DataFrame], weather: DataFrame | None = None) -> DataFrame:
    """``zone, _month`` to compute again: reached by a change, or new on the axis (also hours between old and new ends).

    A changed price reaches 744 hours, weather as far as it is carried, anything else its own hour.
    """
    spans = [axis.where("false").select("zone", F.lit(0).alias("_a"), F.lit(0).alias("_b"))]
    for name, rows in changed.items():
        if name == "weather" and weather is not None:
            spans.append(_reached_by_weather(rows, weather).select("zone", F.col(MONTH).alias("_a"), F.col("_next").alias("_b")))
        else:
            after = f"valid_time + INTERVAL {LONGEST_FRAME if name == 'price' else 0} HOURS"
            spans.append(rows.select("zone", _month("valid_time").alias("_a"), _month(after).alias("_b")).distinct())
    grown = axis.where("old_lo IS NULL OR lo < old_lo OR hi > old_hi")
    spans.append(grown.where("old_lo IS NULL").select("zone", _month("lo").alias("_a"), _month("hi").alias("_b")))
    spans.append(grown.where("lo < old_lo").select("zone", _month("lo").alias("_a"), _month("old_lo").alias("_b")))
    spans.append(grown.where("hi > old_hi").select("zone", _month("old_hi").alias("_a"), _month("hi").alias("_b")))
    all_spans = spans[0]
    for s in spans[1:]:
        all_spans = all_spans.unionByName(s)
    ends = axis.select("zone", _month("lo").alias("_lo"), _month("hi").alias("_hi"))
    inside = all_spans.join(ends, "zone").selectExpr("zone", "greatest(_a, _lo) AS a", "least(coalesce(_b, _hi), _hi) AS b")
    return inside.where("a <= b").select("zone", F.explode(F.sequence("a", "b")).alias(MONTH)).distinct()


def _windows(axis: DataFrame, dirty: DataFrame) -> DataFrame:
    """Runs of adjoining months: ``_start`` to ``_end``, read from ``_reach`` on; ``_key`` names the run's axis."""
    place = F.row_number().over(Window.partitionBy("zone").orderBy(MONTH))
    runs = dirty.withColumn("_run", F.col(MONTH) - place).groupBy("zone", "_run").agg(F.min(MONTH).alias("_a"), F.max(MONTH).alias("_b"))
    named = runs.select("zone", F.concat_ws("#", "zone", "_a").alias("_key"), _month_start("_a").alias("_start"),
                        _month_start("_b + 1").alias("_end"))
    reach = F.expr(f"_start - INTERVAL {LONGEST_FRAME} HOURS")
    return named.withColumn("_reach", reach).join(axis.select("zone", "lo", "hi"), "zone")


def refresh_gold(spark: SparkSession, path: str, changed: dict[str, DataFrame], price: DataFrame, weather: DataFrame | None = None,
                 generation: DataFrame | None = None, load: DataFrame | None = None, flows: DataFrame | None = None,
                 first_build: bool = False, **options) -> DataFrame:
    """Bring the gold table at ``path`` up to date; returns the ``zone, _month`` that were replaced.

    The sources are those of ``build_features`` as they are now; ``changed`` names for each changed source the hours
    ``zone, valid_time`` that differ from the last build (``changed_since``, ``changed_ends``). Afterwards the table
    equals a full rebuild. Without any change nothing is written.
    """
    gold = None if first_build else spark.read.parquet(path).withColumn("zone", F.col("zone").cast("string"))
    prices = changed["price"] if "price" in changed else spark.createDataFrame([], "zone string, valid_time timestamp")
    axis = materialize(_axis(gold, prices))
    dirty = materialize(dirty_months(axis, changed, weather))
    limits = materialize(_windows(axis, dirty))
    span = limits.agg(F.min("_reach").alias("lo"), F.max("_end").alias("hi")).first()
    if span.lo is None:
        return dirty

    months = limits.select("zone", "_key", "_reach", "_end", F.explode(
        F.sequence(_month("_reach"), _month("_end - INTERVAL 1 SECOND"))).alias(MONTH))

    def read(df: DataFrame, *cols: str) -> DataFrame:
        # the bounds of all runs prune the scan, the months of each run pick its rows
        near = df.where((F.col("valid_time") >= F.lit(span.lo)) & (F.col("valid_time") < F.lit(span.hi)))
        rows = near.withColumn(MONTH, _month("valid_time")).join(months, ["zone", MONTH])
        rows = rows.where("valid_time >= _reach AND valid_time < _end")
        return rows.select(F.col("_key").alias("zone"), "valid_time", *cols)

    sources = {"price": read(price, "price")}
    if weather is not None:
        cols = [c for c in WEATHER_COLS if c in weather.columns]
        # a run at the head of an axis carries weather from before it, any other from the clean row before the run
        head = weather.join(limits.where("_start <= lo").select("zone", "_key", "_reach"), "zone").where("valid_time < _reach")
        sources["weather"] = read(weather, *cols).unionByName(head.select(F.col("_key").alias("zone"), "valid_time", *cols))
        if gold is not None:
            before = limits.selectExpr("zone", "_key", "_start - INTERVAL 1 HOUR AS valid_time", "year(_start - INTERVAL 1 HOUR) AS year",
                                       "month(_start - INTERVAL 1 HOUR) AS month_no")
            carried = gold.join(before, ["zone", "year", "month_no", "valid_time"]).select(F.col("_key").alias("zone"), "valid_time", *cols)
            both = sources["weather"].unionByName(carried)
            sources["weather"] = both.groupBy("zone", "valid_time").agg(*[F.max(c).alias(c) for c in cols])
    if generation is not None:
        sources["generation"] = read(generation, "wind_mw", "solar_mw")
    if load is not None:
        sources["load"] = read(load, "load_mw" if "load_mw" in load.columns else "value_mw")
    if flows is not None:
        near = flows.where((F.col("valid_time") >= F.lit(span.lo)) & (F.col("valid_time") < F.lit(span.hi)))
        sources["flows"] = read(net_exchange(near), "net_exchange_mw")

    axes = limits.selectExpr("_key AS zone", "greatest(lo, _reach) AS lo", "least(hi + INTERVAL 1 HOUR, _end) AS hi")
    matrix = build_features(**sources, bounds=axes, **options)
    of_run = limits.select(F.col("_key").alias("zone"), F.col("zone").alias("_zone"), "_start")
    rebuilt = matrix.join(of_run, "zone").where("valid_time >= _start").withColumn("zone", F.col("_zone"))
    write_gold(rebuilt.select(*matrix.columns), path)
    return dirty
