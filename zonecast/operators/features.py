"""Feature matrix over a dense hourly spine, all zones in one job.

All inputs meet in one tall frame (each source fills its own columns) that is shuffled once by ``(zone, block)``. The
dense axis, the n-way alignment, the forward fill and every lag and rolling frame are then computed inside those
blocks; no join is needed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions.calendar import CALENDAR_COLS, add_calendar
from zonecast.operators.blocks import (
    BLOCK,
    DEFAULT_BLOCK_HOURS,
    block_of,
    block_start,
    carried_last,
    is_core,
    with_halo,
)
from zonecast.operators.exchange import net_exchange

# --- fixed values: lags in hours, rolling frames, column lists ---
LAGS = [23, 24, 25, 48, 72, 168, 336]
ROLL_SHIFT = 24
LONGEST_FRAME = 744
HISTORY_HOURS = 750
LAG_COLS = [f"price_lag{h}h" for h in LAGS]
ROLL_COLS = ["price_roll24h", "price_roll168h", "price_roll168h_std", "price_roll720h_std"]
WEATHER_COLS = ["temperature", "wind_speed", "irradiance"]
INTERACTION_COLS = ["temp_x_wind", "temp_x_hour"]
GRID_COLS = ["wind_mw", "solar_mw", "load_mw", "net_exchange_mw"]
MATRIX_COLS = ["valid_time", "zone", "price", *LAG_COLS, *ROLL_COLS, *CALENDAR_COLS, *WEATHER_COLS,
               *INTERACTION_COLS, *GRID_COLS]
MODEL_FEATURES = [
    "price_lag24h", "price_lag48h", "price_lag168h", "price_lag72h", "price_lag336h", "price_lag23h", "price_lag25h",
    "price_roll24h", "price_roll168h", "hour", "weekday", "month", "is_weekend", "is_holiday", "hour_of_week",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos", "hour_x_month", "weekend_x_hour",
    "temperature", "wind_speed", "irradiance", "temp_x_wind", "temp_x_hour",
]
# --- end of fixed values ---


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def _between(df: DataFrame, start, end, time: str = "valid_time") -> DataFrame:
    if start is not None:
        df = df.where(F.col(time) >= _ts(start))
    return df if end is None else df.where(F.col(time) < _ts(end))


def zone_bounds(series: DataFrame, start=None, end=None, zones: DataFrame | None = None) -> DataFrame:
    """``zone, lo, hi`` of the dense axis ``[lo, hi)``: given bounds, else each zone's first to last hour."""
    if zones is None or start is None or end is None:
        per = series.groupBy("zone").agg(
            F.min("valid_time").alias("_lo"), F.expr("max(valid_time) + INTERVAL 1 HOUR").alias("_hi")
        )
        if zones is not None:
            per = zones.select("zone").join(per, "zone", "left")
    else:
        per = zones.selectExpr("zone", "CAST(NULL AS TIMESTAMP) AS _lo", "CAST(NULL AS TIMESTAMP) AS _hi")
    lo = F.col("_lo") if start is None else _ts(start)
    hi = F.col("_hi") if end is None else _ts(end)
    return per.select("zone", F.date_trunc("hour", lo).alias("lo"), hi.alias("hi"))


def zone_blocks(bounds: DataFrame, block_hours: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """The blocks each zone's axis touches."""
    last = block_of("hi - INTERVAL 1 SECOND", block_hours)
    return bounds.where("lo < hi").select(
        "zone", "lo", "hi", F.explode(F.sequence(block_of("lo", block_hours), last)).alias(BLOCK)
    )


def hourly_spine(bounds: DataFrame, block_hours: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Dense ``zone, valid_time``; expanded block by block so no single row explodes into a whole history."""
    size = block_hours * 3600
    first = f"greatest(lo, timestamp_seconds({BLOCK} * {size}))"
    last = f"least(hi, timestamp_seconds(({BLOCK} + 1) * {size})) - INTERVAL 1 SECOND"
    hours = f"explode(sequence({first}, {last}, INTERVAL 1 HOUR))"
    return zone_blocks(bounds, block_hours).select("zone", F.expr(hours).alias("valid_time"))


def reindex_hourly(series: DataFrame, cols: list[str], start=None, end=None, zones: DataFrame | None = None) -> DataFrame:
    """Series on the dense hourly axis, gaps as nulls. Input must be unique per ``(zone, valid_time)``.

    The axis rows and the observed rows are stacked and merged by one aggregation instead of a left join.
    """
    bounds = zone_bounds(series, start, end, zones)
    inside = _between(series.select("zone", "valid_time", *cols), start, end)
    stacked = inside.withColumn("_axis", F.lit(False)).unionByName(
        hourly_spine(bounds).withColumn("_axis", F.lit(True)), allowMissingColumns=True
    )
    return (
        stacked.groupBy("zone", "valid_time")
        .agg(*[F.max(c).alias(c) for c in cols], F.bool_or("_axis").alias("_axis"))
        .where("_axis")
        .drop("_axis")
    )


# --- dense blocks: the one shuffle ---------------------------------------------------------------------------------


def dense_blocks(
    bounds: DataFrame,
    parts: list[DataFrame],
    values: list[str],
    halo_hours: int = LONGEST_FRAME,
    block_hours: int = DEFAULT_BLOCK_HOURS,
    carry: DataFrame | None = None,
    fill: list[str] | None = None,
) -> DataFrame:
    """Axis rows and all sources stacked, shuffled once by ``(zone, block)`` and merged there.

    Returns ``zone, _block, valid_time, *values`` for every axis hour of a block and its halo. ``fill`` columns are
    forward-filled; ``carry`` brings in, one row per block, values older than the halo.
    """
    part = ["zone", BLOCK]
    tall = hourly_spine(bounds, block_hours).withColumn("_axis", F.lit(True))
    for p in parts:
        tall = tall.unionByName(p.withColumn("_axis", F.lit(False)), allowMissingColumns=True)
    spread = with_halo(tall, "valid_time", halo_hours, block_hours)
    if carry is not None:
        ahead = block_start(BLOCK, block_hours, -(halo_hours + 1) * 3600)
        spread = spread.unionByName(
            carry.withColumns({"valid_time": ahead, "_axis": F.lit(False)}), allowMissingColumns=True
        )
    known = set(tall.columns)
    # the explicit shuffle serves this merge and every window on (zone, block) after it
    dense = (
        spread.repartition(*part)
        .groupBy(*part, "valid_time")
        .agg(
            F.bool_or("_axis").alias("_axis"),
            *[(F.max(c) if c in known else F.lit(None).cast("double")).alias(c) for c in values],
        )
    )
    if fill:
        upto = Window.partitionBy(*part).orderBy("valid_time").rowsBetween(Window.unboundedPreceding, 0)
        dense = dense.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in fill})
    return dense.where("_axis").drop("_axis")


def _over(expr: str, frame: str = "") -> Column:
    return F.expr(f"{expr} OVER (PARTITION BY zone, {BLOCK} ORDER BY valid_time {frame})")


def add_price_features(dense: DataFrame, price: str = "price") -> DataFrame:
    """Lags and rolling statistics on dense blocks.

    A rolling frame is the difference of two running sums read through lags, so its cost per row does not grow with
    the frame. Prices are centred per block first, which keeps the squares small.
    """
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    far = sorted({ROLL_SHIFT + h for h in (24, 168, 720)})
    out = dense.withColumn("_m", F.expr(f"coalesce(avg({price}) OVER (PARTITION BY zone, {BLOCK}), 0D)"))
    out = out.withColumns({
        "_c": _over(f"count({price})", run),
        "_s": _over(f"sum({price} - _m)", run),
        "_q": _over(f"sum(({price} - _m) * ({price} - _m))", run),
    })
    lags = {f"price_lag{h}h": _over(f"lag({price}, {h})") for h in LAGS}
    ends = {f"_{n}{k}": _over(f"lag(_{n}, {k}, 0)") for n in "csq" for k in (ROLL_SHIFT, *far)}
    out = out.withColumns({**lags, **ends})
    steps = {}
    for h in (24, 168, 720):
        for n in "csq":
            steps[f"_{n}_{h}"] = F.expr(f"coalesce(_{n}{ROLL_SHIFT}, 0) - coalesce(_{n}{ROLL_SHIFT + h}, 0)")
    out = out.withColumns(steps)

    def std(h):
        return F.expr(f"if(_c_{h} > 1, sqrt(greatest((_q_{h} - _s_{h} * _s_{h} / _c_{h}) / (_c_{h} - 1), 0D)), NULL)")

    def mean(h):
        return F.expr(f"if(_c_{h} > 0, _m + _s_{h} / _c_{h}, NULL)")

    return out.select(
        *dense.columns, *LAG_COLS, mean(24).alias("price_roll24h"), mean(168).alias("price_roll168h"),
        std(168).alias("price_roll168h_std"), std(720).alias("price_roll720h_std"),
    )


def price_features(series: DataFrame, start=None, end=None, zones: DataFrame | None = None, price: str = "price",
                   block_hours: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Dense hourly price with lags and rolling statistics; the input need not be dense."""
    rows = _between(series.select("zone", "valid_time", F.col(price).cast("double").alias("price")), start, end)
    bounds = zone_bounds(rows, start, end, zones)
    dense = dense_blocks(bounds, [rows], ["price"], LONGEST_FRAME, block_hours)
    return add_price_features(dense).where(is_core("valid_time", block_hours)).drop(BLOCK)


def forward_fill(dense: DataFrame, cols: list[str], block_hours: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Last known value at or before each row; values from earlier blocks arrive as one carried row per block."""
    carry = carried_last(dense, ["zone"], "valid_time", cols, block_hours)
    carry = carry.withColumn("valid_time", block_start(BLOCK, block_hours, -1))
    own = dense.withColumn(BLOCK, block_of("valid_time", block_hours))
    w = Window.partitionBy("zone", BLOCK).orderBy("valid_time").rowsBetween(Window.unboundedPreceding, 0)
    filled = own.unionByName(carry, allowMissingColumns=True).withColumns(
        {c: F.last(c, ignorenulls=True).over(w) for c in cols}
    )
    return filled.where(is_core("valid_time", block_hours)).drop(BLOCK)


def weather_interactions(hour: str = "hour") -> dict[str, Column]:
    return {"temp_x_wind": F.expr("temperature * wind_speed"), "temp_x_hour": F.expr(f"temperature * {hour}")}


# --- the matrix ----------------------------------------------------------------------------------------------------


def build_features(
    price: DataFrame,
    weather: DataFrame | None = None,
    generation: DataFrame | None = None,
    load: DataFrame | None = None,
    flows: DataFrame | None = None,
    start=None,
    end=None,
    zones: DataFrame | None = None,
    warmup_hours: int = 0,
    gate_safe: bool = False,
    block_hours: int = DEFAULT_BLOCK_HOURS,
    bounds: DataFrame | None = None,
    **holiday_options,
) -> DataFrame:
    """Feature matrix for every hour in ``[start, end)`` of every zone.

    Inputs, each unique per ``(zone, valid_time)``: ``price`` (price), ``weather`` (temperature, wind_speed,
    irradiance), ``generation`` (wind_mw, solar_mw), ``load`` (value_mw or load_mw); ``flows`` are raw edges.
    ``warmup_hours`` reads that much history before ``start`` so the first lags are filled (0 keeps lags inside the
    window). ``gate_safe`` nulls the 23 h lag at hour 23, which reads the delivery day itself. ``bounds`` (``zone, lo,
    hi``) gives each zone an axis of its own; ``flows`` may be net already (``zone, valid_time, net_exchange_mw``).
    """
    first = None
    if start is not None:
        first = _ts(start) - F.make_interval(hours=F.lit(warmup_hours)) if warmup_hours else _ts(start)
    parts = [_between(price.select("zone", "valid_time", F.col("price").cast("double").alias("price")), first, end)]
    if bounds is None:
        bounds = zone_bounds(parts[0], first, end, zones)
    carry = fill = None
    if weather is not None:
        fill = [c for c in WEATHER_COLS if c in weather.columns]
        on_axis = F.date_trunc("hour", F.col("valid_time")) == F.col("valid_time")
        parts.append(_between(weather.select("zone", "valid_time", *fill), first, end).where(on_axis))
        blocks = zone_blocks(bounds, block_hours).select("zone", BLOCK)
        carry = carried_last(parts[-1], ["zone"], "valid_time", fill, block_hours, blocks)
    if generation is not None:
        parts.append(_between(generation.select("zone", "valid_time", "wind_mw", "solar_mw"), first, end))
    if load is not None:
        mw = "load_mw" if "load_mw" in load.columns else "value_mw"
        parts.append(_between(load.select("zone", "valid_time", F.col(mw).alias("load_mw")), first, end))
    if flows is not None:
        flows = _between(flows, first, end)
        parts.append(flows if "net_exchange_mw" in flows.columns else net_exchange(flows))

    values = ["price", *WEATHER_COLS, *GRID_COLS]
    dense = dense_blocks(bounds, parts, values, LONGEST_FRAME, block_hours, carry, fill)
    out = add_price_features(dense).where(is_core("valid_time", block_hours))
    if start is not None and warmup_hours:
        out = out.where(F.col("valid_time") >= _ts(start))
    out = add_calendar(out, **holiday_options).withColumns(weather_interactions())
    if gate_safe:
        out = out.withColumn("price_lag23h", F.when(F.col("hour") != 23, F.col("price_lag23h")))
    return out.select(*MATRIX_COLS)


def delivery_day(matrix: DataFrame, day: dt.date | Column) -> DataFrame:
    """The 24 rows of one UTC date per zone; any other count fails the job."""
    d = day if isinstance(day, Column) else F.lit(day)
    rows = matrix.where(F.to_date("valid_time") == d)
    counted = rows.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("zone")))
    ok = F.assert_true(F.col("_rows") == 24, F.lit("Expected 24 feature rows per zone and day")).isNull()
    return counted.where(ok).drop("_rows")


def require_day(matrix: DataFrame, day: dt.date) -> DataFrame:
    """``delivery_day`` that also rejects a day without any row."""
    rows = delivery_day(matrix, day)
    if rows.isEmpty():
        raise ValueError(f"No feature data available on {day}")
    return rows


def inference_features(price: DataFrame, day: dt.date, zones: DataFrame | None = None, **sources) -> DataFrame:
    """Features of one delivery day from the history window all frames need."""
    start = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=HISTORY_HOURS)
    end = dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1)
    if zones is None:  # those of the window, not of all history
        zones = _between(price.select("zone", "valid_time"), start, end).select("zone").distinct()
    return delivery_day(build_features(price, start=start, end=end, zones=zones, **sources), day)


def training_rows(matrix: DataFrame, features: list[str] = MODEL_FEATURES, label: str = "price") -> DataFrame:
    """Rows with every available feature and the label present."""
    available = [c for c in features if c in matrix.columns]
    return matrix.na.drop("any", subset=[*available, label])


def scorable(features: list[str]) -> Column:
    """True on rows every feature is present on (inference keeps the others with null scores)."""
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).isNotNull()
    return ok


def categorical_int(matrix: DataFrame, cols=("hour", "weekday", "month")) -> DataFrame:
    return matrix.withColumns({c: F.col(c).cast("int") for c in cols if c in matrix.columns})
