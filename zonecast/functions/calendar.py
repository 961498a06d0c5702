"""UTC calendar features by arithmetic on the timestamp: no join, everything stays in generated code.

The steps are stacked as small projections, so repeated parts (year, Easter offset) are computed once per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALENDAR_COLS = [
    "hour", "weekday", "month", "is_weekend", "is_holiday", "hour_of_week",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos",
    "hour_x_month", "weekend_x_hour",
]


def _exprs(named: dict[str, str]) -> dict:
    return {n: F.expr(e) for n, e in named.items()}


def with_easter_offset(df: DataFrame, time: str = "valid_time", name: str = "from_easter") -> DataFrame:
    """Days from the Gregorian Easter Sunday of the row's year (Oudin's integer rule)."""
    df = df.withColumns(_exprs({"_y": f"year(`{time}`)"}))
    df = df.withColumns(_exprs({"_g": "_y % 19", "_c": "_y div 100"}))
    df = df.withColumns(_exprs({"_h": "(_c - _c div 4 - (8 * _c + 13) div 25 + 19 * _g + 15) % 30"}))
    df = df.withColumns(_exprs({"_i": "_h - (_h div 28) * (1 - (29 div (_h + 1)) * ((21 - _g) div 11))"}))
    moon_to_sunday = "_i - (_y + _y div 4 + _i + 2 - _c + _c div 4) % 7"
    offset = f"datediff(to_date(`{time}`), make_date(_y, 3, 28)) - ({moon_to_sunday})"
    return df.withColumns(_exprs({name: offset})).drop("_y", "_g", "_c", "_h", "_i")


def with_swedish_holiday(df: DataFrame, time: str = "valid_time", name: str = "is_holiday",
                         include_eves: bool = True, include_sundays: bool = False) -> DataFrame:
    """1 on Swedish public holidays (UTC date), else 0.

    ``include_eves`` adds Midsummer, Christmas and New Year's Eve; ``include_sundays`` adds every Sunday.
    """
    df = with_easter_offset(df, time, "_fe").withColumns(_exprs({
        "_md": f"month(`{time}`) * 100 + dayofmonth(`{time}`)", "_wd": f"weekday(`{time}`)", "_yr": f"year(`{time}`)",
    }))
    # fixed values: month-day pairs and offsets from Easter Sunday
    hits = [
        "_md IN (101, 106, 501, 1225, 1226)",
        "_fe IN (-2, 0, 1, 39, 49)",
        "(_md = 606 AND _yr >= 2005)",
        "(_fe = 50 AND _yr <= 2004)",
        "(_wd = 5 AND (_md BETWEEN 620 AND 626 OR _md BETWEEN 1031 AND 1106))",
    ]
    if include_eves:
        hits.append("_md IN (1224, 1231) OR (_wd = 4 AND _md BETWEEN 619 AND 625)")
    if include_sundays:
        hits.append("_wd = 6")
    return df.withColumns(_exprs({name: f"CAST({' OR '.join(hits)} AS INT)"})).drop("_fe", "_md", "_wd", "_yr")


def add_calendar(df: DataFrame, time: str = "valid_time", **holiday_options) -> DataFrame:
    """All calendar features; weekday 0 is Monday."""
    df = with_swedish_holiday(df, time, **holiday_options)
    df = df.withColumns(_exprs({"hour": f"hour(`{time}`)", "weekday": f"weekday(`{time}`)", "month": f"month(`{time}`)"}))
    df = df.withColumns(_exprs({
        "is_weekend": "CAST(weekday >= 5 AS INT)",
        "hour_of_week": "weekday * 24 + hour",
        "hour_sin": "sin(2 * pi() * hour / 24)",
        "hour_cos": "cos(2 * pi() * hour / 24)",
        "weekday_sin": "sin(2 * pi() * weekday / 7)",
        "weekday_cos": "cos(2 * pi() * weekday / 7)",
        "month_sin": "sin(2 * pi() * (month - 1) / 12)",
        "month_cos": "cos(2 * pi() * (month - 1) / 12)",
        "hour_x_month": "hour * month",
    }))
    return df.withColumns(_exprs({"weekend_x_hour": "is_weekend * hour_sin"}))
