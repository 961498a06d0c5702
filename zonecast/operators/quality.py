"""Data-quality suites: one scan per suite, one result row per expectation.

Output: ``suite, column, expectation, n_rows, n_failed, success``. Range rules ignore nulls (null-ness is its own
rule); rules on a missing column are skipped after its existence rule fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: limits ---
PRICE_RANGE = (-500.0, 5000.0)
TEMPERATURE_RANGE = (-50.0, 60.0)
# --- end of fixed values ---


def _out_of_range(col: str, low, high) -> Column:
    c = F.col(f"`{col}`")
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return F.coalesce(bad, F.lit(False))


class _Suite:
    def __init__(self, name: str, df: DataFrame):
        self.name, self.df = name, df
        self.facts: list[tuple[str, str, bool]] = []
        self.rules: list[tuple[str, str, Column]] = []
        self.unique: list[tuple[str, list[str]]] = []

    def exists(self, col):
        self.facts.append((col, "exists", col in self.df.columns))
        return col in self.df.columns

    def not_null(self, col):
        self.rules.append((col, "not_null", F.col(f"`{col}`").isNull()))

    def between(self, col, low=None, high=None):
        self.rules.append((col, "between", _out_of_range(col, low, high)))

    def result(self) -> DataFrame:
        counts = [F.count_if(bad).alias(f"_r{i}") for i, (_, _, bad) in enumerate(self.rules)]
        if self.unique:
            # uniqueness needs groups; fold every other rule into the same grouping so the scan happens once
            col, scope = self.unique[0]
            keys = [F.col(k) for k in dict.fromkeys([*scope, col])]
            groups = self.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counts)
            dup = F.sum(F.when((F.col("_n") > 1) & F.col(col).isNotNull(), F.col("_n")))
            one = groups.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"),
                *[F.coalesce(F.sum(f"_r{i}"), F.lit(0)).alias(f"_r{i}") for i in range(len(counts))],
                F.coalesce(dup, F.lit(0)).alias("_dup"),
            )
        else:
            one = self.df.agg(F.count(F.lit(1)).alias("_n"), *counts)
        rows = [
            F.struct(F.lit(c).alias("column"), F.lit(e).alias("expectation"),
                     F.lit(0 if ok else 1).cast("bigint").alias("n_failed"))
            for c, e, ok in self.facts
        ]
        rows += [
            F.struct(F.lit(c).alias("column"), F.lit(e).alias("expectation"),
                     F.col(f"_r{i}").cast("bigint").alias("n_failed"))
            for i, (c, e, _) in enumerate(self.rules)
        ]
        if self.unique:
            rows.append(F.struct(F.lit(self.unique[0][0]).alias("column"), F.lit("unique").alias("expectation"),
                                 F.col("_dup").cast("bigint").alias("n_failed")))
        return one.select(F.col("_n").cast("bigint").alias("n_rows"), F.explode(F.array(*rows)).alias("r")).select(
            F.lit(self.name).alias("suite"), "r.column", "r.expectation", "n_rows", "r.n_failed",
            (F.col("r.n_failed") == 0).alias("success"),
        )


def check_prices(df: DataFrame, unique_within: tuple[str, ...] = ("zone",)) -> DataFrame:
    """``valid_time, value, zone``; a time may appear once per zone."""
    s = _Suite("prices", df)
    has = {c: s.exists(c) for c in ("valid_time", "value", "zone")}
    if has["valid_time"]:
        s.not_null("valid_time")
        s.unique.append(("valid_time", [c for c in unique_within if c in df.columns]))
    if has["value"]:
        s.not_null("value")
        s.between("value", *PRICE_RANGE)
    if has["zone"]:
        s.not_null("zone")
    return s.result()


def check_weather(df: DataFrame) -> DataFrame:
    s = _Suite("weather", df)
    cols = ("valid_time", "temperature_2m", "wind_speed_10m", "shortwave_radiation", "zone")
    has = {c: s.exists(c) for c in cols}
    for c in cols:
        if has[c]:
            s.not_null(c)
    if has["temperature_2m"]:
        s.between("temperature_2m", *TEMPERATURE_RANGE)
    for c in ("wind_speed_10m", "shortwave_radiation"):
        if has[c]:
            s.between(c, low=0.0)
    return s.result()


def check_generation(df: DataFrame) -> DataFrame:
    """Keys, at least one fuel column, and no negative output in any of them."""
    s = _Suite("generation", df)
    for c in ("valid_time", "zone"):
        if s.exists(c):
            s.not_null(c)
    fuels = [c for c in df.columns if c not in ("valid_time", "zone")]
    s.facts.append(("*", "column_count", len(df.columns) >= 3))
    for c in fuels:
        s.between(c, low=0.0)
    return s.result()


def check_not_null(df: DataFrame, suite: str, cols: list[str]) -> DataFrame:
    s = _Suite(suite, df)
    for c in cols:
        if s.exists(c):
            s.not_null(c)
    return s.result()


SILVER_NOT_NULL = {
    "silver_generation": ["valid_time", "zone", "total_mw", "wind_mw", "solar_mw"],
    "silver_load": ["valid_time", "zone", "value_mw"],
    "silver_crossborder": ["valid_time", "from_zone", "to_zone", "value_mw"],
}


def check_silver(df: DataFrame, table: str) -> DataFrame:
    return check_not_null(df, table, SILVER_NOT_NULL[table])
