"""Cross-border net position and generation totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def imports_exports(flows: DataFrame) -> DataFrame:
    """Imports and exports per zone and time in one pass: every edge contributes to both of its ends."""
    none = "CAST(NULL AS DOUBLE)"
    ends = flows.selectExpr(
        "valid_time",
        f"""inline(array(
            struct(to_zone AS zone, CAST(value_mw AS DOUBLE) AS imp, {none} AS exp),
            struct(from_zone AS zone, {none} AS imp, CAST(value_mw AS DOUBLE) AS exp)))""",
    )
    return ends.groupBy("zone", "valid_time").agg(F.sum("imp").alias("imports_mw"), F.sum("exp").alias("exports_mw"))


def net_exchange(flows: DataFrame) -> DataFrame:
    """Imports minus exports; a side that is absent counts as zero."""
    both = imports_exports(flows)
    net = "if(imports_mw IS NULL AND exports_mw IS NULL, NULL, coalesce(imports_mw, 0D) - coalesce(exports_mw, 0D))"
    return both.selectExpr("zone", "valid_time", f"{net} AS net_exchange_mw")


def row_sum(cols: list[str]) -> Column:
    """Sum over columns of a row, nulls skipped; no columns or all null gives 0."""
    return reduce(lambda a, c: a + F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), cols, F.lit(0.0))


def columns_containing(df: DataFrame, part: str, exclude=("valid_time", "zone")) -> list[str]:
    return [c for c in df.columns if part.lower() in c.lower() and c not in exclude]


def fuel_totals(generation: DataFrame) -> DataFrame:
    """Wide fuel columns to ``total_mw, wind_mw, solar_mw``."""
    fuels = [c for c in generation.columns if c not in ("valid_time", "zone")]
    return generation.select(
        "valid_time",
        "zone",
        row_sum(fuels).alias("total_mw"),
        row_sum(columns_containing(generation, "wind")).alias("wind_mw"),
        row_sum(columns_containing(generation, "solar")).alias("solar_mw"),
    )
