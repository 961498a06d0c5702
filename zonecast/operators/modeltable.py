"""Attaching small fitted tables (coefficients, encodings) to row data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a fitted table that is unique on ``keys``.

    Spark chooses: it broadcasts what it measures as small in bytes, else it shuffles and splits skewed keys.
    """
    return rows.join(table, list(keys), how)
