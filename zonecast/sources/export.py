"""CSV tables and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 2) -> None:
    rounded(df, digits).write.mode("overwrite").option("header", "true").csv(path)


def to_json_lines(df: DataFrame, name: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
