"""Sources and sinks: parquet/CSV scans, semantic renaming, area-partitioned sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, root: str, name: str,
               company_code: object | None = None,
               company_col: str | None = None) -> DataFrame:
    """Read a table by name from a directory of ``<name>.parquet``.

    ``company_code`` binds the table to one company: rows are restricted with a
    plain predicate on ``company_col`` that Catalyst pushes into the scan."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    if company_code is not None:
        if company_col is None:
            raise ValueError("company_col is required with company_code")
        df = df.where(F.col(company_col) == F.lit(company_code))
    return df


def semantic_select(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project and rename by a technical -> business name dictionary.

    Names are trimmed (a stray blank must not silently drop a column)."""
    return df.select([F.col(k.strip()).alias(v.strip()) for k, v in mapping.items()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV with an explicit schema (no inference, values typed)."""
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite one parquet dataset; parallel write, no single-file funnel."""
    df.write.mode("overwrite").parquet(path)


def write_by_area(df: DataFrame, path: str, area_col: str = "customer_area") -> None:
    """One directory per customer area (Hive-style partitioning)."""
    df.write.mode("overwrite").partitionBy(area_col).parquet(path)


def read_area(spark: SparkSession, path: str, area: str | None = None,
              area_col: str = "customer_area") -> DataFrame:
    """Read one area's result; the equality prunes partitions at planning."""
    df = spark.read.parquet(path)
    if area is not None:
        df = df.where(F.col(area_col) == F.lit(area))
    return df


def lit_date(value: str) -> Column:
    """Typed date literal so comparisons stay pushable."""
    return F.to_date(F.lit(value))
