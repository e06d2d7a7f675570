"""Parquet and CSV sinks, and the stored load history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Overwrites ``path``; ``sort`` orders rows within files for range pruning."""
    out = df.sortWithinPartitions(sort) if sort else df
    out.write.mode("overwrite").parquet(path)


def write_years(df: DataFrame, path: str, order: str = "datetime") -> None:
    """CSV below ``year=...`` directories.

    Rows are range-partitioned by year and time: tasks get equal shares even if
    one year holds most rows, and a year is written by few tasks.
    """
    ranged = df.repartitionByRange("year", order).sortWithinPartitions("year", order)
    ranged.write.mode("overwrite").partitionBy("year").option("header", True).csv(path)


def read_years(spark: SparkSession, path: str, schema: str, years: list[int] | None = None) -> DataFrame:
    """Reads what write_years wrote; ``years`` prunes directories."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df if years is None else df.where(F.col("year").isin(years))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Stored Parquet table; only the wanted columns are scanned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_history(spark: SparkSession, path: str, time: str = "datetime") -> DataFrame:
    """Stored load history in time order."""
    return spark.read.parquet(path).orderBy(time)
