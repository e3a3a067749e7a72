"""Table scans (parquet first) for the driver-provided tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Tables whose rows carry long texts: CPU-heavy regex work follows their scans.
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin the rows of a small table over the cores in local mode.

    A test file written as one row group scans as one task, and the text stages after
    it are CPU-bound. On a cluster the scan's own splits are used: a shuffle of whole
    texts would cost more than uneven splits.
    """
    spark = df.sparkSession
    if not spark.sparkContext.master.startswith("local["):
        return df
    return df.repartition(min_partitions or spark.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one table; selecting ``columns`` here lets the scan prune the rest."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    if name in TEXT_TABLES and (columns is None or any(c in ("text", "html") for c in columns)):
        df = spread(df)
    return df
