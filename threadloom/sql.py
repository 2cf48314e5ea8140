"""The SQL surface: a folder's tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("documents", "pages", "conversations", "labels", "events", "embeddings", "benchmark", "region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def register_views(spark: SparkSession, folder: str, prefix: str = "", tables: tuple[str, ...] = TABLES) -> list[str]:
    """Views over the Parquet tables of a folder, under their names behind a prefix; gives the names. Views of the same names are replaced."""
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in tables]
