"""The relational tables, from Parquet or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "account", "auth", "workspace", "user", "key", "provider", "model", "billing", "subscription", "payment", "usage",
    "ip", "ip_rate_limit", "benchmark",
)


def scan_tables(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """One lazy DataFrame per table of ``path``."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet") for name in names}


def scan_jdbc(
    spark: SparkSession, url: str, name: str, key: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """A table read in ``partitions`` ranges of ``key``, which must be a number, date or timestamp."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    reader = reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
    return reader.option("numPartitions", str(partitions)).options(**options).load()
