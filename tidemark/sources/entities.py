"""Keyed documents: a JSON key tree to read, a bucketed Parquet store to upsert into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def scan_entities(
    spark: SparkSession, root: str, kind: str, schema: StructType | str, keys: int = 2, one_per_file: bool = True
) -> DataFrame:
    """Documents below ``root/kind`` with ``key``: the last ``keys`` path segments, without ``.json``.

    With ``one_per_file=False`` a file holds one document per line and can be split.
    """
    read = spark.read.schema(schema).option("multiLine", one_per_file).option("recursiveFileLookup", "true")
    docs = read.option("pathGlobFilter", "*.json").json(f"{root.rstrip('/')}/{kind}")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\.json\z", "")
    return docs.withColumn("key", F.slice(F.split(path, "/"), -keys, keys))


def _store(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}.entities"


def write_entities(df: DataFrame, root: str, kind: str, key: str = "id", version: str = "updated", buckets: int = BUCKETS) -> None:
    """Upsert whole documents by key; the highest version stays.

    Documents live in hash buckets of the key. Only the buckets that receive
    documents are read and replaced. The number of buckets belongs to the store:
    give more from the start for more data.
    """
    spark = df.sparkSession
    path = _store(root, kind)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    incoming = df.withColumn("bucket", bucket).withColumn("_new", F.lit(1))
    rows = incoming
    if _exists(spark, path):
        touched = incoming.select("bucket").distinct()
        stored = spark.read.schema(incoming.drop("_new").schema).parquet(path)
        rows = incoming.unionByName(stored.join(touched, "bucket", "left_semi").withColumn("_new", F.lit(0)))
    fields = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*fields), F.struct(version, "_new")).alias("_d")
    latest = rows.groupBy("bucket", key).agg(newest).select(key, "_d.*", "bucket").select(*df.columns, "bucket")
    # Rows of a bucket are brought together, and split again where a bucket is too big for one task.
    latest = latest.hint("rebalance", F.col("bucket"))
    latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_entities(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.parquet(_store(root, kind)).drop("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
