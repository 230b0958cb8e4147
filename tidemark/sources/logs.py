"""Line formats: structured logs, tolerant JSON lines, the statistics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_LINE = r"\A(DEBUG|INFO|WARN|ERROR)\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}) \+(\d+)ms ?((?:[\w.]+=\S+ ?)*)(.*)\z"
STATS_LINE = r"\A\|\s*([\d-]+)\s*\|\s*([\d,]+)\s*(?:\([^)]*\))?\s*\|\s*([\d,]+)\s*(?:\([^)]*\))?\s*\|\s*([\d,]+)\s*(?:\([^)]*\))?\s*\|"


def parse_logs(lines: DataFrame) -> DataFrame:
    """``LEVEL time +Nms k=v … message`` lines in ``value`` as columns; other lines are dropped."""
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    return lines.where(F.rlike("value", F.lit(LOG_LINE))).select(
        part(1).alias("level"),
        F.to_timestamp(part(2), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        part(3).cast("long").alias("elapsed_ms"),
        F.when(part(4) != "", F.str_to_map(F.rtrim(part(4)), F.lit(" "), F.lit("="))).alias("tags"),
        part(5).alias("message"),
    )


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_logs(spark.read.text(path))


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines without those that do not parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_stats_table(lines: DataFrame) -> DataFrame:
    """Rows of the markdown table in ``value``: (date, first, second, total)."""
    number = lambda i: F.regexp_replace(F.regexp_extract("value", STATS_LINE, i), ",", "").cast("long")
    return lines.where(F.rlike("value", F.lit(STATS_LINE))).select(
        F.to_date(F.regexp_extract("value", STATS_LINE, 1)).alias("date"),
        number(2).alias("first"),
        number(3).alias("second"),
        number(4).alias("total"),
    )


def scan_stats_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_stats_table(spark.read.text(path))


def stats_lines(deltas: DataFrame) -> DataFrame:
    """Markdown rows (``value``) from the columns of ``download_deltas``."""
    comma = lambda c: F.format_number(F.col(c), 0)
    change = lambda c: F.concat(F.lit(" ("), F.when(F.col(c) >= 0, "+").otherwise(""), comma(c), F.lit(")"))
    cells = [x for c in ("first", "second", "total") for x in (comma(c), change(f"{c}_delta"), F.lit(" | "))]
    return deltas.select(
        F.concat(F.lit("| "), F.col("date").cast("string"), F.lit(" | "), *cells[:-1], F.lit(" |")).alias("value")
    )
