"""Landing request and response records by model and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITIONS = ("model", "yyyy", "mm", "dd", "hh")


def with_partitions(requests: DataFrame) -> DataFrame:
    part = lambda fmt: F.date_format("ts", fmt)
    return requests.withColumns({"yyyy": part("yyyy"), "mm": part("MM"), "dd": part("dd"), "hh": part("HH")})


def _landable(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("model").isNotNull() & (F.col("session_id") != ""))


def metadata(requests: DataFrame) -> DataFrame:
    return _landable(requests).drop("request", "response")


def dump_requests(requests: DataFrame, path: str, tasks: int | None = None) -> None:
    """Write ``data`` by model and hour and ``meta`` by model.

    The rebalance brings the rows of an hour together, so that not every task
    opens a file in every folder, and splits an hour or model that is too big
    for one task. ``tasks`` fixes how many tasks write, for many small hours.
    """
    data = with_partitions(_landable(requests))
    columns = [F.col(c) for c in PARTITIONS]
    data = data.repartition(tasks, *columns) if tasks else data.hint("rebalance", *columns)
    data.write.mode("append").partitionBy(*PARTITIONS).json(f"{path}/data")
    meta = metadata(requests).hint("rebalance", F.col("model"))
    meta.write.mode("append").partitionBy("model").json(f"{path}/meta")


def dump_request_stream(requests: DataFrame, path: str, checkpoint: str):
    """The same from a stream; both copies are written in one micro-batch step."""

    def land(batch: DataFrame, batch_id: int) -> None:
        # A batch that runs again replaces what it wrote before.
        stamped = with_partitions(_landable(batch)).withColumn("batch", F.lit(batch_id))
        options = {"partitionOverwriteMode": "dynamic"}
        stamped.write.mode("overwrite").options(**options).partitionBy("batch", *PARTITIONS).json(f"{path}/data")
        meta = metadata(batch).withColumn("batch", F.lit(batch_id))
        meta.write.mode("overwrite").options(**options).partitionBy("batch", "model").json(f"{path}/meta")

    return requests.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
