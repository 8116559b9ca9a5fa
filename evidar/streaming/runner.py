"""Running a stream to a table in the shared folder."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, name: str, output_mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is available and return every emitted row with its ``batch_id``.

    Each micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_folder(spark)}/evidar/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(output_mode).foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(f"{base}/out")


def run_by_clock(stream: DataFrame, name: str, seconds: int = 600, output_mode: str = "update") -> DataFrame:
    """As ``run_available`` for a stream with wall-clock timers, which never runs dry.

    Ends after two micro-batches without new rows: the timers that were due have fired then.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/evidar/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(output_mode).foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="1 second").start()
    )
    try:
        idle, seen, until = 0, -1, time.time() + seconds
        while idle < 2 and query.isActive and time.time() < until:
            time.sleep(0.2)
            done = query.lastProgress
            if done is not None and done["batchId"] > seen:
                seen = done["batchId"]
                idle = idle + 1 if done["numInputRows"] == 0 else 0
        if query.exception() is not None:
            raise query.exception()
        if idle < 2:
            raise TimeoutError(f"{name}: rows were still coming after {seconds} s")
    finally:
        query.stop()
    return spark.read.schema(stream.schema.add("batch_id", "long")).parquet(f"{base}/out")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode stream."""
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row"))
    return last.select(*keys, "_row.*")


def with_rocksdb(spark: SparkSession) -> None:
    """State stores that keep large state out of executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
