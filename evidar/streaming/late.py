"""Deliveries behind the watermark in a table of their own (T4, T5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DataType, LongType, StructField, StructType

from evidar.operators.sessions import millis


def wider(schema: StructType, name: str, kind: DataType) -> StructType:
    return StructType([*schema.fields, StructField(name, kind)])


def split_late(
    arrivals: DataFrame, folder: str, delay_ms: int, ts: str = "arrival_ts",
    keys: tuple[str, ...] = ("study_id", "client_event_id"), order: tuple[str, ...] = ("arrival_ts", "arrival_seq"),
) -> StreamingQuery:
    """Write every arrival to exactly one of the tables ``on_time`` and ``late`` below ``folder`` (one that all executors share).

    An arrival is late if its ``ts`` is more than ``delay_ms`` before the greatest one of earlier micro-batches. Rows on time carry
    ``duplicate``: a row of the same keys that was on time came before, in this micro-batch or, no more than twice the delay behind that greatest one, in
    an earlier one. So what a micro-batch looks up is bounded by time, and it lies in the written table, not in executor memory.
    NULL keys are never duplicates, a NULL time is never late. Each micro-batch replaces its own files and reads only those of smaller
    numbers, so a repeated one changes nothing. Returns the started query; it processes what is there and ends.
    """
    spark = arrivals.sparkSession
    rows = wider(arrivals.schema, "duplicate", BooleanType())

    def read(table: str, schema, batch_id: int) -> DataFrame:
        return spark.read.schema(wider(schema, "batch_id", LongType())).parquet(f"{folder}/{table}").where(F.col("batch_id") < batch_id).drop("batch_id")

    def put(df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{table}/batch_id={batch_id}")

    marks = spark.range(0).select(F.lit(0).cast("long").alias("mark"))
    for table, empty in (("seen", marks), ("late", arrivals.schema), ("on_time", rows)):
        empty = empty if isinstance(empty, DataFrame) else spark.createDataFrame([], empty)
        put(empty, table, -1)

    def write(batch: DataFrame, batch_id: int) -> None:
        put(batch, "staged", batch_id)
        staged = spark.read.schema(arrivals.schema).parquet(f"{folder}/staged/batch_id={batch_id}")
        mark = read("seen", marks.schema, batch_id).agg(F.max("mark")).first()[0]
        behind = F.lit(False) if mark is None else F.coalesce(millis(ts) < mark - delay_ms, F.lit(False))
        put(staged.where(behind), "late", batch_id)

        on_time = staged.where(~behind)
        named = [F.col(k).isNotNull() for k in keys]
        complete = named[0]
        for test in named[1:]:
            complete = complete & test
        at = F.struct(*order)
        # The first arrival of each key in this batch and the keys of earlier batches; minima are combined before the shuffle.
        first = on_time.where(complete).groupBy(*keys).agg(F.min(at).alias("_first"))
        known = read("on_time", arrivals.schema, batch_id)
        if mark is not None:
            known = known.where(millis(ts) >= mark - 2 * delay_ms)
        known = known.select(*keys).distinct().withColumn("_known", F.lit(True))
        flags = first.join(known, [*keys], "left")
        found = on_time.join(flags, [*keys], "left")
        duplicate = F.coalesce(F.col("_known") | (at > F.col("_first")), at > F.col("_first"), F.lit(False))
        put(found.select(*arrivals.columns, duplicate.alias("duplicate")), "on_time", batch_id)
        put(staged.agg(F.max(millis(ts)).alias("mark")).where("mark IS NOT NULL"), "seen", batch_id)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def tables(spark, folder: str, schema) -> tuple[DataFrame, DataFrame]:
    """(on_time, late) as ``split_late`` wrote them; ``schema`` is that of the arrivals."""
    on_time = spark.read.schema(wider(wider(schema, "duplicate", BooleanType()), "batch_id", LongType())).parquet(f"{folder}/on_time")
    return on_time.drop("batch_id"), spark.read.schema(wider(schema, "batch_id", LongType())).parquet(f"{folder}/late").drop("batch_id")
