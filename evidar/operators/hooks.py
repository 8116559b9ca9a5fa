"""User functions called in small batches inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Fixed value: texts per call.
BATCH = 10


def _call(df: DataFrame, text: str, out: StructField, fn: Callable[[list], list], clean: Callable, batch: int, optional: bool) -> DataFrame:
    """Add ``out`` = fn(texts); with ``optional`` a failing call leaves NULL instead of failing the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values: list = []
            for at in range(0, len(frame), batch):
                part = frame[text].iloc[at:at + batch].tolist()
                try:
                    got = fn(part)
                    if len(got) != len(part):
                        raise ValueError("the function must return one result per text")
                    values.extend(clean(v) for v in got)
                except Exception:  # noqa: BLE001 - any failure of the user function
                    if not optional:
                        raise
                    values.extend([None] * len(part))
            yield frame.assign(**{out.name: values}).drop(columns=[text])

    kept = [f for f in df.schema.fields if f.name != text]
    return df.mapInPandas(run, StructType([*kept, out]))


def embed(chunks: DataFrame, fn: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """Vectors of title, label, type and text; failed calls leave the chunk to lexical search."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    texts = chunks.withColumn("_input", F.concat_ws("\n", *[part(c) for c in ("title", "label", "content_type", "text")]))
    out = StructField("embedding", ArrayType(DoubleType()))
    return _call(texts, "_input", out, fn, lambda v: [round(float(x), 6) for x in v], batch, True)


def rerank_with(pairs: DataFrame, fn: Callable[[list[dict]], list[float]], batch: int = BATCH) -> DataFrame:
    """Scores of (query_id, chunk_id, question, title, label, text) rows, rounded to six decimals."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    asked = pairs.select("query_id", "chunk_id", F.struct("question", F.concat_ws("\n", *[part(c) for c in ("title", "label", "text")]).alias("document")).alias("_input"))
    out = StructField("rerank_score", DoubleType())
    return _call(asked, "_input", out, fn, lambda v: round(float(v), 6), batch, True).filter("rerank_score IS NOT NULL")


def generate(prompts: DataFrame, fn: Callable[[list[str]], list[str]], batch: int = 1) -> DataFrame:
    """Model answers for message arrays (as JSON). Rows with an error code are not sent."""
    ready = prompts.filter("error_code IS NULL").select("query_id", F.to_json("messages").alias("_input"))
    return _call(ready, "_input", StructField("json", StringType()), fn, lambda v: None if v is None else str(v), batch, False)
