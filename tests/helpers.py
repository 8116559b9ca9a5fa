"""Small builders shared by the tests."""

from pyspark.sql import functions as F

CHUNK = (
    "collection_id string, chunk_id string, chunk_ordinal bigint, file_name string, kind string, number int, label string, "
    "title string, content_type string, text string, text_origin string, ocr_confidence double, evidence_weight double, embedding array<double>"
)


def scalar(spark, column):
    """Value of one column expression without any table."""
    return spark.range(1).select(column.alias("v")).first()["v"]


def chunk(i, text, title="", collection="c", kind="page", content_type="prose", origin="native", confidence=None, weight=None, vector=None, file="f.pdf", number=None):
    return (collection, f"k{i:04d}", i, file, kind, number or i + 1, f"page {i + 1}", title, content_type, text, origin, confidence, weight, vector)


def chunks(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def queries(spark, rows, vectors=None):
    """rows: (query_id, mode, text); all ask collection ``c``."""
    data = [(q, "c", mode, text, (vectors or {}).get(q)) for q, mode, text in rows]
    df = spark.createDataFrame(data, "query_id string, collection_id string, mode string, text string, embedding array<double>")
    return df if vectors else df.drop("embedding")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lit_text(value):
    return F.lit(value)
