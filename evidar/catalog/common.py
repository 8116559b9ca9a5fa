"""Table access and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidar.functions.text import LATIN_TOKEN, STOP_WORDS


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One small file would be read by one task, so a table with
    fewer files than cores is spread out first; a large table is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            # The given times are UTC whatever the session time zone is.
            micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {field.name})")
            df = df.withColumn(field.name, F.timestamp_micros(micros))
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def tables(query):
    """Give a query function a ``t(name)`` reader instead of (spark, sf_dir)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(lambda name: table(spark, sf_dir, name))

    run.__doc__ = query.__doc__
    run.__name__ = query.__name__
    return run


def document_chunks(t, collection: str = "corpus") -> DataFrame:
    """Every document as one chunk; one collection per source or one for all."""
    docs = t("documents")
    key = F.col("source") if collection == "source" else F.lit("corpus")
    return docs.select(
        key.alias("collection_id"),
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("doc_id").alias("chunk_ordinal"),
        F.col("source").alias("file_name"),
        F.lit("page").alias("kind"),
        (F.col("doc_id") % 120 + 1).cast("int").alias("number"),
        F.concat(F.lit("page "), (F.col("doc_id") % 120 + 1).cast("string")).alias("label"),
        F.substring_index(F.substring_index("text", "\n", 1), ".", 1).alias("title"),
        F.when(F.col("lang") == "en", "prose").when(F.col("lang") == "fr", "code")
        .when(F.col("lang") == "de", "table").otherwise("list").alias("content_type"),
        F.col("text"),
        F.when(F.col("doc_id") % 4 == 1, "ocr").when(F.col("doc_id") % 4 == 2, "mixed")
        .when(F.col("doc_id") % 4 == 3, "vision").otherwise("native").alias("text_origin"),
        (F.col("n_chars") % 101).cast("double").alias("ocr_confidence"),
        F.lit(None).cast("double").alias("evidence_weight"),
    )


# ---- SQL fragments -----------------------------------------------------------
WS = r"[\s\x0B\p{Z}\x{FEFF}]"


def norm(x: str) -> str:
    """P1 in SQL."""
    x = f"replace({x}, chr(0), '')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\t\\f\\x0B ]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' *\\n *', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim(x)


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def tokens(x: str) -> str:
    """P16 in SQL for text without Han characters."""
    return (
        f"list_filter(regexp_extract_all(lower({norm(x)}), '{LATIN_TOKEN}'), "
        f"lambda w: length(w) > 1 AND w NOT IN {STOP_SQL})"
    )


CHUNKS_SQL = """
SELECT 'corpus' AS collection_id, source, doc_id, doc_id AS chunk_ordinal,
       CAST(doc_id % 120 + 1 AS INTEGER) AS number, text, n_chars,
       split_part(split_part(text, chr(10), 1), '.', 1) AS title,
       CASE lang WHEN 'en' THEN 'prose' WHEN 'fr' THEN 'code' WHEN 'de' THEN 'table' ELSE 'list' END AS content_type,
       CASE doc_id % 4 WHEN 1 THEN 0.5 + (n_chars % 101) / 100.0::DOUBLE * 0.45
                       WHEN 2 THEN 0.72 + (n_chars % 101) / 100.0::DOUBLE * 0.25
                       WHEN 3 THEN 0.72 ELSE 1.0 END::DOUBLE AS reliability
FROM documents
"""
