"""Registered queries: text scalars and line structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.catalog.common import norm, tables, tokens, trim
from evidar.functions import text as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def normalize_ws(t):
    docs = t("documents").select(F.lit("d").alias("origin"), F.col("doc_id").alias("id"), "text")
    turns = t("conversations").select(
        F.lit("c").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    text = T.normalize_ws("text")
    return docs.unionByName(turns).select("origin", "id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("n_chars"))


QUERIES["normalize_ws"] = tables(normalize_ws)
ORACLES["normalize_ws"] = f"""
WITH x AS (SELECT 'd' AS origin, doc_id AS id, text FROM documents
           UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations),
n AS (SELECT origin, id, {norm('text')} AS text FROM x)
SELECT origin, id, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM n
"""


def comparable_text(t):
    text = T.comparable_text("text")
    return t("documents").select("doc_id", F.md5(text).alias("digest"))


QUERIES["comparable_text"] = tables(comparable_text)
COMPARABLE = r"regexp_replace(lower({x}), '[\s\x0B\p{{Z}}\x{{FEFF}}\p{{P}}\p{{S}}]+', '', 'g')"
ORACLES["comparable_text"] = f"SELECT doc_id, md5({COMPARABLE.format(x='text')}) AS digest FROM documents"


def is_meaningful(t):
    return t("pages").select("page_id", T.is_meaningful("html").alias("meaningful")).unionByName(
        t("documents").select((-F.col("doc_id") - 1).alias("page_id"), T.is_meaningful("text").alias("meaningful"))
    )


QUERIES["is_meaningful"] = tables(is_meaningful)
ORACLES["is_meaningful"] = f"""
WITH x AS (SELECT page_id, html AS text FROM pages UNION ALL SELECT -doc_id - 1, text FROM documents)
SELECT page_id, length({norm('text')}) >= 24 AND regexp_matches(text, '[\\x{{3400}}-\\x{{9fff}}A-Za-z0-9]') AS meaningful FROM x
"""


def infer_title(t):
    return t("documents").select("doc_id", T.infer_title(T.normalize_ws("text"), F.lit("untitled")).alias("title"))


QUERIES["infer_title"] = tables(infer_title)
ORACLES["infer_title"] = f"""
WITH l AS (SELECT doc_id, list_transform(string_split({norm('text')}, chr(10)), lambda x: {trim('x')}) AS lines FROM documents)
SELECT doc_id, coalesce(list_filter(lines, lambda x: length(x) BETWEEN 2 AND 100
         AND NOT regexp_matches(x, '^[•·▪◦*-]'))[1], 'untitled') AS title FROM l
"""


def token_counts(t):
    tok = T.tokenize("text")
    return t("documents").select(
        "doc_id", F.size(tok).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(tok)).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join(tok, " ")).alias("digest"),
    )


QUERIES["tokenize"] = tables(token_counts)
ORACLES["tokenize"] = f"""
WITH x AS (SELECT doc_id, {tokens('text')} AS tok FROM documents)
SELECT doc_id, len(tok)::BIGINT AS n_tokens, len(list_distinct(tok))::BIGINT AS n_distinct,
       md5(array_to_string(tok, ' ')) AS digest FROM x
"""
