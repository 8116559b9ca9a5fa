"""Registered queries: retrieval, OCR, citation and refusal quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.catalog.common import document_chunks, norm, tables
from evidar.catalog.text import COMPARABLE
from evidar.catalog.retrieval import INDEX_SQL, LEX_SQL, PLAIN_SQL, plain_questions
from evidar.operators import evaluation as E
from evidar.operators import lexical, ranking
from evidar.session import saved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CATEGORY = ["overview", "detail", "visual", "review", "comparison"]


def _metrics(t):
    """Questions: benchmark texts that occur in documents; relevant: the documents that contain them."""
    chunks = document_chunks(t)
    asked = plain_questions(t)
    index = lexical.build_index(chunks)
    hits = ranking.rank_hits(lexical.bm25(asked, chunks, index), 10, "lexical_score").withColumn("rank", F.col("rank"))
    relevant = lexical.phrase_hits(asked, chunks, index).groupBy("query_id").agg(F.collect_set("chunk_id").alias("relevant_ids"))
    cases = relevant.withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORY)), (F.col("query_id") % 5 + 1).cast("int")))
    return saved(E.retrieval_metrics(hits.select("query_id", "chunk_id", "rank"), cases), "metrics")


METRICS_SQL = f"""
{INDEX_SQL}, {PLAIN_SQL}, {LEX_SQL},
hits AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_ordinal) AS rank FROM lx WHERE lexical_score > 0 QUALIFY rank <= 10),
rel AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(lower(documents.text), lower({norm('benchmark.text')}))),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
f AS (SELECT query_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM hits JOIN rel USING (query_id, doc_id) GROUP BY ALL),
m AS (SELECT query_id, {"['" + "', '".join(CATEGORY) + "']"}[query_id % 5 + 1] AS category, coalesce(h, 0) / n AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr,
  coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM n LEFT JOIN f USING (query_id)),
sc AS (SELECT category, count(*) AS cases, avg(0.5 * recall + 0.25 * mrr + 0.25 * ndcg) AS score, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg,
  grouping(category)::TINYINT AS overall FROM m GROUP BY GROUPING SETS ((category), ()))
"""
ROUND = lambda *names: [F.round(n, 4).alias(n) for n in names]


def recall_mrr_ndcg(t):
    return _metrics(t).select("query_id", "category", *ROUND("recall", "mrr", "ndcg"))


QUERIES["recall_mrr_ndcg"] = tables(recall_mrr_ndcg)
ORACLES["recall_mrr_ndcg"] = f"WITH {METRICS_SQL} SELECT query_id, category, round(recall, 4) AS recall, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg FROM m"


def eval_dataset_files(t):
    """Benchmark and documents as dataset files, read back; one report per document of the dataset."""
    from uuid import uuid4

    from evidar.session import shared_folder
    from evidar.sources import files

    docs = t("documents")
    spark = docs.sparkSession
    base = f"{shared_folder(spark)}/evidar/dataset-{uuid4().hex}"
    chunk = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("fileName"), (F.col("doc_id") % 120).cast("int").alias("number"), F.col("text").alias("text"))
    ids = F.array(F.col("doc_id").cast("string"))
    case = F.struct(
        F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("documentId"), F.lit("detail").alias("category"), F.lit("qa").alias("mode"),
        F.col("lang").alias("question"), ids.alias("relevantChunkIds"), (F.col("doc_id") % 3 == 0).alias("shouldRefuse"))
    # One dataset a document: a file is read by one task, so none holds a whole source.
    dataset = docs.select(
        F.col("source").alias("name"), F.create_map(F.col("lang"), F.lit(0.5)).alias("priorities"),
        F.array(F.struct(F.col("source").alias("id"), F.array(chunk).alias("chunks"))).alias("documents"), F.array(case).alias("cases"),
        F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("expected"), F.col("source").alias("actual"))).alias("ocrSamples"))
    dataset.write.json(f"{base}/in")
    parts = files.read_eval(spark, f"{base}/in", lines=True)
    sizes = parts["chunks"].groupBy("collection_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))
    asked = parts["cases"].groupBy("collection_id").agg(F.count_if("should_refuse").alias("refused"), F.min("query_id").alias("first_case"))
    samples = parts["ocr_samples"].groupBy(F.col("actual").alias("collection_id")).agg(F.count_distinct("expected").alias("languages"))
    files.write_report(sizes.join(asked, "collection_id").join(samples, "collection_id"), f"{base}/report")
    return spark.read.schema("collection_id string, chunks bigint, chars bigint, refused bigint, first_case string, languages bigint").json(f"{base}/report")


QUERIES["eval_dataset_files"] = tables(eval_dataset_files)
ORACLES["eval_dataset_files"] = """
SELECT source AS collection_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, count(*) FILTER (doc_id % 3 = 0) AS refused,
  min('case-' || doc_id) AS first_case, count(DISTINCT lang) AS languages FROM documents GROUP BY source
"""


def category_scores(t):
    return E.category_scores(_metrics(t)).select("category", "cases", "overall", *ROUND("score", "recall", "mrr", "ndcg"))


QUERIES["category_scores"] = tables(category_scores)
ORACLES["category_scores"] = f"WITH {METRICS_SQL} SELECT category, cases, overall, round(score, 4) AS score, round(recall, 4) AS recall, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg FROM sc"


def quality_gates(t):
    scores = E.category_scores(_metrics(t))
    weighted = E.weighted_score(scores.filter("overall = 0")).withColumn("weighted_score", F.round("weighted_score", 4))
    gates = E.quality_gates(scores, E.char_accuracy(_ocr_samples(t)))
    one = F.lit(1).alias("one")
    return gates.select("*", one).join(weighted.select("*", one), "one").drop("one")


def _ocr_samples(t):
    """A turn as expected text; every third one lost its vowels in the actual text."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return t("conversations").select(
        "conv_id", "turn", plain.alias("expected"),
        F.when(F.col("turn") % 3 == 2, F.regexp_replace(plain, "[aeiou]", "")).otherwise(F.upper(plain)).alias("actual"))


SAMPLES_SQL = f"""
o AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS plain FROM conversations),
p AS (SELECT conv_id, turn, {COMPARABLE.format(x='plain')} AS r, {COMPARABLE.format(x="CASE WHEN turn % 3 = 2 THEN regexp_replace(plain, '[aeiou]', '', 'g') ELSE upper(plain) END")} AS l FROM o),
acc AS (SELECT conv_id, turn, CASE WHEN r = '' THEN CASE WHEN l = '' THEN 1 ELSE 0 END ELSE greatest(0, 1 - levenshtein(l, r) / greatest(length(l), length(r), 1)) END::DOUBLE AS accuracy FROM p)
"""
QUERIES["quality_gates"] = tables(quality_gates)
ORACLES["quality_gates"] = f"""
WITH {METRICS_SQL}, {SAMPLES_SQL},
w AS (SELECT round(sum(score * wt) / sum(wt), 4) AS weighted_score FROM sc JOIN (VALUES ('overview', 0.30::DOUBLE), ('detail', 0.25), ('visual', 0.20), ('review', 0.15), ('comparison', 0.10)) v(category, wt) USING (category) WHERE overall = 0)
SELECT max(recall) FILTER (overall = 1) >= 0.85 AS recall_gate, max(mrr) FILTER (overall = 1) >= 0.75 AS mrr_gate, min(score) FILTER (overall = 0) >= 0.75 AS category_gate,
  (SELECT avg(accuracy) >= 0.9 FROM acc) AS ocr_gate, (SELECT weighted_score FROM w) AS weighted_score FROM sc
"""


def char_accuracy(t):
    return E.char_accuracy(_ocr_samples(t)).select("conv_id", "turn", F.round("accuracy", 4).alias("accuracy"))


QUERIES["char_accuracy"] = tables(char_accuracy)
ORACLES["char_accuracy"] = f"WITH {SAMPLES_SQL} SELECT conv_id, turn, round(accuracy, 4) AS accuracy FROM acc"


def citation_precision(t):
    claims = t("lineitem").select(F.col("l_suppkey").alias("answer_id"), F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("source_id"))
    sources = t("lineitem").filter("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("answer_id"), F.col("l_partkey").alias("source_id"))
    return E.citation_precision(claims, sources).withColumn("precision", F.round("precision", 4))


QUERIES["citation_precision"] = tables(citation_precision)
ORACLES["citation_precision"] = """
WITH s AS (SELECT DISTINCT l_suppkey, l_partkey, TRUE AS known FROM lineitem WHERE l_returnflag <> 'R'),
c AS (SELECT l_suppkey, l_orderkey, bool_and(coalesce(known, FALSE)) AS ok FROM lineitem LEFT JOIN s USING (l_suppkey, l_partkey) GROUP BY ALL)
SELECT count(*) AS cited_claims, count(*) FILTER (ok) AS valid_claims, round(avg(ok::INTEGER::DOUBLE), 4) AS precision FROM c
"""


def valid_citations(t):
    claims = t("lineitem").groupBy(F.col("l_orderkey").alias("answer_id")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey")))["l_suppkey"].alias("citations")).withColumn("claim_id", F.lit("c"))
    sources = t("lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("answer_id"), F.col("l_suppkey").alias("source_id"))
    kept = E.valid_citations(claims, sources)
    return kept.select("answer_id", F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("citations"))


QUERIES["valid_citations"] = tables(valid_citations)
ORACLES["valid_citations"] = """
WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
k AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS pos FROM lineitem JOIN s USING (l_orderkey, l_suppkey) GROUP BY ALL),
a AS (SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY pos, l_suppkey) AS c FROM k GROUP BY ALL)
SELECT o.l_orderkey AS answer_id, coalesce(c, '') AS citations FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN a USING (l_orderkey)
"""


def refusal_accuracy(t):
    results = t("labels").select((F.col("toxic") == 1).alias("refused"), (F.col("quality") == 0).alias("should_refuse"))
    return E.refusal_accuracy(results).withColumn("accuracy", F.round("accuracy", 4))


QUERIES["refusal_accuracy"] = tables(refusal_accuracy)
ORACLES["refusal_accuracy"] = "SELECT count(*) AS cases, round(avg(((toxic = 1) = (quality = 0))::INTEGER::DOUBLE), 4) AS accuracy FROM labels"


def clean_eval_cases(t):
    k = F.col("doc_id")
    names = F.array(*map(F.lit, [*CATEGORY, "unanswerable", "other"]))
    raw = t("documents").select(
        F.col("source").alias("document_id"), k.alias("position"), F.element_at(names, (k % 7 + 1).cast("int")).alias("category"),
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" q"), k.cast("string"), F.lit(" "))).alias("question"), F.lit("").alias("reference_answer"),
        F.array((k + 1).cast("string"), k.cast("string"), k.cast("string")).alias("relevant_ids"), (k % 5 == 0).alias("should_refuse"),
        F.element_at(F.array(F.lit("easy"), F.lit("odd")), (k % 2 + 1).cast("int")).alias("difficulty"))
    allowed = t("documents").filter("lang <> 'fr'").select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"))
    out = E.clean_eval_cases(raw, allowed)
    return out.select("document_id", "case_id", "category", "mode", "question", F.array_join("relevant_ids", ",").alias("relevant_ids"), "should_refuse", "difficulty")


QUERIES["clean_eval_cases"] = tables(clean_eval_cases)
ORACLES["clean_eval_cases"] = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
c AS (SELECT *, ['overview', 'detail', 'visual', 'review', 'comparison', 'unanswerable', 'detail'][doc_id % 7 + 1] AS category, doc_id % 7 = 5 OR doc_id % 5 = 0 AS refuse,
  concat_ws(',', (SELECT d.doc_id::VARCHAR FROM documents d WHERE d.doc_id = f.doc_id + 1 AND d.source = f.source AND d.lang <> 'fr'), CASE WHEN lang <> 'fr' THEN doc_id::VARCHAR END) AS ids FROM f)
SELECT source AS document_id, source[1:8] || '-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS case_id, category,
  CASE category WHEN 'review' THEN 'review' WHEN 'overview' THEN 'explain' ELSE 'qa' END AS mode, 'q' || doc_id AS question, CASE WHEN refuse THEN '' ELSE ids END AS relevant_ids,
  refuse AS should_refuse, CASE WHEN doc_id % 2 = 0 THEN 'easy' ELSE 'medium' END AS difficulty FROM c WHERE doc_id % 11 <> 0 AND (refuse OR ids <> '')
"""
