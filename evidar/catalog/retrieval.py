"""Registered queries: lexical statistics, hybrid retrieval and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.catalog.common import CHUNKS_SQL, document_chunks, norm, tables, tokens, trim
from evidar.functions.text import token_jaccard, tokenize
from evidar.operators import blockmax, hybrid, lexical, nearest, ranking, selection, similar
from evidar.plans import retrieval

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Questions: every benchmark text, its sentences turned into question parts, with
# a hint at a type and page in front; the mode goes round.
PREFIXES = ["", "Show table on 12 slide? ", "Show code on 3 slide? ", "List items from 70 slide? "]
MODES = ["qa", "qa", "quiz", "explain", "qa"]


def questions(t, vectors: bool = False):
    base = t("benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("corpus").alias("collection_id"),
        F.element_at(F.array(*map(F.lit, MODES)), (F.col("item_id") % len(MODES) + 1).cast("int")).alias("mode"),
        F.concat(
            F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("item_id") % len(PREFIXES) + 1).cast("int")),
            F.regexp_replace("text", r"\. ", "? "),
        ).alias("text"),
    )
    if not vectors:
        return base
    vecs = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return base.join(vecs, "query_id", "left")


def vector_chunks(t):
    vecs = t("embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return document_chunks(t).join(vecs, "chunk_id", "left")


def plain_questions(t):
    return t("benchmark").select(
        F.col("item_id").alias("query_id"), F.lit(0).alias("variant_pos"), F.lit("corpus").alias("collection_id"), "text")


SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

QUESTIONS_SQL = f"""
q AS (SELECT item_id AS query_id, {SQL_LIST(MODES)}[item_id % {len(MODES)} + 1] AS mode,
        {SQL_LIST(PREFIXES)}[item_id % {len(PREFIXES)} + 1] || regexp_replace(text, '\\. ', '? ', 'g') AS question FROM benchmark),
qn AS (SELECT query_id, mode, {norm('question')} AS question FROM q),
qp AS (SELECT query_id, mode, list_concat([question], list_filter(list_transform(
         regexp_split_to_array(question, '[？?；;。]'), lambda x: {norm('x')}), lambda x: length(x) >= 4)) AS parts FROM qn),
qv AS (SELECT query_id, mode, list_filter(parts, lambda x, i: list_position(parts, x) = i)[1:5] AS parts FROM qp),
v AS (SELECT query_id, mode, unnest(range(len(parts)))::INTEGER AS pos, unnest(parts) AS vtext FROM qv)
"""

PLAIN_SQL = "v AS (SELECT item_id AS query_id, 'qa' AS mode, 0 AS pos, text AS vtext FROM benchmark)"

INDEX_SQL = f"""
c AS ({CHUNKS_SQL}),
ctok AS (SELECT *, {tokens("title || chr(10) || text")} AS toks, {tokens('title')} AS ttoks FROM c),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM ctok) GROUP BY ALL),
dfreq AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM ctok)
"""

LEX_SQL = f"""
vt AS (SELECT query_id, pos, unnest(list_distinct({tokens('vtext')})) AS token FROM v),
vn AS (SELECT query_id, pos, count(*) AS nq, list(token) AS qtoks FROM vt GROUP BY ALL),
ls AS (SELECT query_id, pos, p.doc_id, count(*) AS m,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.4) / (tf + 1.4 * (0.25 + 0.75 * (len(toks) / greatest(avg_len, 1))))) AS s
       FROM vt JOIN post p USING (token) JOIN dfreq USING (token) JOIN ctok ON ctok.doc_id = p.doc_id CROSS JOIN st GROUP BY ALL),
lx AS (SELECT v.query_id, v.mode, v.pos, v.vtext, nq, qtoks, ctok.*,
         round(coalesce(s, 0) + CASE WHEN length({norm('vtext')}) >= 4 AND contains(lower(text), lower({norm('vtext')})) THEN 3 ELSE 0 END, 6) AS lexical_score,
         round(coalesce(m, 0) / nq, 6) AS token_coverage
       FROM v JOIN vn USING (query_id, pos) CROSS JOIN ctok LEFT JOIN ls ON ls.query_id = v.query_id AND ls.pos = v.pos AND ls.doc_id = ctok.doc_id)
"""


def _hybrid_sql(vectors: bool) -> str:
    if vectors:
        cos = ("CASE WHEN pos = 0 THEN coalesce(list_cosine_similarity(qe.embedding::DOUBLE[], ce.embedding::DOUBLE[]), 0) ELSE 0 END")
        joins = "LEFT JOIN embeddings qe ON qe.vec_id = query_id LEFT JOIN embeddings ce ON ce.vec_id = doc_id"
        has = "pos = 0 AND qe.embedding IS NOT NULL"
    else:
        cos, joins, has = "0.0::DOUBLE", "", "FALSE"
    return f"""
lv AS (SELECT lx.*, {cos} AS cos, {has} AS has_vec, max(lexical_score) OVER (PARTITION BY query_id, pos) AS best,
         CASE WHEN list_has_any(qtoks, ttoks) THEN 0.08 ELSE 0 END::DOUBLE
         + CASE WHEN content_type = (CASE WHEN regexp_matches(vtext, '(?i)figure|chart|graph|diagram|image') THEN 'visual'
              WHEN regexp_matches(vtext, '(?i)table') THEN 'table' WHEN regexp_matches(vtext, '(?i)code') THEN 'code' END)
              THEN 0.08 ELSE 0 END::DOUBLE
         + CASE WHEN number = try_cast(nullif(regexp_extract(vtext, '(?i)(\\d{{1,3}})\\s*(?:页|幻灯片|slide)', 1), '') AS INTEGER) THEN 0.14 ELSE 0 END::DOUBLE AS boost
       FROM lx {joins}),
hy AS (SELECT *, round(cos, 6) AS vector_score,
         round((CASE WHEN best > 0 THEN lexical_score / best ELSE 0 END * CASE WHEN has_vec THEN 0.5 ELSE 1 END::DOUBLE
           + CASE WHEN has_vec THEN greatest(cos, 0) * 0.42::DOUBLE ELSE 0 END + boost) * reliability, 6) AS hybrid_score FROM lv),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY hybrid_score DESC, chunk_ordinal) AS r FROM hy),
cr AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + r)) AS credit FROM rk WHERE r <= 80 GROUP BY ALL),
cs AS (SELECT query_id, doc_id, credit / greatest(max(credit) OVER (PARTITION BY query_id), 0.0001) AS share FROM cr),
fused AS (SELECT hy.*, round(coalesce(share, 0), 6) AS rrf_score,
            round(hybrid_score * 0.72::DOUBLE + coalesce(share, 0) * 0.28::DOUBLE, 6) AS score
          FROM hy LEFT JOIN cs USING (query_id, doc_id) WHERE pos = 0)
"""


# ---- corpus statistics -------------------------------------------------------
def document_frequency(t):
    index = lexical.build_index(document_chunks(t, "source"))
    return index.postings.groupBy("collection_id", "token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf_sum"))


QUERIES["document_frequency"] = tables(document_frequency)
ORACLES["document_frequency"] = f"""
WITH {INDEX_SQL}, x AS (SELECT source, doc_id, unnest(toks) AS token FROM ctok)
SELECT source AS collection_id, token, count(DISTINCT doc_id) AS df, count(*) AS tf_sum FROM x GROUP BY ALL
"""


def collection_stats(t):
    _, _, stats = lexical.corpus_stats(document_chunks(t, "source"))
    return stats.select("collection_id", "n", F.round("avg_len", 4).alias("avg_len"))


QUERIES["corpus_stats"] = tables(collection_stats)
ORACLES["corpus_stats"] = f"""
WITH {INDEX_SQL} SELECT source AS collection_id, count(*) AS n, round(avg(len(toks)), 4) AS avg_len FROM ctok GROUP BY ALL
"""


# ---- lexical scores ----------------------------------------------------------
def bm25_topk(t):
    chunks = document_chunks(t)
    scored = lexical.bm25(plain_questions(t), chunks, lexical.build_index(chunks))
    best = ranking.rank_hits(scored, 10, "lexical_score")
    return best.select("query_id", "chunk_id", "lexical_score", "token_coverage", "rank")


QUERIES["bm25_topk"] = tables(bm25_topk)
ORACLES["bm25_topk"] = f"""
WITH {INDEX_SQL}, {PLAIN_SQL}, {LEX_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_ordinal)::INTEGER AS rank FROM lx WHERE lexical_score > 0)
SELECT query_id, doc_id::VARCHAR AS chunk_id, lexical_score, token_coverage, rank FROM r WHERE rank <= 10
"""


def bm25_block_topk(t):
    chunks = document_chunks(t)
    index = lexical.build_index(chunks)
    best, _ = blockmax.top_hits(plain_questions(t), chunks, index, blockmax.build_blocks(index), 10)
    return best.select("query_id", "chunk_id", "lexical_score", "token_coverage", "rank")


QUERIES["bm25_block_topk"] = tables(bm25_block_topk)
ORACLES["bm25_block_topk"] = ORACLES["bm25_topk"]


def phrase_bonus(t):
    chunks = document_chunks(t)
    hits = lexical.phrase_hits(plain_questions(t), chunks, lexical.build_index(chunks))
    return hits.select("query_id", "chunk_id")


QUERIES["phrase_bonus"] = tables(phrase_bonus)
ORACLES["phrase_bonus"] = f"""
WITH p AS (SELECT item_id, lower({norm('text')}) AS phrase FROM benchmark)
SELECT item_id AS query_id, doc_id::VARCHAR AS chunk_id FROM p, documents WHERE length(phrase) >= 4 AND contains(lower(text), phrase)
"""


def query_variants(t):
    return hybrid.expand_queries(questions(t)).select("query_id", "mode", "variant_pos", "text")


QUERIES["expand_queries"] = tables(query_variants)
ORACLES["expand_queries"] = f"WITH {QUESTIONS_SQL} SELECT query_id, mode, pos AS variant_pos, vtext AS text FROM v"


# ---- vectors -----------------------------------------------------------------
def cosine_topk(t):
    chunks = vector_chunks(t).withColumn("reliability", F.lit(1.0)).withColumn("number", F.lit(0))
    asked = questions(t, vectors=True).filter(F.col("embedding").isNotNull()).withColumn(
        "want_type", F.lit(None).cast("string")).withColumn("want_page", F.lit(None).cast("int"))
    near = hybrid.vector_candidates(asked, chunks, 10)
    scored = hybrid.score_vectors(asked, chunks, near).join(chunks.select("chunk_id", "chunk_ordinal"), "chunk_id")
    best = ranking.rank_hits(scored.filter("vector_score > 0"), 10, "vector_score")
    return best.select("query_id", "chunk_id", "vector_score", "rank")


QUERIES["cosine_topk"] = tables(cosine_topk)
ORACLES["cosine_topk"] = """
WITH s AS (SELECT item_id AS query_id, doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cos
           FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN documents JOIN embeddings e ON e.vec_id = doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id)::INTEGER AS rank FROM s WHERE cos > 0)
SELECT query_id, doc_id::VARCHAR AS chunk_id, cos AS vector_score, rank FROM r WHERE rank <= 10
"""


def vector_topk(t):
    asked = questions(t, vectors=True).select("query_id", "collection_id", "embedding")
    found, _ = nearest.top_vectors(asked, nearest.build_vector_index(vector_chunks(t)), 10)
    return found.filter("vector_score > 0").select("query_id", "chunk_id", "vector_score", "rank")


QUERIES["vector_topk"] = tables(vector_topk)
ORACLES["vector_topk"] = ORACLES["cosine_topk"]


# ---- hybrid and fusion -------------------------------------------------------
SCORES = ["lexical_score", "token_coverage", "vector_score", "hybrid_score", "rrf_score", "score"]
SCORES_SQL = ", ".join(SCORES)


def _top_fused(t, vectors: bool):
    chunks = vector_chunks(t) if vectors else document_chunks(t)
    hits = retrieval.fused_hits(questions(t, vectors), chunks, keep=40)
    best = ranking.rank_hits(hits.filter("hybrid_score > 0"), 40)
    return best.select("query_id", "chunk_id", *SCORES, "rank")


def _fused_oracle(vectors: bool) -> str:
    return f"""
WITH {INDEX_SQL}, {QUESTIONS_SQL}, {LEX_SQL}, {_hybrid_sql(vectors)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ordinal)::INTEGER AS rank FROM fused WHERE hybrid_score > 0)
SELECT query_id, doc_id::VARCHAR AS chunk_id, {SCORES_SQL}, rank FROM r WHERE rank <= 40
"""


QUERIES["rrf_fusion"] = tables(lambda t: _top_fused(t, False))
ORACLES["rrf_fusion"] = _fused_oracle(False)
QUERIES["hybrid_scores"] = tables(lambda t: _top_fused(t, True))
ORACLES["hybrid_scores"] = _fused_oracle(True)


# ---- gates and selection -----------------------------------------------------
GATED_SQL = """
gated AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ordinal)::INTEGER AS rank FROM fused
          WHERE (lexical_score >= 0.28 AND token_coverage >= 0.18) OR (has_vec AND vector_score >= 0.42) QUALIFY rank <= {k})
"""


def qa_gate(t):
    hits = retrieval.fused_hits(questions(t, True), vector_chunks(t), keep=12)
    return selection.qa_gate(hits, 12).select("query_id", "chunk_id", "score", "rank")


QUERIES["qa_gate"] = tables(qa_gate)
ORACLES["qa_gate"] = f"""
WITH {INDEX_SQL}, {QUESTIONS_SQL}, {LEX_SQL}, {_hybrid_sql(True)}, {GATED_SQL.format(k=12)}
SELECT query_id, doc_id::VARCHAR AS chunk_id, score, rank FROM gated
"""


def context_fill(t):
    asked = questions(t).withColumn("mode", F.lit("quiz"))
    chunks = document_chunks(t)
    hits = retrieval.fused_hits(asked, chunks, keep=100)
    return selection.context_fill(hits, asked, chunks, 100).select("query_id", "chunk_id", "score", "rank")


QUERIES["context_fill"] = tables(context_fill)
ORACLES["context_fill"] = f"""
WITH {INDEX_SQL}, {QUESTIONS_SQL}, {LEX_SQL}, {_hybrid_sql(False)},
best AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ordinal) AS o
         FROM fused WHERE hybrid_score > 0 QUALIFY o <= 100),
n AS (SELECT count(*) AS n FROM c),
slots AS (SELECT i, floor(i * (n - 1) / 99.0::DOUBLE + 0.5)::BIGINT AS pos_at FROM n, range(100) r(i)),
spread AS (SELECT doc_id, CASE WHEN n <= 100 THEN doc_id ELSE i END AS i FROM c, n LEFT JOIN slots ON pos_at = doc_id WHERE n <= 100 OR i IS NOT NULL),
fill AS (SELECT query_id, doc_id, 0.0::DOUBLE AS score, 101 + i AS o FROM (SELECT DISTINCT query_id FROM v) qs CROSS JOIN spread
         WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = qs.query_id AND b.doc_id = spread.doc_id)),
u AS (SELECT * FROM best UNION ALL SELECT * FROM fill)
SELECT query_id, doc_id::VARCHAR AS chunk_id, score,
       row_number() OVER (PARTITION BY query_id ORDER BY o)::INTEGER AS rank FROM u QUALIFY rank <= 100
"""


def turn_chunks(t):
    """Conversation turns as chunks, one collection per conversation."""
    turns = t("conversations").select(
        F.col("conv_id").cast("string").alias("collection_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.col("turn"), F.concat(F.lit("file-"), F.floor(F.col("turn") / 3).cast("string")).alias("file_name"),
        F.lit("page").alias("kind"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("number"), "role", "text",
    )
    return ranking.with_ordinals(turns, "turn")


TURNS_SQL = """
turns AS (SELECT conv_id::VARCHAR AS collection_id, concat_ws('-', conv_id, turn) AS chunk_id, turn,
            'file-' || (turn // 3) AS file_name, (turn // 2 + 1)::INTEGER AS number, role, text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_ordinal FROM conversations)
"""


def neighbours(t):
    chunks = turn_chunks(t)
    hits = chunks.filter(F.col("role") == "system").select(
        F.col("collection_id").alias("query_id"), "collection_id", "chunk_id", "chunk_ordinal", "file_name",
        F.lit(1).alias("rank"), F.lit(0.5).alias("score"))
    longest = ranking.top_k(chunks.filter(F.col("role") != "system"), ["collection_id"],
                            [F.length("text").desc(), F.col("turn")], 3, "_r")
    hits = longest.select(F.col("collection_id").alias("query_id"), "collection_id", "chunk_id", "chunk_ordinal", "file_name",
                          F.col("_r").alias("rank"), (1.0 / F.col("_r")).alias("score"))
    out = selection.expand_neighbours(hits, chunks, 5)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"), "adjacent")


QUERIES["expand_neighbours"] = tables(neighbours)
ORACLES["expand_neighbours"] = f"""
WITH {TURNS_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY length(text) DESC, turn)::INTEGER AS rank
      FROM turns WHERE role <> 'system' QUALIFY rank <= 3),
w AS (SELECT h.collection_id, n.chunk_id, rank, step, 1.0::DOUBLE / rank * 0.72::DOUBLE AS score
      FROM h CROSS JOIN (VALUES (-1), (1)) s(step) JOIN turns n ON n.collection_id = h.collection_id
        AND n.chunk_ordinal = h.chunk_ordinal + step AND n.file_name = h.file_name
      WHERE NOT EXISTS (SELECT 1 FROM h h2 WHERE h2.chunk_id = n.chunk_id)
      QUALIFY row_number() OVER (PARTITION BY h.collection_id, n.chunk_id ORDER BY rank, step) = 1),
a AS (SELECT w.*, (SELECT count(*) FROM h WHERE h.collection_id = w.collection_id)
        + row_number() OVER (PARTITION BY w.collection_id ORDER BY rank, step) AS slot FROM w)
SELECT collection_id AS query_id, chunk_id, rank, round(1.0::DOUBLE / rank, 4) AS score, FALSE AS adjacent FROM h
UNION ALL SELECT collection_id, chunk_id, slot::INTEGER, round(score, 4), TRUE FROM a WHERE slot <= 5
"""


def evenly_spaced(t):
    return ranking.evenly_spaced(turn_chunks(t), ["collection_id"], "chunk_ordinal", 4).select("collection_id", "chunk_id", "slot")


QUERIES["evenly_spaced"] = tables(evenly_spaced)
ORACLES["evenly_spaced"] = f"""
WITH {TURNS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY collection_id) AS n FROM turns)
SELECT collection_id, chunk_id, chunk_ordinal AS slot FROM n WHERE n <= 4
UNION ALL SELECT collection_id, chunk_id, i FROM n JOIN range(4) r(i) ON floor(i * (n - 1) / 3.0::DOUBLE + 0.5) = chunk_ordinal WHERE n > 4
"""


def first_per_locator(t):
    return ranking.first_per_locator(turn_chunks(t), ["turn"]).select("collection_id", "file_name", "number", "chunk_id")


QUERIES["first_per_locator"] = tables(first_per_locator)
ORACLES["first_per_locator"] = f"""
WITH {TURNS_SQL} SELECT collection_id, file_name, number, arg_min(chunk_id, turn) AS chunk_id FROM turns GROUP BY ALL
"""


def adjacent_jaccard(t):
    """U1b on neighbouring chunks of a collection."""
    from evidar.operators.slices import carry

    sets = turn_chunks(t).select("collection_id", "chunk_id", "chunk_ordinal", F.array_distinct(tokenize("text")).alias("tokens"))
    paired = carry(sets, ["collection_id"], None, ["chunk_ordinal"],
                   following={"next_tokens": F.col("tokens"), "next_id": F.col("chunk_id")})
    return paired.filter("next_id IS NOT NULL").select(
        "chunk_id", "next_id", F.round(token_jaccard(F.col("tokens"), F.col("next_tokens")), 4).alias("jaccard"))


QUERIES["token_jaccard"] = tables(adjacent_jaccard)
ORACLES["token_jaccard"] = f"""
WITH {TURNS_SQL}, s AS (SELECT *, list_distinct({tokens('text')}) AS tok FROM turns),
p AS (SELECT chunk_id, tok, lead(chunk_id) OVER w AS next_id, lead(tok) OVER w AS next_tok FROM s WINDOW w AS (PARTITION BY collection_id ORDER BY turn)),
z AS (SELECT chunk_id, next_id, len(list_intersect(tok, next_tok)) AS i, len(list_distinct(list_concat(tok, next_tok))) AS u FROM p WHERE next_id IS NOT NULL)
SELECT chunk_id, next_id, round(CASE WHEN u = 0 THEN 0 ELSE i / u END, 4) AS jaccard FROM z
"""


def document_coverage(t):
    chunks = document_chunks(t, "source").withColumn("chunk_id", F.lpad("chunk_id", 8, "0"))
    return selection.document_coverage(chunks).select("collection_id", "chunk_id", "rank")


QUERIES["document_coverage"] = tables(document_coverage)


def retrieve_evidence(t):
    asked = questions(t, vectors=True)
    return retrieval.retrieve(asked, vector_chunks(t)).select(
        "query_id", "mode", "chunk_id", F.col("rank").cast("int").alias("rank"), "score", "adjacent", "strategy")


QUERIES["retrieve_evidence"] = tables(retrieve_evidence)


# ---- selection on conversation turns --------------------------------------------
def _turn_hits(t):
    """Every turn as a hit of its conversation; longer turns rank first."""
    chunks = turn_chunks(t).withColumn("content_type", F.col("role"))
    order = [F.length("text").desc(), F.col("turn")]
    hits = ranking.top_k(chunks, ["collection_id"], order, 40)
    return chunks, hits.select(
        F.col("collection_id").alias("query_id"), "collection_id", "chunk_id", "chunk_ordinal", "file_name", "number", "content_type", "turn",
        F.when(F.col("turn") % 2 == 0, "qa").otherwise("explain").alias("mode"), (1.0 / F.col("rank")).alias("score"), "rank")


TURN_HITS_SQL = f"""
{TURNS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY length(text) DESC, turn)::INTEGER AS rank FROM turns)
"""


def mmr_select(t):
    chunks, hits = _turn_hits(t)
    return selection.mmr_select(hits, chunks, 4).select("query_id", "chunk_id", "rank")


QUERIES["mmr_select"] = tables(mmr_select)
ORACLES["mmr_select"] = f"""
WITH RECURSIVE {TURN_HITS_SQL},
k AS (SELECT collection_id AS q, chunk_id, rank, 1.0::DOUBLE / rank AS rel, number || '|' || role AS place, list_distinct({tokens('text')}) AS tok, count(*) OVER (PARTITION BY collection_id) AS n FROM h),
sim AS (SELECT a.q, a.chunk_id AS a, b.chunk_id AS b, a.place = b.place AS same,
  CASE WHEN len(list_distinct(list_concat(a.tok, b.tok))) = 0 THEN 0 ELSE len(list_intersect(a.tok, b.tok)) / len(list_distinct(list_concat(a.tok, b.tok))) END AS j FROM k a JOIN k b ON a.q = b.q AND a.chunk_id <> b.chunk_id),
near AS (SELECT q, a, list({{'b': b, 'j': j, 'same': same}}) AS others FROM sim GROUP BY ALL),
r(q, step, chosen) AS (
  SELECT DISTINCT q, 0, []::VARCHAR[] FROM k WHERE n > 4
  UNION ALL
  SELECT q, step + 1, list_append(any_value(chosen), arg_max(chunk_id, (value, -rank))) FROM (
    SELECT r.q, step, chosen, k.chunk_id, k.rank, rel * 0.82::DOUBLE - 0.16::DOUBLE * coalesce(list_max(list_transform(list_filter(others, lambda o: list_contains(chosen, o.b)), lambda o: o.j)), 0)
        - CASE WHEN len(list_filter(others, lambda o: o.same AND list_contains(chosen, o.b))) > 0 THEN 0.08 ELSE 0 END::DOUBLE AS value
    FROM r JOIN k ON k.q = r.q LEFT JOIN near ON near.q = k.q AND near.a = k.chunk_id WHERE step < 4 AND NOT list_contains(chosen, k.chunk_id)) z GROUP BY q, step)
SELECT q AS query_id, unnest(chosen) AS chunk_id, unnest(range(1, 5))::INTEGER AS rank FROM r WHERE step = 4
UNION ALL SELECT q, chunk_id, rank FROM k WHERE n <= 4
"""


def rerank(t):
    _, hits = _turn_hits(t)
    scores = hits.filter("query_id <> '1'").select("query_id", "chunk_id", ((F.col("turn") * 37 % 11) / 20.0).alias("rerank_score"))
    return selection.rerank(hits, scores, 3).select("query_id", "chunk_id", "rank", F.round("rerank_score", 4).alias("rerank_score"))


QUERIES["rerank"] = tables(rerank)
ORACLES["rerank"] = f"""
WITH {TURN_HITS_SQL}, s AS (SELECT *, turn * 37 % 11 / 20.0::DOUBLE AS sc FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY sc DESC, rank)::INTEGER AS r FROM s WHERE collection_id <> '1')
SELECT collection_id AS query_id, chunk_id, r AS rank, round(sc, 4) AS rerank_score FROM b WHERE r <= 3 AND (turn % 2 = 1 OR sc >= 0.12)
UNION ALL SELECT collection_id, chunk_id, rank, NULL FROM s WHERE collection_id = '1'
"""

ORACLES["document_coverage"] = """
WITH RECURSIVE d AS (SELECT source AS c, lpad(doc_id::VARCHAR, 8, '0') AS id, doc_id % 120 + 1 AS number, length(text) AS n FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY number, id) AS pos, count(*) OVER (PARTITION BY c) AS cnt, sum(n) OVER (PARTITION BY c) AS total FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS fp FROM (SELECT *, row_number() OVER (PARTITION BY c, number ORDER BY pos) AS k FROM o WHERE cnt > 80 OR total > 60000) WHERE k = 1),
fn AS (SELECT *, count(*) OVER (PARTITION BY c) AS m FROM f),
e AS (SELECT c, id, n, fp AS slot FROM fn WHERE m <= 80 UNION ALL
  SELECT c, id, n, i FROM fn JOIN range(80) r(i) ON floor(i * (m - 1) / 79.0::DOUBLE + 0.5) = fp WHERE m > 80),
seq AS (SELECT c, id, n, row_number() OVER (PARTITION BY c ORDER BY part, slot) AS s FROM (SELECT c, id, n, 0 AS part, slot FROM e UNION ALL SELECT c, id, n, 1, pos FROM o WHERE cnt > 80 OR total > 60000)),
g(c, s, used, taken) AS (
  SELECT DISTINCT c, 0::BIGINT, 0::BIGINT, []::VARCHAR[] FROM seq
  UNION ALL SELECT c, s, CASE WHEN ok THEN used + n ELSE used END, CASE WHEN ok THEN list_append(taken, id) ELSE taken END
  FROM (SELECT g.c, g.used, g.taken, seq.s, seq.n, seq.id, len(taken) < 80 AND NOT list_contains(taken, seq.id) AND (len(taken) = 0 OR used + seq.n <= 60000) AS ok FROM g JOIN seq ON seq.c = g.c AND seq.s = g.s + 1) z),
last AS (SELECT c, arg_max(taken, s) AS taken FROM g GROUP BY c),
sel AS (SELECT o.* FROM o JOIN last ON last.c = o.c WHERE list_contains(taken, id) UNION ALL SELECT * FROM o WHERE cnt <= 80 AND total <= 60000)
SELECT c AS collection_id, id AS chunk_id, row_number() OVER (PARTITION BY c ORDER BY pos)::INTEGER AS rank FROM sel
"""


def _neighbours_sql(name: str, source: str, count: int, only: str) -> str:
    """``source(query_id, doc_id, source, score, rank)`` plus neighbours of the same file up to ``count``."""
    return f"""
{name}_w AS (SELECT p.query_id, n.doc_id, n.source, p.rank AS from_rank, step, p.score * 0.72::DOUBLE AS score
  FROM {source} p CROSS JOIN (VALUES (-1), (1)) s(step) JOIN documents n ON n.doc_id = p.doc_id + step AND n.source = p.source
  WHERE {only} AND NOT EXISTS (SELECT 1 FROM {source} x WHERE x.query_id = p.query_id AND x.doc_id = n.doc_id)
  QUALIFY row_number() OVER (PARTITION BY p.query_id, n.doc_id ORDER BY p.rank, step) = 1),
{name}_a AS (SELECT w.query_id, w.doc_id, w.source, w.score, z.n + row_number() OVER (PARTITION BY w.query_id ORDER BY from_rank, step) AS rank
  FROM {name}_w w JOIN (SELECT query_id, count(*) AS n FROM {source} GROUP BY ALL) z ON z.query_id = w.query_id),
{name} AS (SELECT query_id, doc_id, source, score, rank, FALSE AS adjacent FROM {source} UNION ALL SELECT query_id, doc_id, source, score, rank, TRUE FROM {name}_a WHERE rank <= {count})
"""


# Holds while every question that is not ``qa`` has at least 40 positive hits, so that no even fill is due.
ORACLES["retrieve_evidence"] = f"""
WITH RECURSIVE {INDEX_SQL}, {QUESTIONS_SQL}, {LEX_SQL}, {_hybrid_sql(True)},
prim AS MATERIALIZED (SELECT query_id, mode, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ordinal) AS rank FROM fused
  WHERE CASE WHEN mode = 'qa' THEN (lexical_score >= 0.28 AND token_coverage >= 0.18) OR (has_vec AND vector_score >= 0.42) ELSE hybrid_score > 0 END QUALIFY rank <= 40),
{_neighbours_sql('cand', 'prim', 40, "p.mode = 'qa'")},
k AS MATERIALIZED (SELECT query_id AS q, cand.doc_id, rank, score AS rel, cand.source, d.doc_id % 120 || '|' || lang AS place, list_distinct({tokens('text')}) AS tok, e.embedding::DOUBLE[] AS vec,
  count(*) OVER (PARTITION BY query_id) AS n FROM cand JOIN documents d ON d.doc_id = cand.doc_id LEFT JOIN embeddings e ON e.vec_id = cand.doc_id),
pairs AS (SELECT a.q, a.doc_id AS a, b.doc_id AS b, a.place = b.place AS same, a.vec AS av, b.vec AS bv, len(a.tok) + len(b.tok) AS total, len(list_intersect(a.tok, b.tok)) AS shared
  FROM k a JOIN k b ON a.q = b.q AND a.doc_id < b.doc_id),
half AS MATERIALIZED (SELECT q, a, b, same, CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN greatest(0, list_cosine_similarity(av, bv)) WHEN total = 0 THEN 0 ELSE shared / (total - shared) END AS j FROM pairs),
sim AS (SELECT q, a, b, same, j FROM half UNION ALL SELECT q, b, a, same, j FROM half),
near AS MATERIALIZED (SELECT q, a, list({{'b': b, 'j': j, 'same': same}}) AS others FROM sim GROUP BY ALL),
r(q, step, chosen) AS (
  SELECT DISTINCT q, 0, []::BIGINT[] FROM k WHERE n > 8
  UNION ALL
  SELECT q, step + 1, list_append(any_value(chosen), arg_max(doc_id, (value, -rank))) FROM (
    SELECT r.q, step, chosen, k.doc_id, k.rank, rel * 0.82::DOUBLE - 0.16::DOUBLE * coalesce(list_max(list_transform(list_filter(others, lambda o: list_contains(chosen, o.b)), lambda o: o.j)), 0)
        - CASE WHEN len(list_filter(others, lambda o: o.same AND list_contains(chosen, o.b))) > 0 THEN 0.08 ELSE 0 END::DOUBLE AS value
    FROM r JOIN k ON k.q = r.q LEFT JOIN near ON near.q = k.q AND near.a = k.doc_id WHERE step < 8 AND NOT list_contains(chosen, k.doc_id)) z GROUP BY q, step),
picks AS MATERIALIZED (SELECT q, unnest(chosen) AS doc_id, unnest(range(1, 9)) AS rank FROM r WHERE step = 8 UNION ALL SELECT q, doc_id, rank FROM k WHERE n <= 8),
pick AS (SELECT q AS query_id, picks.doc_id, k.source, k.rel AS score, picks.rank FROM picks JOIN k USING (q, doc_id)),
{_neighbours_sql('evid', 'pick', 10, "TRUE")}
SELECT evid.query_id, qn.mode, evid.doc_id::VARCHAR AS chunk_id, evid.rank::INTEGER AS rank, evid.score, evid.adjacent, 'ranked' AS strategy FROM evid JOIN qn USING (query_id)
"""


def token_jaccard_pairs(t):
    """Similar documents of a source; one row per pair of different token sets, and one per copy with its class."""
    classes, pairs = similar.token_jaccard_pairs(document_chunks(t, "source"), 0.8)
    copies = classes.where("chunk_id <> class_id").select("collection_id", F.col("class_id").alias("left_id"), F.col("chunk_id").alias("right_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copy"))
    return pairs.withColumn("copy", F.lit(False)).unionByName(copies).withColumn("similarity", F.round("similarity", 6))


QUERIES["token_jaccard_pairs"] = tables(token_jaccard_pairs)
ORACLES["token_jaccard_pairs"] = f"""
WITH x AS (SELECT source, doc_id::VARCHAR AS id, list_sort(list_distinct({tokens('text')})) AS toks FROM documents),
y AS (SELECT *, min(id) OVER (PARTITION BY source, toks) AS class FROM x WHERE len(toks) > 0),
p AS (SELECT a.source, a.id AS left_id, b.id AS right_id, len(list_intersect(a.toks, b.toks)) AS s, len(a.toks) + len(b.toks) AS n
      FROM y a JOIN y b ON a.source = b.source AND a.id < b.id AND a.id = a.class AND b.id = b.class
       AND least(len(a.toks), len(b.toks)) >= 0.8 * greatest(len(a.toks), len(b.toks)))
SELECT source AS collection_id, left_id, right_id, round(s / (n - s), 6) AS similarity, FALSE AS copy FROM p WHERE s >= 0.8 * (n - s)
UNION ALL SELECT source, class, id, 1.0::DOUBLE, TRUE FROM y WHERE id <> class
"""
