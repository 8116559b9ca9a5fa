"""Registered queries: claim attribution, generated answers and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidar.catalog.common import document_chunks, norm, tables, trim
from evidar.catalog.retrieval import plain_questions
from evidar.functions import terms as K
from evidar.functions import text as T
from evidar.functions.expr import let
from evidar.operators import answers as A
from evidar.operators import attribution as C
from evidar.operators import lexical
from evidar.session import saved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def stem_sql(w: str) -> str:
    numbers = " ".join(f"WHEN {w} = '{n}' THEN '{i}'" for i, n in enumerate(K.NUMBER_WORDS))
    return (
        f"CASE {numbers} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3) "
        f"WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def terms_sql(x: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN {_in(K.TERM_STOP_WORDS)})"
    return f"list_filter(list_transform({kept}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 2 OR regexp_matches(w, '^[0-9]+$'))"


def coverage_sql(claim: str, evidence: str) -> str:
    """Coverage of distinct claim terms by evidence terms."""
    veto = f"len(list_filter({claim}, lambda w: (regexp_matches(w, '^[0-9]+$') OR w IN {_in(K.CRITICAL_TERMS)}) AND NOT list_contains({evidence}, w))) > 0"
    hits = f"len(list_filter({claim}, lambda w: list_contains({evidence}, w)))"
    return f"CASE WHEN len({claim}) = 0 OR {veto} OR {hits} < 2 THEN 0 ELSE {hits} / len({claim}) END"


def attribution_terms(t):
    both = t("documents").select(F.col("doc_id").alias("id"), "text").unionByName(
        t("benchmark").select((-F.col("item_id") - 1).alias("id"), "text"))
    terms = K.attribution_terms("text")
    return both.select("id", F.size(terms).cast("bigint").alias("n"), F.md5(F.array_join(terms, " ")).alias("digest"))


QUERIES["attribution_terms"] = tables(attribution_terms)
ORACLES["attribution_terms"] = f"""
WITH b AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark),
x AS (SELECT id, {terms_sql('text')} AS terms FROM b)
SELECT id, len(terms)::BIGINT AS n, md5(array_to_string(terms, ' ')) AS digest FROM x
"""


# Claims: sentences of assistant turns. Evidence: all sentences of the same conversation.
def _claims(t):
    return t("conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("answer_id"), "turn", F.posexplode(F.split(T.normalize_ws("text"), r"\.")).alias("pos", "text"),
    ).filter("text <> ''").select(
        "answer_id", F.concat_ws("-", F.lit("claim"), F.col("turn").cast("string"), F.col("pos").cast("string")).alias("claim_id"), "text")


def _anchors(t):
    turns = t("conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        F.posexplode(F.split(T.normalize_ws("text"), r"\.")).alias("pos", "exact_quote"))
    return turns.filter("exact_quote <> ''").select(
        F.concat_ws("-", "chunk_id", F.lpad(F.col("pos").cast("string"), 6, "0")).alias("anchor_id"), "chunk_id", "exact_quote")


def _hits(t):
    turns = t("conversations").select("conv_id", F.col("turn").alias("other"))
    return _claims(t).join(turns, F.col("answer_id") == F.col("conv_id")).select(
        "answer_id", "claim_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("other").cast("string")).alias("chunk_id"),
        F.col("other").alias("rank"))


CLAIMS_SQL = f"""
sent AS (SELECT conv_id, turn, role, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS quote FROM (SELECT conv_id, turn, role, string_split({norm('text')}, '.') AS s FROM conversations)),
claims AS (SELECT conv_id AS answer_id, 'claim-' || turn || '-' || pos AS claim_id, quote AS text FROM sent WHERE role = 'assistant' AND quote <> ''),
anchors AS (SELECT conv_id, turn, conv_id || '-' || turn || '-' || lpad(pos::VARCHAR, 6, '0') AS anchor_id, quote FROM sent WHERE quote <> ''),
pairs AS (SELECT answer_id, claim_id, anchor_id, turn, c.text, quote,
   len(list_filter(regexp_extract_all(lower(quote), '[a-z0-9]+'), lambda w: list_contains(regexp_extract_all(lower(c.text), '[a-z0-9]+'), w))) AS overlap
   FROM claims c JOIN anchors a ON a.conv_id = c.answer_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY overlap DESC, turn, anchor_id)::INTEGER AS rank FROM pairs QUALIFY rank <= 4),
cand AS (SELECT answer_id, claim_id, any_value(text) AS text, list(anchor_id ORDER BY rank) AS ids, list({terms_sql('quote')} ORDER BY rank) AS tl FROM ranked GROUP BY ALL)
"""


def rank_anchors(t):
    return C.rank_anchors(_claims(t), _hits(t), _anchors(t)).select("answer_id", "claim_id", "anchor_id", F.col("overlap").cast("bigint").alias("overlap"), "rank")


QUERIES["rank_anchors"] = tables(rank_anchors)
ORACLES["rank_anchors"] = f"WITH {CLAIMS_SQL} SELECT answer_id, claim_id, anchor_id, overlap::BIGINT AS overlap, rank FROM ranked"


def direct_coverage(t):
    # Terms of a quote are taken once, not for every claim that meets it.
    quotes = _hits(t).join(_anchors(t).withColumn("terms", F.array_distinct(K.attribution_terms("exact_quote"))), "chunk_id")
    return C.direct_coverage(_claims(t), quotes).select("answer_id", "claim_id", F.round("coverage", 4).alias("coverage"))


QUERIES["direct_coverage"] = tables(direct_coverage)
ORACLES["direct_coverage"] = f"""
WITH {CLAIMS_SQL},
e AS (SELECT answer_id, claim_id, any_value(text) AS text, flatten(list({terms_sql('quote')})) AS ev FROM pairs GROUP BY ALL),
c AS (SELECT answer_id, claim_id, list_distinct({terms_sql('text')}) AS ct, ev FROM e)
SELECT answer_id, claim_id, round({coverage_sql('ct', 'ev')}, 4)::DOUBLE AS coverage FROM c
"""


def _candidates(t):
    return C.candidates(_claims(t), C.rank_anchors(_claims(t), _hits(t), _anchors(t)), _anchors(t))


def subset_cover(t):
    return C.subset_cover(_candidates(t)).select(
        "answer_id", "claim_id", F.array_join("anchor_ids", ",").alias("anchor_ids"), F.round("coverage", 4).alias("coverage"))


QUERIES["subset_cover"] = tables(subset_cover)
SUBSET_SQL = f"""
m AS (SELECT answer_id, claim_id, text, mask, list_filter(ids, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS chosen,
  flatten(list_filter(tl, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS ev FROM cand, range(1, 16) r(mask) WHERE mask < (1 << len(ids))),
mc AS (SELECT *, list_distinct({terms_sql('text')}) AS ct FROM m WHERE len(chosen) <= 3),
mv AS (SELECT answer_id, claim_id, mask, chosen, {coverage_sql('ct', 'ev')} AS coverage FROM mc),
cover AS (SELECT answer_id, claim_id, array_to_string(chosen, ',') AS anchor_ids, coverage FROM mv WHERE coverage >= 0.7
  QUALIFY row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY len(chosen), coverage DESC, mask) = 1)
"""
ORACLES["subset_cover"] = f"WITH {CLAIMS_SQL}, {SUBSET_SQL} SELECT answer_id, claim_id, anchor_ids, round(coverage, 4)::DOUBLE AS coverage FROM cover"


def _verified(t):
    """A verifier that names the weakest two candidates first, then the best one."""
    # Written once: the verifier's two items, the verification and what follows all read it.
    # Only terms of the claim itself can count, so no others are written.
    own = K.attribution_terms("claim_text")
    shared = let(own, lambda claim: F.transform("anchors", lambda a: F.struct(
        a["rank"].alias("rank"), a["anchor_id"].alias("anchor_id"), F.array_intersect(a["terms"], claim).alias("terms"))))
    rows = saved(_candidates(t).filter(F.size("anchors") > 0).withColumn("anchors", shared), "candidates")
    ids = F.transform("anchors", lambda a: a["anchor_id"])
    weak = rows.select("answer_id", F.lit(0).alias("item_pos"), "claim_id", F.slice(F.reverse(ids), 1, 2).alias("anchor_ids"))
    best = rows.select("answer_id", F.lit(1).alias("item_pos"), "claim_id", F.slice(ids, 1, 1).alias("anchor_ids"))
    return rows, C.verify_attributions(rows, weak.unionByName(best))


def verify_attributions(t):
    _, verified = _verified(t)
    return verified.select("answer_id", "claim_id", F.array_join("anchor_ids", ",").alias("anchor_ids"), F.round("coverage", 4).alias("coverage"))


VERIFY_SQL = f"""
sel AS (SELECT answer_id, claim_id, text, 0 AS item, list_reverse(ids)[1:2] AS chosen, flatten(list_reverse(tl)[1:2]) AS ev FROM cand
  UNION ALL SELECT answer_id, claim_id, text, 1, ids[1:1], flatten(tl[1:1]) FROM cand),
sc AS (SELECT *, list_distinct({terms_sql('text')}) AS ct FROM sel),
sv AS (SELECT answer_id, claim_id, item, chosen, {coverage_sql('ct', 'ev')} AS coverage FROM sc),
verified AS (SELECT answer_id, claim_id, array_to_string(chosen, ',') AS anchor_ids, coverage FROM sv WHERE coverage >= 0.4
  QUALIFY row_number() OVER (PARTITION BY answer_id, claim_id ORDER BY item) = 1)
"""
QUERIES["verify_attributions"] = tables(verify_attributions)
ORACLES["verify_attributions"] = f"WITH {CLAIMS_SQL}, {VERIFY_SQL} SELECT answer_id, claim_id, anchor_ids, round(coverage, 4)::DOUBLE AS coverage FROM verified"


def recover_attributions(t):
    rows, verified = _verified(t)
    out = C.recover_attributions(rows, verified)
    return out.select("answer_id", "claim_id", F.array_join("anchor_ids", ",").alias("anchor_ids"), F.round("coverage", 4).alias("coverage"))


RECOVERED_SQL = """
recovered AS (SELECT * FROM verified UNION ALL SELECT * FROM cover c
  WHERE NOT EXISTS (SELECT 1 FROM verified v WHERE v.answer_id = c.answer_id AND v.claim_id = c.claim_id))
"""
QUERIES["recover_attributions"] = tables(recover_attributions)
ORACLES["recover_attributions"] = f"WITH {CLAIMS_SQL}, {SUBSET_SQL}, {VERIFY_SQL}, {RECOVERED_SQL} SELECT answer_id, claim_id, anchor_ids, round(coverage, 4)::DOUBLE AS coverage FROM recovered"


def _core_answers(t):
    return t("conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("answer_id"), F.concat(F.lit("Summary "), F.col("conv_id").cast("string")).alias("summary"),
        (F.col("conv_id") % 2 == 0).alias("grounding"))


def gate_claims(t):
    rows, verified = _verified(t)
    gated, _ = C.gate_claims(_core_answers(t), _claims(t), C.recover_attributions(rows, verified))
    return gated.select("answer_id", "grounding", "summary", "claim_count", "refused")


QUERIES["gate_claims"] = tables(gate_claims)
ORACLES["gate_claims"] = f"""
WITH {CLAIMS_SQL}, {SUBSET_SQL}, {VERIFY_SQL}, {RECOVERED_SQL},
a AS (SELECT DISTINCT conv_id AS answer_id, conv_id % 2 = 0 AS grounding FROM conversations),
k AS (SELECT c.answer_id, count(*) AS n FROM claims c JOIN a USING (answer_id) LEFT JOIN recovered r USING (answer_id, claim_id) WHERE NOT grounding OR r.answer_id IS NOT NULL GROUP BY ALL)
SELECT answer_id, grounding, CASE WHEN NOT grounding THEN 'Summary ' || answer_id WHEN coalesce(n, 0) = 0 THEN '{C.NO_SUPPORT}' ELSE '' END AS summary,
  coalesce(n, 0) AS claim_count, grounding AND coalesce(n, 0) = 0 AS refused FROM a LEFT JOIN k USING (answer_id)
"""


def _study_sessions(t):
    names = F.array(*map(F.lit, ["A", " b", "C", "d ", "baseline"]))
    return t("customer").select(
        F.col("c_custkey").alias("answer_id"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("condition"))


def factor_lookup(t):
    known, invalid = C.attach_factors(_study_sessions(t))
    return known.unionByName(invalid, allowMissingColumns=True)


QUERIES["attach_factors"] = tables(factor_lookup)
ORACLES["attach_factors"] = """
WITH s AS (SELECT c_custkey AS answer_id, ['A', ' b', 'C', 'd ', 'baseline'][c_custkey % 5 + 1] AS condition FROM customer)
SELECT answer_id, condition, CASE upper(trim(condition)) WHEN 'A' THEN FALSE WHEN 'B' THEN TRUE WHEN 'C' THEN FALSE WHEN 'D' THEN TRUE END AS grounding,
  CASE upper(trim(condition)) WHEN 'A' THEN FALSE WHEN 'B' THEN FALSE WHEN 'C' THEN TRUE WHEN 'D' THEN TRUE END AS attribution,
  CASE upper(trim(condition)) WHEN 'A' THEN 'U' WHEN 'B' THEN 'G' WHEN 'C' THEN 'U' WHEN 'D' THEN 'G' END AS core_variant,
  CASE condition WHEN 'baseline' THEN 'INVALID_STUDY_CONDITION' END AS error_code FROM s
"""


def visible_citations(t):
    claims = t("orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").cast("string").alias("claim_id"))
    verified = t("lineitem").select(F.col("l_orderkey").cast("string").alias("claim_id"), F.col("l_suppkey").alias("anchor")).join(
        claims, "claim_id")
    return C.visible_citations(claims, verified, _study_sessions(t)).select("answer_id", "claim_id", "anchor")


QUERIES["visible_citations"] = tables(visible_citations)
ORACLES["visible_citations"] = """
SELECT o_custkey AS answer_id, o_orderkey::VARCHAR AS claim_id, l_suppkey AS anchor FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 IN (2, 3)
"""


def paired_core_check(t):
    sessions = _study_sessions(t).withColumn("core_hash", F.sha2((F.col("answer_id") % 5 % 2).cast("string"), 256))
    cited = t("orders").select(F.col("o_custkey").alias("answer_id"))
    return C.paired_core_check(sessions, cited)


QUERIES["paired_core_check"] = tables(paired_core_check)
ORACLES["paired_core_check"] = """
WITH s AS (SELECT c_custkey, c_custkey % 5 AS k, sha256((c_custkey % 5 % 2)::VARCHAR) AS h FROM customer WHERE c_custkey % 5 < 4),
o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL),
j AS (SELECT CASE WHEN k IN (1, 3) THEN 'G' ELSE 'U' END AS core_variant, h, k >= 2 AS attribution, coalesce(n, 0) AS n FROM s LEFT JOIN o ON o_custkey = c_custkey)
SELECT core_variant, count(DISTINCT h) AS n_hashes, sum(CASE WHEN attribution THEN 0 ELSE n END)::BIGINT AS hidden_citations,
  sum(CASE WHEN attribution THEN n ELSE 0 END)::BIGINT AS shown_citations,
  count(DISTINCT h) = 1 AND sum(CASE WHEN attribution THEN 0 ELSE n END) = 0 AND sum(CASE WHEN attribution THEN n ELSE 0 END) > 0 AS ok FROM j GROUP BY core_variant
"""


def number_sources(t):
    cites = t("lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("anchor_id"))
    return C.number_sources(cites).select("answer_id", "anchor_id", "source_number")


QUERIES["number_sources"] = tables(number_sources)
ORACLES["number_sources"] = """
WITH f AS (SELECT l_orderkey AS answer_id, l_suppkey AS anchor_id, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL)
SELECT answer_id, anchor_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos, anchor_id) AS source_number FROM f
"""


def quote_audit(t):
    turns = t("conversations")
    box = F.array(F.struct(
        (F.col("turn") / 10).alias("x"), F.lit(0.2).alias("y"), F.lit(0.5).alias("width"), (F.col("conv_id") % 10 / 10.0).alias("height")))
    anchors = turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("anchor_id"),
        F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page"),
        F.regexp_replace(F.regexp_replace("text", r"^\S+", ""), r"\s", "   ").alias("exact_quote"), box.alias("rectangles"))
    pages = turns.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("page"), "text")
    return C.quote_audit(anchors, pages.dropDuplicates(["doc_id", "page"]))


QUERIES["quote_audit"] = tables(quote_audit)
SQUEEZE = "trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
ORACLES["quote_audit"] = f"""
WITH a AS (SELECT conv_id || '-' || turn AS anchor_id, conv_id, turn // 2 AS page, {SQUEEZE.format(x="regexp_replace(text, '^[^ \\t\\n\\r\\f\\v]+', '')")} AS q,
   turn / 10 AS x, (conv_id % 10) / 10.0::DOUBLE AS h FROM conversations),
p AS (SELECT conv_id, turn // 2 AS page, {SQUEEZE.format(x='text')} AS page_text FROM conversations WHERE role = 'user')
SELECT anchor_id, coalesce(contains(page_text, q), FALSE) AS quote_found, x + 0.5 <= 1.01 AND h > 0 AND 0.2 + h <= 1.01 AS rectangles_ok
FROM a LEFT JOIN p USING (conv_id, page)
"""


def locate_quote(t):
    chunks = document_chunks(t)
    hits = lexical.phrase_hits(plain_questions(t), chunks, lexical.build_index(chunks))
    anchors = hits.join(t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("exact_quote")), "query_id").select(
        F.concat_ws("-", F.col("query_id").cast("string"), "chunk_id").alias("anchor_id"), F.col("chunk_id").alias("doc_id"),
        F.lit(1).alias("page"), "exact_quote")
    items = t("documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split("text", r"\n")).alias("item_seq", "str"))
    return C.locate_quote(anchors, items.join(anchors.select("doc_id").distinct(), "doc_id", "left_semi"))


QUERIES["locate_quote"] = tables(locate_quote)


# ---- generated answers ---------------------------------------------------------
def _raw_answers(t):
    """One JSON answer per conversation; its items are the turns, citing themselves and source 99."""
    turn = F.struct(
        F.col("text"),
        F.array(F.col("turn").cast("int"), F.lit(99), F.col("turn").cast("int")).alias("citations"),
        (F.col("role") != "system").alias("supported"))
    rows = t("conversations").groupBy(F.col("conv_id").alias("answer_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", turn.alias("item"), F.col("text").alias("full"))))["item"].alias("items"))
    quiz = F.transform("items", lambda i: F.struct(
        i["text"].alias("question"), F.lit("难").alias("difficulty"), F.lit("A").alias("answer"), F.lit(" why ").alias("explanation"),
        F.slice(i["citations"], 1, 2).alias("citations")))
    body = F.struct(
        F.lit("  Overview ").alias("summary"), F.array(F.struct(F.lit("").alias("heading"), F.col("items").alias("items"))).alias("sections"),
        quiz.alias("quiz"))
    raw = rows.select("answer_id", F.when(F.col("answer_id") % 2 == 0, "quiz").otherwise("qa").alias("mode"), F.to_json(body).alias("json"))
    sources = t("conversations").filter("turn % 2 = 1").select(F.col("conv_id").alias("answer_id"), F.col("turn").cast("int").alias("source_id"))
    return raw, sources


STRUCTURED_SQL = f"""
items AS (SELECT conv_id AS answer_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, turn, role,
  {trim("text")} AS text, turn % 2 = 1 AS cited FROM conversations),
kept AS (SELECT *, cited AND role <> 'system' AS supported FROM items WHERE text <> ''),
claims AS (SELECT *, n AS item_pos FROM kept),
quiz AS (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY n) - 1 AS quiz_pos, text AS question, turn FROM items WHERE text <> '' AND cited),
lost AS (SELECT answer_id, count(*) AS n FROM items WHERE text <> '' AND NOT cited GROUP BY ALL)
"""


def parse_structured(t):
    raw, sources = _raw_answers(t)
    answers, _, _ = A.parse_structured(raw, sources, True)
    return answers.select("answer_id", "mode", "summary", "partial_refusal", F.col("supported_claim_count").cast("bigint").alias("supported"), "refused")


QUERIES["parse_structured"] = tables(parse_structured)
ORACLES["parse_structured"] = f"""
WITH {STRUCTURED_SQL}, a AS (SELECT DISTINCT conv_id AS answer_id FROM conversations),
s AS (SELECT answer_id, count(*) AS n FROM claims WHERE supported GROUP BY ALL), z AS (SELECT answer_id, count(*) AS n FROM quiz GROUP BY ALL)
SELECT answer_id, CASE WHEN answer_id % 2 = 0 THEN 'quiz' ELSE 'qa' END AS mode, 'Overview' AS summary,
  CASE WHEN answer_id % 2 = 0 AND lost.n > 0 THEN lost.n || ' 道题因缺少可核查的课件引用而未显示。' END AS partial_refusal,
  coalesce(s.n, 0) + coalesce(z.n, 0) AS supported, coalesce(s.n, 0) + coalesce(z.n, 0) = 0 AS refused
FROM a LEFT JOIN s USING (answer_id) LEFT JOIN z USING (answer_id) LEFT JOIN lost USING (answer_id)
"""


def render_markdown(t):
    raw, sources = _raw_answers(t)
    return A.render_markdown(*A.parse_structured(raw, sources, True)).select("answer_id", F.md5("content").alias("digest"))


QUERIES["render_markdown"] = tables(render_markdown)
ORACLES["render_markdown"] = f"""
WITH {STRUCTURED_SQL},
l AS (SELECT DISTINCT answer_id, 0 AS part, -1 AS pos, '## 核心内容' AS line FROM claims
  UNION ALL SELECT answer_id, 0, n, CASE WHEN supported THEN '- ' || text || ' [来源' || turn || ']' ELSE '- **当前课件未提及：** ' || text END FROM claims
  UNION ALL SELECT DISTINCT answer_id, 1, -1, '## 练习题' FROM quiz WHERE answer_id % 2 = 0
  UNION ALL SELECT answer_id, 1, quiz_pos, (quiz_pos + 1) || '. **[基础]** ' || question FROM quiz WHERE answer_id % 2 = 0
  UNION ALL SELECT DISTINCT answer_id, 2, -1, '## 答案与解析' FROM quiz WHERE answer_id % 2 = 0
  UNION ALL SELECT answer_id, 2, quiz_pos, (quiz_pos + 1) || '. **答案：** A' || chr(10) || chr(10) || '   **解析：** why [来源' || turn || ']' FROM quiz WHERE answer_id % 2 = 0
  UNION ALL SELECT answer_id, 3, 0, '> **课件未覆盖的部分：** ' || n || ' 道题因缺少可核查的课件引用而未显示。' FROM lost WHERE answer_id % 2 = 0)
SELECT answer_id, md5({trim("string_agg(line, chr(10) || chr(10) ORDER BY part, pos)")}) AS digest FROM l GROUP BY answer_id
"""


def supported_claims(t):
    raw, sources = _raw_answers(t)
    _, claims, quiz = A.parse_structured(raw, sources, True)
    counts, cited = A.supported_claims(claims, quiz, sources)
    return counts.join(cited.groupBy("answer_id").agg(F.count(F.lit(1)).alias("cited_sources")), "answer_id", "left").fillna(0, ["cited_sources"])


QUERIES["supported_claims"] = tables(supported_claims)
ORACLES["supported_claims"] = f"""
WITH {STRUCTURED_SQL}, q AS (SELECT * FROM quiz WHERE answer_id % 2 = 0),
a AS (SELECT answer_id FROM claims UNION SELECT answer_id FROM q),
s AS (SELECT answer_id, count(*) AS n FROM (SELECT answer_id FROM claims WHERE supported UNION ALL SELECT answer_id FROM q) GROUP BY ALL),
c AS (SELECT answer_id, count(DISTINCT turn) AS n FROM (SELECT answer_id, turn FROM claims WHERE cited UNION ALL SELECT answer_id, turn FROM q) GROUP BY ALL)
SELECT answer_id, coalesce(s.n, 0) AS supported, coalesce(s.n, 0) > 0 AS grounded, coalesce(s.n, 0) = 0 AS refused, coalesce(c.n, 0) AS cited_sources
FROM a LEFT JOIN s USING (answer_id) LEFT JOIN c USING (answer_id)
"""


def normalize_answers(t):
    """Model JSON per conversation: user turns are headings, assistant turns claims; odd ones ask for an example."""
    turns = t("conversations").groupBy(F.col("conv_id").alias("answer_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    sections = F.transform(
        F.filter("rows", lambda r: r["role"] == "assistant"),
        lambda r: F.struct(F.concat(F.lit("Turn "), r["turn"].cast("string")).alias("heading"), F.split(r["text"], "\n").alias("claims")))
    raw = turns.select(
        "answer_id", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("Intro").alias("summary"), sections.alias("sections"))), F.lit("\n```")).alias("json"),
        F.when(F.col("answer_id") % 2 == 1, "Give an example").otherwise("Explain").alias("question"), (F.col("answer_id") % 4 == 1).alias("grounding"))
    _, claims = A.normalize_answers(raw)
    return claims.select("answer_id", "claim_id", "heading", F.md5("text").alias("digest"))


QUERIES["normalize_answers"] = tables(normalize_answers)
ORACLES["normalize_answers"] = f"""
WITH s AS (SELECT conv_id AS answer_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sp, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT answer_id, turn, sp, unnest(ls) AS raw, unnest(range(len(ls))) AS cp FROM (SELECT *, string_split(text, chr(10)) AS ls FROM s)),
n AS (SELECT answer_id, turn, sp, cp, {norm('raw')} AS text FROM c),
k AS (SELECT * FROM n WHERE text <> ''),
f AS (SELECT answer_id, min(sp) AS sp FROM k GROUP BY ALL),
added AS (SELECT k.answer_id, any_value(k.turn) AS turn, k.sp, -1::BIGINT AS cp, '{A.ADDED_CLAIM}' AS text FROM k JOIN f USING (answer_id, sp) WHERE k.answer_id % 4 = 3 GROUP BY ALL),
u AS (SELECT * FROM k UNION ALL SELECT * FROM added)
SELECT answer_id, 'claim-' || dense_rank() OVER (PARTITION BY answer_id ORDER BY sp) || '-' || row_number() OVER (PARTITION BY answer_id, sp ORDER BY cp) AS claim_id,
  'Turn ' || turn AS heading, md5(text) AS digest FROM u
"""


def history_window(t):
    return A.history_window(t("conversations"), 5).select("conv_id", "turn", "role", F.md5("content").alias("digest"))


QUERIES["history_window"] = tables(history_window)
ORACLES["history_window"] = f"""
WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5),
n AS (SELECT conv_id, turn, role, {norm('text')} AS content FROM l WHERE role IN ('user', 'assistant'))
SELECT conv_id, turn, role, md5(content) AS digest FROM n WHERE content <> ''
"""


def assemble_prompts(t):
    from evidar.operators import evidence

    queries = t("conversations").filter("turn = 0").select(
        F.col("conv_id").alias("query_id"), "text", (F.col("conv_id") % 2 == 0).alias("grounding"))
    contexts = t("conversations").filter("role = 'system'").select(F.col("conv_id").alias("query_id"), F.col("text").alias("context")).dropDuplicates(["query_id"])
    history = A.pack_history(A.history_window(t("conversations"), 4, strip=False))
    out = evidence.assemble_prompts(queries, contexts, history, "Answer from the evidence.")
    return out.select("query_id", "error_code", F.size("messages").cast("bigint").alias("n_messages"), F.md5(F.to_json("messages")).alias("digest"))


QUERIES["assemble_prompts"] = tables(assemble_prompts)


ORACLES["assemble_prompts"] = f"""
WITH q AS (SELECT conv_id, text, conv_id % 2 = 0 AS grounding FROM conversations WHERE turn = 0),
c AS (SELECT conv_id, any_value(text) AS context FROM conversations WHERE role = 'system' GROUP BY ALL),
l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4),
h AS (SELECT conv_id, turn, role, {norm('text')} AS content FROM l WHERE role IN ('user', 'assistant')),
hs AS (SELECT conv_id, list({{'role': role, 'content': content}} ORDER BY turn) AS turns FROM h WHERE content <> '' GROUP BY ALL),
m AS (SELECT q.conv_id, grounding AND context IS NULL AS missing, list_concat(list_concat([{{'role': 'system', 'content': 'Answer from the evidence.' || CASE WHEN grounding THEN chr(10) || chr(10) || context ELSE '' END}}],
  coalesce(turns, [])), [{{'role': 'user', 'content': text}}]) AS msgs FROM q LEFT JOIN c USING (conv_id) LEFT JOIN hs USING (conv_id))
SELECT conv_id AS query_id, CASE WHEN missing THEN 'GROUNDING_EVIDENCE_MISSING' END AS error_code, CASE WHEN NOT missing THEN len(msgs)::BIGINT END AS n_messages,
  CASE WHEN NOT missing THEN md5(to_json(msgs)) END AS digest FROM m
"""


def model_hooks(t):
    """User functions score turns and answer prompts; both measure the text."""
    import json

    from evidar.operators import hooks

    turns = t("conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("chunk_id"), F.lit("?").alias("question"), F.lit("").alias("title"), F.col("role").alias("label"), "text")
    scored = hooks.rerank_with(turns, lambda pairs: [len(p["document"]) / 7 for p in pairs])
    prompts = turns.select(
        "query_id", F.lit(None).cast("string").alias("error_code"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    made = hooks.generate(prompts, lambda texts: [str(len(json.loads(x)[0]["content"])) for x in texts])
    return scored.select("query_id", F.col("rerank_score").alias("value")).unionByName(made.select("query_id", F.col("json").cast("double").alias("value")))


QUERIES["model_hooks"] = tables(model_hooks)
ORACLES["model_hooks"] = """
SELECT conv_id AS query_id, round((length(role) + 1 + length(text)) / 7, 6)::DOUBLE AS value FROM conversations UNION ALL SELECT conv_id, length(text)::DOUBLE FROM conversations
"""
