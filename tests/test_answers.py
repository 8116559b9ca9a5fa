import json
import random

import pytest
from pyspark.sql import functions as F

from evidar.functions import terms as K
from evidar.operators import answers as A
from evidar.operators import attribution as C
from evidar.operators import evaluation as E
from evidar.operators import ocr
from evidar.plans.study import cache_keys, study_answers
from tests.helpers import chunk, chunks, rows, scalar

CLAIMS = "answer_id string, claim_id string, text string"
DEFINITION = "The cardinality of a relation is the number of tuples it contains"
CHANGE = "Cardinality changes when tuples are inserted or deleted"


def _raw(spark, body, mode="qa", sources=(1,)):
    raw = spark.createDataFrame([("a", mode, json.dumps(body))], "answer_id string, mode string, json string")
    return A.parse_structured(raw, spark.createDataFrame([("a", i) for i in sources], "answer_id string, source_id int"))


def test_citations_decide_support(spark):
    body = {"summary": "s", "sections": [{"heading": "", "items": [{"text": "one", "citations": [1, 1]}, {"text": "two", "citations": [99]}, {"text": " "}]}]}
    answers, claims, quiz = _raw(spark, body)
    assert answers.first().supported_claim_count == 1
    assert [(r.text, r.citations, r.supported) for r in claims.orderBy("item_pos").collect()] == [("one", [1], True), ("two", [], False)]
    text = A.render_markdown(answers, claims, quiz).first().content
    assert text == "## 核心内容\n\n- one [来源1]\n\n- **当前课件未提及：** two"


def test_quiz_needs_citations(spark):
    q = {"question": "q", "answer": "a", "explanation": "e"}
    answers, _, quiz = _raw(spark, {"quiz": [{**q, "citations": [1], "difficulty": "进阶"}, {**q, "citations": []}]}, "quiz")
    assert [r.difficulty for r in quiz.collect()] == ["进阶"]
    assert answers.first().partial_refusal.startswith("1 ")


def test_unreadable_answers_give_nothing(spark):
    raw = spark.createDataFrame([("a", "qa", "no json"), ("b", "qa", "{}"), ("c", "qa", '{"summary":"x"}')], "answer_id string, mode string, json string")
    answers, _, _ = A.parse_structured(raw, spark.createDataFrame([], "answer_id string, source_id int"))
    assert rows(answers, "answer_id", "grounded") == [("c", False)]


def test_core_answers_and_example_labels(spark):
    body = {"summary": "ＯＫ", "sections": [{"heading": "Facts", "claims": ["rows are inserted, deleted or updated", {"text": "b"}]}, {"heading": "Example use", "claims": ["Suppose x"]}, {"claims": []}]}
    raw = spark.createDataFrame([("u", json.dumps(body), "Explain", False), ("g", "```json\n" + json.dumps(body) + "\n```", "Explain", True), ("x", "oops", "q", False)],
                                "answer_id string, json string, question string, grounding boolean")
    answers, claims = A.normalize_answers(raw)
    assert rows(answers, "answer_id", "summary") == [("g", "OK"), ("u", "OK")]
    got = {(r.answer_id, r.claim_id): r.text for r in claims.collect()}
    assert got[("g", "claim-1-1")] == "rows are inserted or deleted" and ("g", "claim-2-2") not in got
    assert got[("u", "claim-2-1")].startswith(K.HYPOTHETICAL_LABEL) and got[("u", "claim-2-2")] == "Suppose x"
    assert len({r.core_hash for r in answers.collect()}) == 2


def test_lecture_label_is_replaced_when_not_grounded(spark):
    body = {"summary": "", "sections": [{"heading": "H", "claims": [K.LECTURE_LABEL + " a"]}]}
    raw = spark.createDataFrame([("u", json.dumps(body), "an example please", False)], "answer_id string, json string, question string, grounding boolean")
    assert [r.text for r in A.normalize_answers(raw)[1].collect()] == [K.HYPOTHETICAL_LABEL + " a"]


@pytest.fixture(scope="module")
def candidate_rows(spark):
    claims = spark.createDataFrame([("a", "claim-1-1", DEFINITION), ("a", "claim-1-2", CHANGE), ("a", "claim-1-3", K.HYPOTHETICAL_LABEL + " x")], CLAIMS)
    anchors = spark.createDataFrame([("k-a1", "k", "Cardinality: the number of tuples a relation contains"), ("k-a2", "k", "Other words")], "anchor_id string, chunk_id string, exact_quote string")
    hits = claims.select("answer_id", "claim_id", F.lit("k").alias("chunk_id"), F.lit(1).alias("rank"))
    return claims, C.candidates(claims, C.rank_anchors(claims, hits, anchors), anchors)


def test_recovery_keeps_only_the_definition(spark, candidate_rows):
    claims, found = candidate_rows
    sizes = {r.claim_id: len(r.anchors) for r in found.collect()}
    assert sizes == {"claim-1-1": 2, "claim-1-2": 2, "claim-1-3": 0}
    none = spark.createDataFrame([], "answer_id string, claim_id string, anchor_ids array<string>, coverage double")
    assert rows(C.recover_attributions(found, none), "claim_id", "anchor_ids") == [("claim-1-1", ["k-a1"])]


def test_verifier_needs_coverage(spark, candidate_rows):
    claims, found = candidate_rows
    said = spark.createDataFrame([("a", 0, "claim-1-1", ["nope", "k-a2"]), ("a", 1, "claim-1-1", ["k-a1", "k-a1"]), ("a", 2, "claim-1-2", ["k-a1"])],
                                 "answer_id string, item_pos int, claim_id string, anchor_ids array<string>")
    verified = C.verify_attributions(found, said)
    assert rows(verified, "claim_id", "anchor_ids") == [("claim-1-1", ["k-a1"])]
    answers = spark.createDataFrame([("a", "intro", True), ("b", "intro", True), ("c", "intro", False)], "answer_id string, summary string, grounding boolean")
    gated, kept = C.gate_claims(answers, claims, verified)
    assert rows(gated, "answer_id", "summary", "refused") == [("a", "", False), ("b", C.NO_SUPPORT, True), ("c", "intro", False)]
    assert rows(kept, "claim_id") == [("claim-1-1",)]


def test_coverage_vetoes(spark):
    def cover(claim, quote):
        return scalar(spark, K.coverage_of(K.attribution_terms(F.lit(claim)), K.attribution_terms(F.lit(quote))))

    assert cover(CHANGE, DEFINITION) == 0 and cover(DEFINITION, DEFINITION) == 1
    assert cover("relation has three tuples", "relation tuples") == 0
    assert cover("tuples", "tuples") == 0


def test_locate_quote(spark):
    items = spark.createDataFrame([("d", 1, i, s) for i, s in enumerate(["Alpha beta,", "gamma DELTA", "epsilon zeta eta", "alpha beta gamma"])], "doc_id string, page int, item_seq int, str string")
    quotes = [("full", "beta gamma delta epsilon zeta eta"), ("part", "noise beta gamma delta epsilon zeta other"), ("short", "Alpha Beta"), ("none", "nothing of this kind is here at all")]
    anchors = spark.createDataFrame([(a, "d", 1, q) for a, q in quotes], "anchor_id string, doc_id string, page int, exact_quote string")
    got = {}
    for r in C.locate_quote(anchors, items).collect():
        got.setdefault(r.anchor_id, set()).add(r.item_seq)
    assert got == {"full": {0, 1, 2}, "part": {0, 1, 2}, "short": {0}}


def test_merge_native_and_ocr(spark):
    def merge(native, text):
        out = scalar(spark, ocr.merge_native_ocr(F.lit(native), F.lit(text)))
        return out["text"], out["origin"]

    assert merge("", "") == ("", "ocr") and merge("a", "") == ("a", "native") and merge("", "b") == ("b", "ocr")
    assert merge("Title line\nSecond line", "TITLE LINE") == ("Title line\nSecond line", "native")
    assert merge("Title line\nSecond line", "Title line!\nThird new line\nthird new line") == ("Title line\nSecond line\n\nThird new line", "mixed")
    assert merge("Title line\nSecond", "ab\nab\nc") == ("Title line\nSecond\n\nab\nc", "mixed")


def test_ocr_pages(spark):
    pages = spark.createDataFrame([("d", 1, "native words"), ("d", 2, ""), ("e", 1, "x")], "doc_id string, number int, text string")
    read = spark.createDataFrame([("d", 1, "auto", "other", 20.0), ("d", 2, "auto", "scan", 80.0), ("e", 9, "auto", "y", 90.0)], "doc_id string, number int, mode string, text string, confidence double")
    merged, errors = ocr.apply_ocr(pages, read)
    assert rows(merged, "doc_id", "number", "text", "text_origin", "ocr_confidence") == [("d", 1, "native words", "native", 20.0), ("d", 2, "scan", "ocr", 80.0), ("e", 1, "x", "native", None)]
    assert rows(errors, "doc_id", "error_code") == [("e", "OCR_PAGE_MISMATCH")]


def test_metrics(spark):
    hits = spark.createDataFrame([("1", "noise", 1), ("1", "p2", 2), ("1", "p4", 3)], "query_id string, chunk_id string, rank int")
    cases = spark.createDataFrame([("1", "x", ["p2", "p4"]), ("2", "x", []), ("3", "x", ["p9"])], "query_id string, category string, relevant_ids array<string>")
    got = {r.query_id: r for r in E.retrieval_metrics(hits, cases).collect()}
    assert got["1"].recall == 1 and got["1"].mrr == 0.5 and got["1"].ndcg > 0.6
    assert got["2"].recall == 1 and got["3"].recall == got["3"].mrr == got["3"].ndcg == 0
    assert scalar(spark, E.accuracy_of(F.lit("thread contr0l"), F.lit("thread control"))) > 0.9
    scores = spark.createDataFrame([("overview", 1.0), ("detail", 0.8), ("visual", 0.5)], "category string, score double")
    assert round(E.weighted_score(scores, {"overview": 0.5, "detail": 0.3, "visual": 0.2}).first()[0], 2) == 0.84
    empty = E.refusal_accuracy(spark.createDataFrame([], "refused boolean, should_refuse boolean")).first()
    assert empty.accuracy == 1.0


def test_history_limits_before_it_filters(spark):
    talk = [("c", i, role, f"t{i} [2].") for i, role in enumerate(["user", "assistant", "system", "system", "user"])]
    turns = spark.createDataFrame(talk, "conv_id string, turn int, role string, text string")
    assert rows(A.history_window(turns, 4), "turn", "content") == [(1, "t1."), (4, "t4 [2].")]


def test_factors_fail_closed(spark):
    known, invalid = C.attach_factors(spark.createDataFrame([(c, c) for c in ["A", "B", "c", "D", "baseline"]], "answer_id string, condition string"))
    assert known.count() == 4 and rows(invalid, "condition", "error_code") == [("baseline", "INVALID_STUDY_CONDITION")]


def test_study_plan_shares_answers_between_paired_conditions(spark):
    table = chunks(spark, [chunk(0, DEFINITION + "."), chunk(1, "Keys identify tuples of a relation.")]).drop("embedding")
    anchors = spark.createDataFrame([("k0000-a1", "k0000", DEFINITION), ("k0001-a1", "k0001", "Keys identify tuples of a relation")], "anchor_id string, chunk_id string, exact_quote string")
    asked = spark.createDataFrame([(c, "c", c, "What is cardinality?") for c in "ABCD"], "answer_id string, collection_id string, condition string, question string")
    keys = {r.answer_id: r.cache_key for r in cache_keys(asked).collect()}
    assert keys["A"] == keys["C"] != keys["B"] == keys["D"]
    body = json.dumps({"summary": "", "sections": [{"heading": "H", "claims": [DEFINITION, CHANGE]}]})
    cache = spark.createDataFrame([(keys["A"], False, 1, body)], "cache_key string, certified boolean, created_at int, answer string")
    out = study_answers(asked, table, anchors, cache, lambda todo: todo.select("cache_key", F.lit(body).alias("json")))
    assert rows(out["todo"], "cache_key") == [(keys["B"],)]
    kept = {}
    for r in out["claims"].collect():
        kept.setdefault(r.answer_id, []).append(r.text)
    assert sorted(map(len, kept.values())) == [1, 1, 2, 2] and kept["B"] == kept["D"] == [DEFINITION]
    assert rows(out["citations"].select("answer_id").distinct(), "answer_id") == [("C",), ("D",)]


def test_terms_of_quotes_are_taken_once_for_all_claims(spark):
    """Known terms of a quote count as they are; only shared ones leave a pair."""
    claims = spark.createDataFrame([("a", "c1", DEFINITION), ("a", "c2", CHANGE), ("a", "c3", "Nothing here")], CLAIMS)
    quotes = [("a", c, q) for c in ("c1", "c2") for q in (DEFINITION, CHANGE + " changes changes")]
    anchors = spark.createDataFrame(quotes, "answer_id string, claim_id string, exact_quote string")
    plain = rows(C.direct_coverage(claims, anchors), "claim_id", "coverage")
    known = anchors.withColumn("terms", K.attribution_terms("exact_quote")).withColumn("exact_quote", F.lit("gone"))
    assert plain == rows(C.direct_coverage(claims, known), "claim_id", "coverage") == [("c1", 1.0), ("c2", 1.0), ("c3", 0.0)]


def test_repeated_words_of_a_quote_count_each(spark):
    claims = spark.createDataFrame([("a", "c", "alpha beta gamma")], CLAIMS)
    hits = spark.createDataFrame([("a", "c", "k", 1)], "answer_id string, claim_id string, chunk_id string, rank int")
    anchors = spark.createDataFrame([("x", "k", "alpha alpha beta other other"), ("y", "k", "alpha beta"), ("z", "k", None)], "anchor_id string, chunk_id string, exact_quote string")
    got = C.rank_anchors(claims, hits, anchors)
    assert rows(got, "anchor_id", "overlap")[:2] == [("x", 3), ("y", 2)]


def test_claims_of_one_list_of_hits_meet_its_quotes_in_blocks(spark, monkeypatch):
    """Best anchors equal brute force, whichever claims share hits; words of a claim travel by claim and block, not by hit."""
    monkeypatch.setattr(C, "BLOCK", 2)
    vocabulary = "alpha beta gamma delta eps zeta eta theta".split()
    pick = random.Random(4)
    text = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    claims = [(f"a{a}", f"c{c}", text(5)) for a in range(3) for c in range(5)] + [("a0", "c0", text(4)), (None, "c1", "alpha"), ("a2", "c9", None)]
    hits = [(a, c, f"k{k}", k) for a, c, _ in claims for k in range(3) if a != "a1" or c != f"c{k}"] + [("a0", "c1", "k1", 0), ("a0", "c2", None, 1)]
    anchors = [(f"q{k}-{i}", f"k{k}", text(6)) for k in range(3) for i in range(4)] + [("q0-0", "k2", text(3)), ("q1-1", "k1", text(6)), ("q9", None, "alpha")]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in (
        (claims, "answer_id string, claim_id string, text string"), (hits, "answer_id string, claim_id string, chunk_id string, rank int"),
        (anchors, "anchor_id string, chunk_id string, exact_quote string"))]
    best = {}
    for a, c, said in claims:
        for a2, c2, chunk, rank in hits:
            for anchor, chunk2, quote in anchors:
                if a and said and (a, c) == (a2, c2) and chunk and chunk == chunk2:
                    overlap, at = best.get((a, c, anchor), (0, 99))
                    best[a, c, anchor] = max(overlap, sum(w in said.split() for w in quote.split())), min(at, rank)
    want = [
        (a, c, anchor, best[a, c, anchor][0], n + 1) for a, c in sorted({k[:2] for k in best})
        for n, anchor in enumerate(sorted((k[2] for k in best if k[:2] == (a, c)), key=lambda x: (-best[a, c, x][0], best[a, c, x][1], x))[:4])]
    found = C.rank_anchors(*tables)
    assert sorted(tuple(r) for r in found.select("answer_id", "claim_id", "anchor_id", "overlap", "rank").collect()) == sorted(want)
    assert len(want) == 15 * 4
