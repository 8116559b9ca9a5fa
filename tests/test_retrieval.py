import math
import random

import pytest
from pyspark.sql import functions as F

from evidar.config import Config
from evidar.functions import text as T
from evidar.operators import hybrid, index, lexical, ranking, selection, slices
from evidar.operators import evidence as Ev
from evidar.plans import retrieval
from evidar.plans.evaluation import evaluate
from tests.helpers import chunk, chunks, queries, rows, scalar

SLIDES = ["机器学习基础\n监督学习使用带标签的数据进行训练。分类和回归是常见任务。", "无监督学习\n聚类用于发现没有标签的数据结构。K-means 是常见聚类算法。"]


@pytest.fixture(scope="module")
def lecture(spark):
    nodes = [("d", "intro.pptx", i, "slide", i + 1, text, None, None) for i, text in enumerate(SLIDES)]
    df = spark.createDataFrame(nodes, "doc_id string, file_name string, node_seq bigint, type string, number int, text string, text_origin string, ocr_confidence double")
    sections = index.extract_sections(df)
    made, header = index.apply_budgets(sections)
    table = made.withColumnRenamed("doc_id", "collection_id").withColumn("evidence_weight", F.lit(None).cast("double")).withColumn("collection_id", F.lit("c"))
    return sections, table, header


def test_sections_and_chunks(lecture):
    sections, made, header = lecture
    assert rows(sections, "label", "number") == [("幻灯片 1", 1), ("幻灯片 2", 2)]
    assert rows(made, "chunk_id", "file_name") == [("slide-1-chunk-1", "intro.pptx"), ("slide-2-chunk-1", "intro.pptx")]
    assert header.first().truncated is False


def test_gate_accepts_and_refuses(spark, lecture):
    asked = queries(spark, [("a", "qa", "什么是监督学习？"), ("b", "qa", "法国的首都是哪里？"), ("c", "qa", "这份课件如何进行量子纠缠实验？"), ("q", "quiz", "请生成复习题")])
    got = retrieval.retrieve_chunks(asked, lecture[1], 12)
    per = {}
    for r in got.collect():
        per.setdefault(r.query_id, set()).add(r.chunk_id)
    assert per == {"a": {"slide-1-chunk-1", "slide-2-chunk-1"}, "q": {"slide-1-chunk-1", "slide-2-chunk-1"}}
    assert rows(retrieval.refusals(asked, got), "query_id") == [("b",), ("c",)]


def test_sources(spark, lecture):
    asked = queries(spark, [("a", "qa", "聚类算法")])
    got = retrieval.retrieve_chunks(asked, lecture[1], 12)
    source = Ev.create_sources(got, asked, lecture[1]).orderBy("source_id").first()
    assert source.source_id == 1 and "聚类" in source.highlight and source.highlight in source.excerpt
    assert Ev.grounding_context(got, lecture[1]).first().context.startswith("[来源1｜intro.pptx｜幻灯片 2｜")


def test_vectors_recall_without_shared_words(spark):
    table = chunks(spark, [chunk(0, "线程同步", vector=[1.0, 0.0]), chunk(1, "磁盘调度", vector=[0.0, 1.0])])
    asked = queries(spark, [("v", "qa", "parallel execution")], {"v": [1.0, 0.0]})
    best = retrieval.retrieve_chunks(asked, table, 5).orderBy("rank").first()
    assert best.chunk_id == "k0000" and best.vector_score == 1.0


def test_pages_stay_whole(spark):
    nodes = [("d", "t.pdf", i, "page", i + 1, f"第 {i + 1} 页\n• 定义与背景\n• 机制与实现", None, None) for i in range(57)]
    df = spark.createDataFrame(nodes, "doc_id string, file_name string, node_seq bigint, type string, number int, text string, text_origin string, ocr_confidence double")
    made, header = index.apply_budgets(index.extract_sections(df))
    assert made.count() == 57 and header.first().truncated is False
    small, cut = index.apply_budgets(index.extract_sections(df), Config(max_sections=50, max_chars=200, max_chunks=4))
    assert small.count() == 4 and cut.first().truncated is True


def _cos(a, b):
    if a is None or b is None:
        return 0.0
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else 0.0


def test_fusion_equals_scoring_every_chunk(spark):
    """The candidate lists lose nothing: compare with a score of every pair, at a small fusion depth."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    data = []
    for i in range(60):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(2, 7))) if i % 3 else "nothing shared at all"
        vector = [rng.uniform(-1, 1) for _ in range(4)] if i % 4 else None
        data.append(chunk(i, body, title=rng.choice(words) if i % 5 == 0 else "", content_type=rng.choice(["prose", "table", "code"]), number=i % 6 + 1,
                          origin=rng.choice(["native", "ocr", "vision"]), confidence=float(rng.randint(0, 100)), vector=vector))
    table = chunks(spark, data)
    asked = [("1", "qa", "alpha beta; show the table on 3 slide"), ("2", "explain", "gamma delta; omega code"), ("3", "explain", "zeta eta theta"), ("4", "qa", "the of")]
    vecs = {"1": [1.0, 0.2, -0.3, 0.4], "2": None, "3": [0.1, 0.9, 0.3, -0.7], "4": [1.0, 1.0, 1.0, 1.0]}
    cfg = Config(rrf_depth=7, vector_block=16, query_block=2)
    got = {(r.query_id, r.chunk_id): (r.hybrid_score, r.rrf_score, r.score)
           for r in retrieval.fused_hits(queries(spark, asked, vecs), table, cfg=cfg).filter("hybrid_score > 0").collect()}

    toks = {d[1]: scalar(spark, T.tokenize(F.lit(f"{d[7]}\n{d[9]}"))) for d in data}
    titles = {d[1]: set(scalar(spark, T.tokenize(F.lit(d[7])))) for d in data}
    trust = {d[1]: scalar(spark, T.evidence_reliability(F.lit(None).cast("double"), F.lit(d[10]), F.lit(d[11]))) for d in data}
    avg = sum(map(len, toks.values())) / len(data)
    for qid, _, text in asked:
        variants = scalar(spark, T.question_variants(F.lit(text)))
        credit, base = {}, {}
        for pos, variant in enumerate(variants):
            terms = set(scalar(spark, T.tokenize(F.lit(variant))))
            if not terms:
                continue
            lex = {}
            for d in data:
                s = 0.0
                for w in terms:
                    tf = toks[d[1]].count(w)
                    df = sum(w in x for x in toks.values())
                    if tf:
                        s += math.log(1 + (len(data) - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len(toks[d[1]]) / max(avg, 1)))
                lex[d[1]] = round(s + (3 if len(variant) >= 4 and variant in d[9] else 0), 6)
            top = max(lex.values())
            want = scalar(spark, T.type_hint(F.lit(variant)))
            page = scalar(spark, T.page_hint(F.lit(variant)))
            vec = vecs[qid] if pos == 0 else None
            scores = {}
            for d in data:
                boost = 0.08 * bool(terms & titles[d[1]]) + 0.08 * (d[8] == want) + 0.14 * (d[5] == page)
                share = lex[d[1]] / top if top else 0
                raw = share * 0.5 + max(0, _cos(vec, d[13])) * 0.42 + boost if vec else share + boost
                scores[d[1]] = round(raw * trust[d[1]], 6)
            order = sorted(scores, key=lambda k: (-scores[k], k))
            if pos == 0:
                base = scores
            for rank, k in enumerate(order[:7], 1):
                credit[k] = credit.get(k, 0) + 1 / (60 + rank)
        best = max([*credit.values(), 1e-4])
        full = {k: (h, round(credit.get(k, 0) / best, 6), round(h * 0.72 + credit.get(k, 0) / best * 0.28, 6)) for k, h in base.items() if h > 0}
        mine = {k: v for (q, k), v in got.items() if q == qid}
        assert set(mine) <= set(full)
        for k, v in mine.items():
            assert v == pytest.approx(full[k], abs=2e-6), (qid, k)
        head = lambda m: sorted(m, key=lambda k: (-m[k][2], k))[:7]
        assert head(mine) == head(full), qid


def test_phrase_is_found_without_a_shared_word(spark):
    table = chunks(spark, [chunk(0, "a stable place"), chunk(1, "unrelated")])
    asked = queries(spark, [("p", "qa", "able plac")]).withColumn("variant_pos", F.lit(0))
    assert rows(lexical.phrase_hits(asked, table, lexical.build_index(table)), "chunk_id") == [("k0000",)]
    assert lexical.bm25(asked, table, lexical.build_index(table)).first().lexical_score == 3.0


def test_salted_scores_equal_broadcast_scores(spark, monkeypatch):
    table = chunks(spark, [chunk(i, f"alpha beta w{i % 3} alpha") for i in range(40)])
    asked = queries(spark, [("1", "qa", "alpha w1 of the beta w1"), ("2", "qa", "w2 gamma")]).withColumn("variant_pos", F.lit(0))
    built = lexical.build_index(table)
    wide = rows(lexical.bm25(asked, table, built), "query_id", "chunk_id", "lexical_score", "token_coverage")
    monkeypatch.setattr(lexical, "is_small", lambda *_: False)
    assert rows(lexical.bm25(asked, table, built), "query_id", "chunk_id", "lexical_score", "token_coverage") == wide and len(wide) == 53


def test_mmr_prefers_variety(spark):
    table = chunks(spark, [chunk(i, "same words here" if i < 6 else f"other topic {i}", number=1 if i < 6 else i) for i in range(10)])
    hits = spark.createDataFrame([("q", "c", f"k{i:04d}", i, "f.pdf", 1 if i < 6 else i, "prose", 1 - i / 100, i + 1) for i in range(10)],
                                 "query_id string, collection_id string, chunk_id string, chunk_ordinal bigint, file_name string, number int, content_type string, score double, rank int")
    picked = [r.chunk_id for r in selection.mmr_select(hits, table, 4).orderBy("rank").collect()]
    assert picked == ["k0000", "k0006", "k0007", "k0008"]
    same = [r.chunk_id for r in selection.mmr_select(hits, table, 10).orderBy("rank").collect()]
    assert same == [f"k{i:04d}" for i in range(10)]


def _coverage(data, most, budget):
    order = sorted(data, key=lambda d: (d[5], d[1]))
    if len(order) <= most and sum(len(d[9]) for d in order) <= budget:
        return [d[1] for d in order]
    seen, firsts = set(), []
    for d in order:
        if (d[3], d[4], d[5]) not in seen:
            seen.add((d[3], d[4], d[5]))
            firsts.append(d)
    n, count = len(firsts), min(most, len(firsts))
    even = firsts if n <= count else [firsts[math.floor(i * (n - 1) / max(count - 1, 1) + 0.5)] for i in range(count)]
    taken, used = [], 0
    for d in even + order:
        if len(taken) < most and d not in taken and not (taken and used + len(d[9]) > budget):
            taken.append(d)
            used += len(d[9])
    return [d[1] for d in sorted(taken, key=lambda d: (d[5], d[1]))]


@pytest.mark.parametrize("most, budget, n", [(80, 60_000, 56), (10, 500, 60), (10, 100_000, 60), (30, 220, 60)])
def test_document_coverage_matches_brute_force(spark, most, budget, n):
    rng = random.Random(n + most)
    data = [chunk(i, "x" * rng.randint(1, 40), number=i // 2 + 1) for i in range(n)]
    out = selection.document_coverage(chunks(spark, data), Config(coverage_chunks=most, coverage_chars=budget))
    assert [r.chunk_id for r in out.orderBy("rank").collect()] == _coverage(data, most, budget)


def test_carry_equals_one_window(spark):
    df = spark.createDataFrame([(k, i, i * 3 % 7) for k in ("a", "b") for i in range(0, 50, 3)], "k string, i int, v int")
    got = slices.carry(df, ["k"], slices.number_slice("i", 8), ["i"], index="n", before={"s": F.col("v")}, prev={"p": F.col("v")}, following={"f": F.col("v")})
    for key in ("a", "b"):
        out = got.filter(F.col("k") == key).orderBy("i").collect()
        vs = [r.v for r in out]
        assert [r.n for r in out] == list(range(1, len(out) + 1))
        assert [r.s for r in out] == [sum(vs[:i]) for i in range(len(vs))]
        assert [r.p for r in out] == [None, *vs[:-1]] and [r.f for r in out] == [*vs[1:], None]


def test_equal_slices_equal_one_window(spark):
    """One key holds a third of all rows, all of them in one second and many at the same time."""
    made = [("hot", 5, i) for i in range(400)] + [(f"k{i % 200}", i * 100_000, i) for i in range(800)]
    df = spark.createDataFrame([(k, t, i, i * 7 % 11) for k, t, i in made], "k string, t long, i int, v int")
    sliced = slices.evenly_sliced(df, ["k"], ["t", "i"], 12)
    assert sliced.filter("k = 'hot'").select("_slice").distinct().count() >= 3
    assert max(r["count"] for r in sliced.groupBy("_slice").count().collect()) <= 3 * len(made) / 12
    for part, source in ((None, df), (F.col("_slice"), sliced)):
        got = slices.carry(source, ["k"], part, ["t", "i"], index="n", before={"s": F.col("v")}, prev={"p": F.col("v")}, following={"f": F.col("v")})
        found = {(r.k, r.i): (r.n, r.s, r.p, r.f) for r in got.collect()}
        assert len(found) == len(made)
        for key in ("hot", "k0", "k7"):
            own = sorted((t, i) for k, t, i in made if k == key)
            vs = [i * 7 % 11 for _, i in own]
            assert [found[key, i] for _, i in own] == [
                (n + 1, sum(vs[:n]), vs[n - 1] if n else None, vs[n + 1] if n + 1 < len(vs) else None) for n in range(len(vs))]


def test_evenly_spaced(spark):
    df = spark.range(11).select(F.lit("g").alias("g"), F.col("id").alias("pos"))
    assert rows(ranking.evenly_spaced(df, ["g"], "pos", 4), "pos") == [(0,), (3,), (7,), (10,)]
    assert ranking.evenly_spaced(df, ["g"], "pos", 20).count() == 11
    assert rows(ranking.evenly_spaced(df, ["g"], "pos", 1), "pos") == [(0,)]


def test_rerank_floor_and_fallback(spark):
    hits = spark.createDataFrame([("q", "a", 1, "qa"), ("q", "b", 2, "qa"), ("r", "a", 1, "qa")], "query_id string, chunk_id string, rank int, mode string")
    scores = spark.createDataFrame([("q", "a", 0.05), ("q", "b", 0.9)], "query_id string, chunk_id string, rerank_score double")
    assert rows(selection.rerank(hits, scores), "query_id", "chunk_id", "rank") == [("q", "b", 1), ("r", "a", 1)]


def test_whole_chain_and_evaluation(spark):
    pages = [
        chunk(0, "课程结构包括线程基础、线程控制块、线程模型和调度实践。", "Overview", content_type="list"),
        chunk(1, "线程控制块 TCB 保存线程标识、程序计数器和寄存器状态。", "Thread Control Block", content_type="definition", origin="ocr", confidence=82.0),
        chunk(2, "视觉证据类型：chart\n摘要：柱状图比较线程数量与执行时间，执行时间随线程数量下降。", "Performance chart", content_type="visual", origin="vision", weight=0.92),
        chunk(3, "用户级线程由线程库管理，内核级线程由操作系统内核调度。", "User and kernel threads", content_type="table"),
    ]
    table = chunks(spark, pages)
    cases = spark.createDataFrame([
        ("1", "c", "overview", "explain", "请概览整份课件的知识结构。", ["k0000", "k0001", "k0002", "k0003"], False),
        ("2", "c", "detail", "qa", "线程控制块 TCB 保存哪些信息？", ["k0001"], False),
        ("3", "c", "visual", "qa", "图表中线程数量与执行时间有什么趋势？", ["k0002"], False),
        ("4", "c", "comparison", "qa", "比较用户级线程和内核级线程。", ["k0003"], False),
        ("5", "c", "detail", "qa", "法国的首都", [], True),
    ], "query_id string, collection_id string, category string, mode string, text string, relevant_ids array<string>, should_refuse boolean")
    samples = spark.createDataFrame([("1", "线程 控制块：TCB", "线程控制块 TCB")], "id string, expected string, actual string")
    report = evaluate(table, cases, samples)
    gates = report["gates"].first()
    assert gates.recall_gate and gates.mrr_gate and gates.category_gate and gates.ocr_gate
    assert report["weighted"].first().weighted_score > 0.9

    asked = cases.select("query_id", "collection_id", "mode", "text")
    found = retrieval.retrieve(asked, table.drop("embedding"))
    by = {}
    for r in found.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.chunk_id, r.strategy))
    assert [k for k, s in by["1"]] == ["k0000", "k0001", "k0002", "k0003"] and by["1"][0][1] == "document_coverage"
    assert by["2"][0][0] == "k0001" and "5" not in by
    kept = retrieval.retrieve(asked, table.drop("embedding"), rerank_scores=lambda h: h.select("query_id", "chunk_id", F.lit(0.01).alias("rerank_score")))
    assert {r.query_id for r in kept.collect()} == {"1"}


@pytest.mark.parametrize("vectors", [False, True])
def test_kept_hits_equal_those_of_all_pairs(spark, monkeypatch, vectors):
    """With ``keep`` only contenders are scored; lists are those of all pairs, also for repeated chunks and phrases inside words."""
    from evidar.operators import contenders

    monkeypatch.setattr(contenders, "SPARE", 0)
    monkeypatch.setattr(contenders, "CELLS", 200)
    rng = random.Random(5)
    words = [f"word{k}" for k in range(30)]
    made = [chunk(i, " ".join(rng.choices(words, k=rng.randint(3, 12))), title=rng.choice(words), content_type=rng.choice(["prose", "table"]), weight=rng.choice([0.5, 0.9, 1.0]),
                  vector=[rng.gauss(0, 1) for _ in range(4)] if rng.random() < 0.7 else None, number=i % 9 + 1) for i in range(300)]
    table = chunks(spark, made + made[:7])
    table = table if vectors else table.drop("embedding")
    asks = [(f"q{k}", "qa", " ".join(rng.sample(words, 3)) + rng.choice(["", "; table on 3 slide", f"; {rng.choice(words)}"])) for k in range(8)] + [("p", "qa", "ord1 word2; ord2"), ("n", "qa", "nothing")]
    asked = queries(spark, asks, {f"q{k}": [rng.gauss(0, 1) for _ in range(4)] for k in range(0, 8, 2)} if vectors else None)
    cfg = Config(rrf_depth=6)
    full, few = retrieval.fused_hits(asked, table, cfg=cfg), retrieval.fused_hits(asked, table, cfg=cfg, keep=5)
    columns = ["query_id", "chunk_id", "rank", "lexical_score", "token_coverage", "hybrid_score", "rrf_score", "score"]
    for best in (lambda h: ranking.rank_hits(h.filter("hybrid_score > 0"), 5), lambda h: selection.qa_gate(h, 5)):
        assert rows(best(few), *columns) == rows(best(full), *columns) != []
    assert few.count() < full.count() / 2
