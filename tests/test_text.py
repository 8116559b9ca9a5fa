import pytest
from pyspark.sql import functions as F

from evidar.functions import records as R
from evidar.functions import structure as S
from evidar.functions import terms as K
from evidar.functions import text as T
from tests.helpers import scalar


def test_tokens_of_latin_and_han_text(spark):
    tokens = scalar(spark, T.tokenize(F.lit("K-means 如何用于聚类算法？")))
    assert "k-means" in tokens and "聚类" in tokens and "算法" in tokens
    assert scalar(spark, T.tokenize(F.lit("The cat"))) == ["cat"]
    # A single Han character is both a run and a whole, a stop token is neither.
    assert scalar(spark, T.tokenize(F.lit("页"))) == ["页", "页"]
    assert scalar(spark, T.tokenize(F.lit("我们"))) == []
    assert scalar(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_white_space(spark):
    text = "a\u0000b \t c\r\n  d \r\n\r\n\r\n\r\n e "
    assert scalar(spark, T.normalize_ws(F.lit(text))) == "ab c\nd\n\ne"
    assert scalar(spark, T.canonical_text(F.lit("Ｆｕｌｌ ﬁt"), 6)) == "Full f"
    assert scalar(spark, T.comparable_text(F.lit("线程 控制块：TCB!"))) == "线程控制块tcb"


def test_meaningful(spark):
    assert not scalar(spark, T.is_meaningful(F.lit("short")))
    assert scalar(spark, T.is_meaningful(F.lit("long enough to be meaningful")))
    assert not scalar(spark, T.is_meaningful(F.lit("-" * 40)))


@pytest.mark.parametrize("line, kind", [
    ("", "blank"), ("return x", "code"), ("| a | b |", "table"), ("• point", "list"), ("1. Intro", "list"), ("1、Intro", "heading"),
    ("进程是指正在执行的程序", "definition"), ("A relation means a set of rows", "definition"), ("THREAD CONTROL", "heading"), ("# Title", "heading"),
    ("just some prose here", "prose"), ("x   y", "table"), ("éclass room", "code"),
])
def test_line_classes(spark, line, kind):
    assert scalar(spark, S.classify_line(F.lit(line))) == kind


def test_units_and_types(spark):
    text = "核心概念\n进程是指正在执行的程序。\n\n• 创建进程\n• 调度进程\n\n| 字段 | 含义 |\n| PID | 标识符 |\n\nconst pid = fork();"
    units = scalar(spark, S.segment_text(F.lit(text)))
    assert [u["type"] for u in units] == ["prose", "definition", "list", "table", "code"]
    assert units[2]["text"] == "• 创建进程\n• 调度进程"
    pieces = scalar(spark, S.chunk_pieces(F.lit(text), F.lit("t")))
    assert len(pieces) == 1 and pieces[0]["content_type"] == "code"
    assert {"definition", "list", "table", "code"} <= set(pieces[0]["structure_types"])


def test_variants(spark):
    variants = scalar(spark, T.question_variants(F.lit("对比图表中的性能趋势")))
    assert len(variants) >= 3 and any("chart" in v for v in variants) and any("versus" in v for v in variants)
    assert scalar(spark, T.question_variants(F.lit("first part; second part"))) == ["first part; second part", "first part", "second part"]


def test_hints(spark):
    assert scalar(spark, T.page_hint(F.lit("see 第 12 页"))) == 12
    assert scalar(spark, T.page_hint(F.lit("no page"))) is None
    assert scalar(spark, T.type_hint(F.lit("Show the Table of a diagram"))) == "visual"
    assert scalar(spark, T.is_document_wide(F.lit("请先概览这份课件的知识结构。"), F.lit("explain")))
    assert scalar(spark, T.is_document_wide(F.lit("请详细讲解一下这节课的内容。"), F.lit("explain")))
    assert not scalar(spark, T.is_document_wide(F.lit("线程控制块是什么？"), F.lit("qa")))
    assert scalar(spark, T.is_document_wide(F.lit("anything"), F.lit("review")))


def test_reliability(spark):
    def trust(weight=None, origin="native", confidence=None):
        return scalar(spark, T.evidence_reliability(F.lit(weight).cast("double"), F.lit(origin), F.lit(confidence).cast("double")))

    assert trust() == 1.0 and trust(0.88, "vision") == 0.88 and trust(0.1) == 0.45
    assert trust(origin="ocr", confidence=20) < trust(origin="ocr", confidence=90)
    assert trust(origin="mixed", confidence=100) == pytest.approx(0.97)


def test_attribution_markup_and_keys(spark):
    assert scalar(spark, T.strip_attribution(F.lit("One fact [Citation 2]\nAnother [3]."))) == "One fact\nAnother."
    key = lambda g: scalar(spark, K.content_key(grounding=F.lit(g), question=F.lit("q"), none=F.lit(None).cast("string")))
    assert key(True) == key(True) != key(False)
    assert key(True) == scalar(spark, K.content_key(question=F.lit("q"), grounding=F.lit(True)))


def test_redaction(spark):
    body = F.create_map(F.lit("apiKey"), F.lit("v"), F.lit("note"), F.lit("use sk-abcdefgh12 or Bearer abcdefgh1234 now"))
    assert scalar(spark, T.redact_map(body)) == {"apiKey": "[REDACTED]", "note": "use [REDACTED] or [REDACTED] now"}


def test_nested_redaction(spark):
    body = F.create_map(F.lit("payload"), F.lit('{"apiKey":"hunter2","list":[{"Password":["a"]},{"n":1}]}'), F.lit("plain"), F.lit('{"n": 1}'), F.lit("none"), F.lit(None))
    want = {"payload": '{"apiKey":"[REDACTED]","list":[{"Password":"[REDACTED]"},{"n":1}]}', "plain": '{"n": 1}', "none": None}
    assert scalar(spark, T.redact_map(body)) == want
    assert scalar(spark, T.redact_json(F.lit('{"a":"{\\"token\\":{\\"session_token\\":1}}","b":"Bearer abcdefgh1234"}'))) == (
        '{"a":"{\\"token\\":{\\"session_token\\":\\"[REDACTED]\\"}}","b":"[REDACTED]"}')
    assert [scalar(spark, T.redact_json(F.lit(t))) for t in ("{broken", "", None)] == ["{broken", "", None]
    assert scalar(spark, T.redact_map(F.lit(None).cast("map<string,string>"))) is None


def test_redaction_fails_closed(spark):
    deep = "[" * 100_000 + '{"apiKey":"hunter2"}' + "]" * 100_000
    cases = ['"{\\"apiKey\\":\\"hunter2\\"}"', deep, '{"n":1,"password": "hunter2", broken', '{"secret":{"a":"hunter2"},"x":', '{"a":"{\\"apiKey\\":\\"hunter2\\" oops"']
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.x for r in df.select(T.redact_json("t").alias("x")).collect()]
    assert not any("hunter2" in g for g in got) and all("[REDACTED]" in g for g in got)
    assert got[2] == '{"n":1,"password":"[REDACTED]", broken'
    same = ['"plain text"', "not json: password", '{"n": 1, "note": "keep"}', '"{broken"', '[1, 2']
    assert [r.x for r in spark.createDataFrame([(c,) for c in same], "t string").select(T.redact_json("t").alias("x")).collect()] == same
    body = F.create_map(*[F.lit(x) for x in (
        "appVersion", '{"apiKey":"hunter2"}', "modelVersion", '["hunter2"]', "buildCommit", "[draft] 1", "promptVersion", '{"apiKey":"hunter2"', "materialHash", '"{\\"apiKey\\":\\"hunter2\\"}"', "other", "x", "materialVersion", "7")])
    kept = scalar(spark, T.sanitize_metadata(body))
    assert "hunter2" not in str(kept) and {k: kept[k] for k in ("buildCommit", "materialVersion")} == {"buildCommit": "[draft] 1", "materialVersion": "7"}
    assert set(kept) == {"buildCommit", "materialVersion", "materialHash"}


def test_long_texts_are_kept_whole(spark):
    long = F.repeat(F.lit("ab "), 100_000)
    assert scalar(spark, F.length(T.canonical_text(long))) == 299_999
    assert scalar(spark, F.length(T.redact_text(long))) == 300_000
    assert scalar(spark, F.length(T.safe_identifier(long, "x"))) == 200_000


def test_question_style(spark):
    style = lambda q: scalar(spark, T.question_style(F.lit(q)))
    assert [style("Define a relation"), style("Explain keys with an example"), style("Give a detailed account")] == ["brief", "normal", "detailed"]


def test_terms(spark):
    assert scalar(spark, K.attribution_terms(F.lit("Two queries are inserted, adding classes"))) == ["2", "query", "insert", "add", "classe"]


def test_progress(spark):
    steps = [("hashing", 1, 2), ("rendering", 1, 2), ("parsing", 1, 1), ("ready", 0, None)]
    done = [scalar(spark, R.phase_progress(F.lit(p), F.lit(c), F.lit(n).cast("int"))) for p, c, n in steps]
    assert done == sorted(done) and done[-1] == 100
    left = lambda s, p, now: scalar(spark, R.estimate_remaining(F.lit(s), F.lit(p), F.lit(now)))
    assert left(0, 25, 10_000) == 30_000 and left(0, 100, 5) is None and left(0, 2, 5) is None


def _split(text, target, overlap=160):
    """Brute force of the window rule."""
    out, start = [], 0
    while start < len(text):
        ideal = min(len(text), start + target)
        end = ideal
        if ideal < len(text):
            for i in range(ideal, max(start + 320, ideal - 240) - 1, -1):
                if text[i] in "。！？.!?；;\n":
                    end = i + 1
                    break
        piece = text[start:end].strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            return out
        start = max(start + 1, end - overlap)
    return out


@pytest.mark.parametrize("size, every", [(700, 50), (3_000, 97), (5_000, 100_000), (2_500, 400)])
def test_split_long_matches_brute_force(spark, size, every):
    text = "".join("." if i % every == every - 1 else "abcdefghij"[i % 10] for i in range(size))
    assert scalar(spark, S.split_long(F.lit(text), F.lit(760))) == _split(text, 760)


def test_long_sections_keep_structure(spark):
    prose = " ".join(["plain words here."] * 50)
    text = "# Top\n" + prose + "\n\n" + prose + "\n\nconst a = 1;\n# Next\n" + prose
    pieces = scalar(spark, S.chunk_pieces(F.lit(text), F.lit("start")))
    assert [p["content_type"] for p in pieces] == ["prose", "prose", "code", "prose"]
    assert [p["title"] for p in pieces] == ["# Top", "# Top", "# Top", "# Next"]
    assert pieces[0]["text"].startswith("# Top\nplain") and pieces[3]["text"].startswith("# Next")
