"""Generated answers: parsing, normalisation, rendering and history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidar.functions.expr import col, cut, let, trim_ws, word
from evidar.functions.terms import HYPOTHETICAL_LABEL, LECTURE_LABEL
from evidar.functions.text import canonical_text, normalize_ws, strip_attribution, wants_example
from evidar.operators.ranking import top_k


@dataclass(frozen=True)
class AnswerLimits:
    """Entries kept of each list and characters kept of each text of an answer; None keeps everything."""

    sections: int | None = None
    items: int | None = None
    quiz: int | None = None
    suggestions: int | None = None
    summary: int | None = None
    heading: int | None = None
    text: int | None = None
    question: int | None = None
    answer: int | None = None
    explanation: int | None = None
    refusal: int | None = None
    suggestion: int | None = None


# ---- fixed values: limits, texts and patterns ---------------------------------
#: What a screen shows of a tutor's answer, and of a core answer of a study.
SCREEN_LIMITS = AnswerLimits(8, 12, 8, 3, 1_000, 120, 2_000, 800, 1_200, 1_600, 800, 180)
CORE_LIMITS = AnswerLimits(sections=8, items=8, summary=1_200, heading=160, text=1_600)
DIFFICULTIES = ["基础", "进阶", "应用"]
DEFAULT_HEADING, UNSUPPORTED = "核心内容", "当前课件未提及："
STRUCTURED_JSON = (
    "summary STRING, sections ARRAY<STRUCT<heading STRING, items ARRAY<STRUCT<text STRING, "
    "citations ARRAY<STRING>, supported STRING>>>>, quiz ARRAY<STRUCT<question STRING, difficulty STRING, "
    "answer STRING, explanation STRING, citations ARRAY<STRING>>>, partialRefusal STRING, suggestedQuestions ARRAY<STRING>"
)
CORE_JSON = "summary STRING, sections ARRAY<STRUCT<heading STRING, claims ARRAY<STRING>>>"
OVERCLAIMS = [
    ("(?i)" + word("(?:this|the) relation contains only facts that are true"),
     "For this hypothetical example, suppose the listed records are treated as valid"),
    ("(?i)(?<![A-Za-z0-9_])(rows|tuples) are inserted, deleted or updated(?![A-Za-z0-9_])", "$1 are inserted or deleted"),
    ("(?i)(?<![A-Za-z0-9_])(rows|tuples) are added, removed or updated(?![A-Za-z0-9_])", "$1 are added or removed"),
]
EXAMPLE_WORDS = "(?i)" + word(
    "example|scenario|suppose|consider|for illustration|for instance|contains only facts that are true"
) + r"|(?i:(?<![A-Za-z0-9_])e\.g\.(?=[A-Za-z0-9_]))"
EXAMPLE_TUPLE = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]*\([^\n)]*,[^\n)]*\)"
EXAMPLE_HEADING = "(?i)" + word("example|scenario|illustration|application")
ADDED_CLAIM = f"{HYPOTHETICAL_LABEL} Suppose the following data and constraints are assumed only for illustration."
# ---- end of fixed values -------------------------------------------------------


def _clean(c: Column | str, limit: int | None) -> Column:
    return cut(trim_ws(F.coalesce(col(c), F.lit(""))), limit)


def _first(entries: Column, limit: int | None) -> Column:
    kept = F.coalesce(entries, F.array())
    return kept if limit is None else F.slice(kept, 1, limit)


def _valid_ids(citations: Column, known: Column) -> Column:
    numbers = F.transform(F.coalesce(citations, F.array().cast("array<string>")), lambda s: s.try_cast("double"))
    whole = F.filter(numbers, lambda v: v.isNotNull() & (v == F.floor(v)))
    return F.filter(F.array_distinct(F.transform(whole, lambda v: v.cast("int"))), lambda i: F.array_contains(known, i))


def parse_structured(
    raw: DataFrame, sources: DataFrame, require: bool = True, limits: AnswerLimits = AnswerLimits()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, their claims and their quiz rows.

    ``raw``: answer_id, mode, json.  ``sources``: answer_id, source_id (few per answer).
    Answers that cannot be read, or hold nothing, give no row. Nothing is cut unless ``limits`` says so.
    """
    ids = sources.groupBy("answer_id").agg(F.collect_set(F.col("source_id").cast("int")).alias("_known"))
    parsed = (
        raw.withColumn("_j", F.from_json("json", STRUCTURED_JSON)).filter("_j IS NOT NULL AND json LIKE '%{%'")
        .join(ids, "answer_id", "left")
        .withColumn("_known", F.coalesce("_known", F.array().cast("array<int>")))
    )

    def clean_item(item: Column) -> Column:
        cited = _valid_ids(item["citations"], F.col("_known"))
        return let(cited, lambda c: F.struct(
            _clean(item["text"], limits.text).alias("text"), c.alias("citations"),
            (F.coalesce(item["supported"] != "false", F.lit(True)) & (F.lit(not require) | (F.size(c) > 0))).alias("supported"),
        ))

    def clean_section(section: Column) -> Column:
        heading = _clean(section["heading"], limits.heading)
        items = _first(section["items"], limits.items)
        return F.struct(
            F.when(heading == "", DEFAULT_HEADING).otherwise(heading).alias("heading"),
            F.filter(F.transform(items, clean_item), lambda i: i["text"] != "").alias("items"),
        )

    def clean_quiz(item: Column) -> Column:
        return F.struct(
            _clean(item["question"], limits.question).alias("question"),
            F.when(item["difficulty"].isin(DIFFICULTIES), item["difficulty"]).otherwise(DIFFICULTIES[0]).alias("difficulty"),
            _clean(item["answer"], limits.answer).alias("answer"), _clean(item["explanation"], limits.explanation).alias("explanation"),
            _valid_ids(item["citations"], F.col("_known")).alias("citations"),
        )

    j = F.col("_j")
    sections = F.filter(
        F.transform(_first(j["sections"], limits.sections), clean_section), lambda s: F.size(s["items"]) > 0)
    quiz = F.filter(
        F.transform(_first(j["quiz"], limits.quiz), clean_quiz),
        lambda q: (q["question"] != "") & (q["answer"] != ""))
    suggested = _first(F.filter(
        F.transform(F.coalesce(j["suggestedQuestions"], F.array().cast("array<string>")), lambda s: _clean(s, limits.suggestion)),
        lambda s: s != ""), limits.suggestions)
    staged = parsed.select(
        "answer_id", "mode", _clean(j["summary"], limits.summary).alias("summary"), sections.alias("_sections"), quiz.alias("_all_quiz"),
        _clean(j["partialRefusal"], limits.refusal).alias("_refusal"), suggested.alias("suggested"),
    )
    kept_quiz = F.filter("_all_quiz", lambda q: F.size(q["citations"]) > 0) if require else F.col("_all_quiz")
    staged = staged.withColumn("_quiz", kept_quiz)
    dropped = F.size("_all_quiz") - F.size("_quiz")
    hint = F.concat(dropped.cast("string"), F.lit(" 道题因缺少可核查的课件引用而未显示。"))
    staged = staged.withColumn(
        "partial_refusal",
        F.when(F.col("_refusal") != "", F.col("_refusal")).when(F.lit(require) & (F.col("mode") == "quiz") & (dropped > 0), hint),
    ).filter("summary <> '' OR size(_sections) > 0 OR size(_quiz) > 0 OR partial_refusal IS NOT NULL")
    supported = F.aggregate(
        "_sections", F.lit(0), lambda total, s: total + F.size(F.filter(s["items"], lambda i: i["supported"]))
    ) + F.size("_quiz")
    answers = staged.select(
        "answer_id", "mode", "summary", "partial_refusal", "suggested", supported.alias("supported_claim_count"),
        (supported > 0).alias("grounded"), (supported == 0).alias("refused"))
    claims = staged.select("answer_id", F.posexplode("_sections").alias("section_pos", "s")).select(
        "answer_id", "section_pos", "s.heading", F.posexplode("s.items").alias("item_pos", "i")
    ).select("answer_id", "section_pos", "heading", "item_pos", "i.text", "i.citations", "i.supported")
    quiz_rows = staged.filter("mode = 'quiz'").select("answer_id", F.posexplode("_quiz").alias("quiz_pos", "q")).select(
        "answer_id", "quiz_pos", "q.*")
    return answers, claims, quiz_rows


def supported_claims(claims: DataFrame, quiz: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supported count per answer, and the sources that are cited at all."""
    counted = claims.filter("supported").select("answer_id").unionByName(quiz.select("answer_id"))
    every = claims.select("answer_id").unionByName(quiz.select("answer_id")).distinct()
    count = every.join(counted.groupBy("answer_id").agg(F.count(F.lit(1)).alias("supported")), "answer_id", "left")
    count = count.fillna(0, ["supported"]).withColumn("grounded", F.col("supported") > 0).withColumn("refused", F.col("supported") == 0)
    cited = claims.select("answer_id", F.explode("citations").alias("source_id")).unionByName(
        quiz.select("answer_id", F.explode("citations").alias("source_id")))
    return count, sources.join(cited, ["answer_id", "source_id"], "left_semi")


def _suffix(citations: Column) -> Column:
    return F.array_join(F.transform(citations, lambda i: F.concat(F.lit("[来源"), i.cast("string"), F.lit("]"))), " ")


def render_markdown(answers: DataFrame, claims: DataFrame, quiz: DataFrame) -> DataFrame:
    """Markdown text of each answer, in one row like the answer it comes from."""
    line = lambda part, pos, sub, text: [F.lit(part).alias("part"), pos.alias("pos"), sub.alias("sub"), text.alias("line")]
    zero = F.lit(0)
    heads = claims.select("answer_id", "section_pos", "heading").distinct().select(
        "answer_id", *line(0, F.col("section_pos"), F.lit(-1), F.concat(F.lit("## "), F.col("heading"))))
    body = F.when(F.col("supported"), F.concat(F.lit("- "), F.col("text"), F.lit(" "), _suffix(F.col("citations")))).otherwise(
        F.concat(F.lit(f"- **{UNSUPPORTED}** "), F.col("text")))
    items = claims.select("answer_id", *line(0, F.col("section_pos"), F.col("item_pos"), body))
    number = (F.col("quiz_pos") + 1).cast("string")
    titles = quiz.select("answer_id").distinct()
    asked = quiz.select("answer_id", *line(1, F.col("quiz_pos"), zero, F.concat(
        number, F.lit(". **["), F.col("difficulty"), F.lit("]** "), F.col("question"))))
    solved = quiz.select("answer_id", *line(2, F.col("quiz_pos"), zero, F.concat(
        number, F.lit(". **答案：** "), F.col("answer"), F.lit("\n\n   **解析：** "), F.col("explanation"), F.lit(" "), _suffix(F.col("citations")))))
    refusals = answers.filter("partial_refusal IS NOT NULL").select(
        "answer_id", *line(3, zero, zero, F.concat(F.lit("> **课件未覆盖的部分：** "), F.col("partial_refusal"))))
    rows = heads
    for part in (items, titles.select("answer_id", *line(1, F.lit(-1), zero, F.lit("## 练习题"))), asked,
                 titles.select("answer_id", *line(2, F.lit(-1), zero, F.lit("## 答案与解析"))), solved, refusals):
        rows = rows.unionByName(part)
    text = F.array_join(F.sort_array(F.collect_list(F.struct("part", "pos", "sub", "line")))["line"], "\n\n")
    return rows.groupBy("answer_id").agg(trim_ws(text).alias("content"))


def normalize_answers(raw: DataFrame, limits: AnswerLimits = AnswerLimits()) -> tuple[DataFrame, DataFrame]:
    """Core answers and claims from model JSON, with example provenance made explicit.

    ``raw``: answer_id, json, question, grounding.  Returns answers (summary, core_hash, content)
    and claims (claim_id, section_pos, claim_pos, heading, text).
    """
    bare = F.regexp_replace(F.regexp_replace(trim_ws(F.col("json")), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    parsed = raw.withColumn("_j", F.from_json(bare, CORE_JSON)).filter("_j IS NOT NULL")
    told = parsed.select("answer_id", "question", "grounding", canonical_text(F.coalesce("_j.summary", F.lit("")), limits.summary).alias("summary"))
    drafts = parsed.select("answer_id", F.posexplode(_first(F.col("_j.sections"), limits.sections)).alias("s", "section"))
    rows = drafts.select("answer_id", "s", "section.heading", F.posexplode(_first(F.col("section.claims"), limits.items)).alias("c", "claim"))
    # A claim is a string or an object with a text.
    own = F.when(F.col("claim").startswith("{"), F.coalesce(F.get_json_object("claim", "$.text"), F.lit(""))).otherwise(F.col("claim"))
    rows = rows.withColumn("text", own).withColumn("text", canonical_text("text", limits.text)).filter("text <> ''").withColumn(
        "heading", canonical_text(F.coalesce("heading", F.lit("")), limits.heading)
    ).withColumn("heading", F.when(F.col("heading") == "", F.concat(F.lit("Section "), (F.col("s") + 1).cast("string"))).otherwise(F.col("heading")))

    def soften(c: str) -> Column:
        out = F.col(c)
        for pattern, replacement in OVERCLAIMS:
            out = F.regexp_replace(out, pattern, replacement)
        return out

    rows = rows.withColumn("text", soften("text"))
    told = told.withColumn("summary", soften("summary"))
    concrete = lambda c: F.col(c).rlike(EXAMPLE_WORDS) | F.col(c).rlike(EXAMPLE_TUPLE)
    labelled = lambda c: F.contains(F.col(c), F.lit(HYPOTHETICAL_LABEL)) | F.contains(F.col(c), F.lit(LECTURE_LABEL))
    flags = rows.groupBy("answer_id").agg(
        F.bool_or(concrete("text") | concrete("heading")).alias("_concrete"), F.bool_or(labelled("text")).alias("_labelled"),
        F.coalesce(F.min(F.when(F.col("heading").rlike(EXAMPLE_HEADING), F.col("s"))), F.min("s")).alias("_target"))
    told = told.join(flags, "answer_id", "left").filter("summary <> '' OR _target IS NOT NULL")
    no = F.lit(False)
    active = wants_example("question") | F.coalesce("_concrete", no) | concrete("summary")
    told = told.withColumn("_swap", active & ~F.col("grounding")).withColumn(
        "_add", F.col("_swap") & ~(F.coalesce("_labelled", no) | labelled("summary")))
    swap = lambda c: F.when(F.col("_swap"), F.replace(F.col(c), F.lit(LECTURE_LABEL), F.lit(HYPOTHETICAL_LABEL))).otherwise(F.col(c))
    rows = rows.join(told.select("answer_id", "_swap"), "answer_id").withColumn("text", swap("text")).drop("_swap")
    told = told.withColumn("summary", swap("summary"))
    headings = rows.select("answer_id", F.col("s").alias("_target"), "heading").distinct()
    added = told.filter("_add").select("answer_id", F.coalesce("_target", F.lit(0)).alias("_target")).join(
        headings, ["answer_id", "_target"], "left").select(
        "answer_id", F.col("_target").alias("s"), F.lit(-1).alias("c"), F.lit(ADDED_CLAIM).alias("text"),
        F.coalesce("heading", F.lit("Illustrative example")).alias("heading"))
    rows = rows.select("answer_id", "s", "c", "text", "heading").unionByName(added)

    # The claims of an answer came in one text: numbered and hashed inside one row.
    grouped = rows.groupBy("answer_id", "s").agg(
        F.max("heading").alias("heading"), F.sort_array(F.collect_list(F.struct("c", "text")))["text"].alias("texts"))
    packed = grouped.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("s", "heading", "texts"))).alias("_sections"))
    answers = told.select("answer_id", "question", "grounding", "summary").join(packed, "answer_id", "left").withColumn(
        "_sections", F.coalesce("_sections", F.array().cast("array<struct<s:int,heading:string,texts:array<string>>>")))

    def numbered(section: Column, i: Column) -> Column:
        place = (i + 1).cast("string")
        return F.struct(
            F.transform(section["texts"], lambda t, k: F.struct(
                F.concat(F.lit("claim-"), place, F.lit("-"), (k + 1).cast("string")).alias("id"), t.alias("text"))).alias("claims"),
            section["heading"].alias("heading"), F.concat(F.lit("section-"), place).alias("id"))

    answers = answers.withColumn("sections", F.transform("_sections", numbered)).drop("_sections")
    answers = answers.withColumn("core_hash", F.sha2(F.to_json(F.struct("sections", "summary")), 256))
    block = F.transform("sections", lambda s: F.concat(
        F.lit("## "), s["heading"], F.array_join(F.transform(s["claims"], lambda c: F.concat(F.lit("\n\n- "), c["text"])), "")))
    content = trim_ws(F.concat_ws("\n\n", F.nullif("summary", F.lit("")), F.array_join(block, "\n\n")))
    answers = answers.withColumn("content", content).withColumn("core_id", F.concat(F.lit("dynamic-"), F.substring("core_hash", 1, 16)))
    claims = answers.select("answer_id", F.posexplode("sections").alias("section_pos", "s")).select(
        "answer_id", "section_pos", "s.heading", F.posexplode("s.claims").alias("claim_pos", "c")).select(
        "answer_id", F.col("c.id").alias("claim_id"), "section_pos", "claim_pos", "heading", "c.text")
    return answers, claims


def history_window(turns: DataFrame, n: int = 20, limit: int | None = None, strip: bool = True) -> DataFrame:
    """The last ``n`` turns, then the usable ones among them, in order.

    ``turns``: conv_id, turn, role, text.  Without ``strip`` only white space is unified; texts are
    cut to ``limit`` characters where one is given.
    """
    last = top_k(turns, ["conv_id"], [F.col("turn").desc()], n, "_back").drop("_back")
    talk = last.filter(F.col("role").isin("user", "assistant"))
    if strip:
        plain = F.when(F.col("role") == "assistant", cut(strip_attribution("text"), limit)).otherwise(canonical_text("text", limit))
    else:
        plain = cut(normalize_ws("text"), limit)
    return talk.withColumn("content", plain).filter("content <> ''").select("conv_id", "turn", "role", "content")


def pack_history(window: DataFrame) -> DataFrame:
    """Message array per conversation from the few rows of ``history_window``."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return window.groupBy(F.col("conv_id").alias("query_id")).agg(
        F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("turns"))
