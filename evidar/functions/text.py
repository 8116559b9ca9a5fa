"""Text scalars: normalisation, tokens, hints, redaction."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evidar.config import DEFAULT, Config
from evidar.functions.expr import (
    SPACE, clamp, col, cut, empty_strings, first_match, let, one_of, trim_ws, word,
)

# ---- fixed values: word lists and patterns that decide the results ----------
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "how", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "what", "when", "where", "which", "who", "why", "with",
]
HAN_STOP_TOKENS = [
    "一个", "一些", "什么", "如何", "可以", "这个", "这些", "那个", "那些",
    "我们", "你们", "他们", "是否", "怎么", "为什么", "请问", "一下",
]
HAN_STOP_PHRASES = (
    "请问|这份|当前|课件中|课件里|课件|文档中|文档里|文档|关于|相关|具体|一下|如何|怎么|"
    "为什么|是什么|有哪些|是否|可以|进行|请|的"
)
LATIN_TOKEN = r"[a-z0-9][a-z0-9._+-]*"
HAN = r"[\x{3400}-\x{9fff}]"
PART_BREAKS = "[？?；;。]|以及|并且|同时|分别|对比|比较"
EXPANSIONS = [
    ("图表|图像|图片|figure|chart|graph", "图表 趋势 坐标轴 图例 数据关系 diagram figure chart graph"),
    ("对比|比较|区别|异同|差异", "比较 区别 相同点 不同点 优缺点 versus difference"),
    ("代码|程序|函数|算法", "代码 函数 输入 输出 执行流程 example implementation"),
    ("总结|概览|知识结构|整体", "主题 学习目标 核心概念 结构 overview outline summary"),
    ("机制|原理|为什么|如何工作", "机制 原理 步骤 因果 过程 mechanism process"),
]
TYPE_HINTS = [
    ("图表|趋势|曲线|柱状|饼图|流程图|示意图|图片|figure|chart|graph|diagram|image", "visual"),
    ("表格|table", "table"),
    ("代码|code|函数|程序", "code"),
    ("定义|概念|是指", "definition"),
    ("列表|步骤|要点", "list"),
]
WHOLE = "整份课件|整个课件|这份课件|本课件|文档|这节课|本节课"
DOCUMENT_WIDE = [
    "知识结构|内容结构|整体框架|课程框架|主要内容|全部内容|学了什么|覆盖哪些内容",
    f"(?:概览|梳理|总结|介绍|讲解|分析|学习).{{0,18}}(?:{WHOLE}|全部内容|知识结构)",
    f"(?:{WHOLE}).{{0,18}}(?:概览|梳理|总结|介绍|讲解|分析|全部|内容|知识结构)",
    word("overview|outline|knowledge structure|whole document|entire lecture|lecture overview|full lecture"),
]
PAGE_HINT = r"(?i)(\d{1,3})[\s\p{Z}\x{FEFF}]*(?:页|幻灯片|slide)"
SECRET_KEY = (
    "(?i)api[_-]?key|authorization|cookie|password|secret|session[_-]?token|access[_-]?token"
)
SECRET_VALUES = [
    r"(?i)(?<![A-Za-z0-9_])Bearer[\s\p{Z}\x{FEFF}]+[A-Za-z0-9._~+/=-]{8,}",
    r"(?i)(?<![A-Za-z0-9_])sk-[A-Za-z0-9_-]{8,}",
]
REDACTED = "[REDACTED]"
METADATA_KEYS = [
    "answerPackVersion", "appVersion", "buildCommit", "citationMapVersion",
    "materialHash", "materialVersion", "modelVersion", "promptVersion",
]
DETAILED = word(
    "detailed|in detail|in[- ]depth|step[- ]by[- ]step|thorough|thoroughly|comprehensive|"
    "elaborate|fully explain|deep dive"
)
BRIEF = word("brief|briefly|concise|concisely|short|shortly|quick|quickly|one sentence|define")
BRIEF_START = (
    r"^(?:what is|what are|what does|what do|how many|state the difference|define)(?![A-Za-z0-9_])"
)
WANTS_EXAMPLE = "(?i)" + word(
    "example|examples|scenario|illustrate|illustration|analogy|vivid|concrete case|worked example"
)
# ---- end of fixed values -----------------------------------------------------


def normalize_ws(c: Column | str) -> Column:
    """Drop NUL, unify line ends, collapse blanks, keep at most one empty line."""
    text = F.regexp_replace(F.translate(col(c), "\u0000", ""), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[\t\f\x0B ]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    return trim_ws(F.regexp_replace(text, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def canonical_text(c: Column | str, limit: int | None = None) -> Column:
    """Compatibility-normalised text, white space unified, cut to ``limit`` where one is given."""
    return cut(normalize_ws(nfkc(col(c))), limit)


def infer_title(c: Column | str, fallback: Column) -> Column:
    """First line of 2..100 characters that is not a bullet."""
    lines = F.transform(F.split(col(c), "\n"), trim_ws)
    fits = F.filter(
        lines,
        lambda line: F.length(line).between(2, 100) & ~line.rlike(r"^[•·▪◦*-]"),
    )
    return F.coalesce(F.try_element_at(fits, F.lit(1)), fallback)


def is_meaningful(c: Column | str) -> Column:
    """At least 24 characters and one Han, Latin or digit character."""
    return let(
        normalize_ws(c),
        lambda t: (F.length(t) >= 24) & t.rlike(r"[\x{3400}-\x{9fff}A-Za-z0-9]"),
    )


def comparable_text(c: Column | str) -> Column:
    """Lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(col(c)), r"[\s\p{Z}\x{FEFF}\p{P}\p{S}]+", "")


def _han_tokens(text: Column) -> Column:
    kept = lambda t: ~one_of(t, HAN_STOP_TOKENS)

    def from_run(run: Column) -> Column:
        single = F.when(F.length(run) == 1, F.array(run)).otherwise(empty_strings())
        whole = F.when((F.length(run) <= 8) & kept(run), F.array(run)).otherwise(empty_strings())
        pairs = F.when(
            F.length(run) >= 2,
            F.filter(
                F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))),
                kept,
            ),
        ).otherwise(empty_strings())
        return F.concat(single, whole, pairs)

    runs = F.regexp_extract_all(F.regexp_replace(text, HAN_STOP_PHRASES, " "), F.lit(f"({HAN}+)"), F.lit(1))
    return F.flatten(F.transform(runs, from_run))


def tokenize_normalized(text: Column) -> Column:
    """Tokens of text that is already normalised and lower-cased."""
    latin = F.filter(
        F.regexp_extract_all(text, F.lit(f"({LATIN_TOKEN})"), F.lit(1)),
        lambda t: (F.length(t) > 1) & ~one_of(t, STOP_WORDS),
    )
    return F.when(text.rlike(HAN), F.concat(latin, _han_tokens(text))).otherwise(latin)


def tokenize(c: Column | str) -> Column:
    """Latin words without stop words, then Han runs and their bigrams.

    White space never belongs to a token, so only NUL has to go beforehand.
    """
    return let(F.lower(F.translate(F.coalesce(col(c), F.lit("")), "\u0000", "")), tokenize_normalized)


def question_variants(c: Column | str) -> Column:
    """The question, its parts and vocabulary expansions; distinct, first five."""

    def build(question: Column) -> Column:
        parts = F.filter(
            F.transform(F.split(question, PART_BREAKS), normalize_ws), lambda p: F.length(p) >= 4
        )
        extra = [
            F.when(question.rlike(f"(?i){pattern}"), F.concat(question, F.lit(" " + words)))
            for pattern, words in EXPANSIONS
        ]
        everything = F.concat(F.array(question), parts, F.array_compact(F.array(*extra)))
        return F.slice(F.array_distinct(everything), 1, 5)

    return let(normalize_ws(c), build)


def page_hint(c: Column | str) -> Column:
    """Page or slide number named in the question."""
    return F.nullif(F.regexp_extract(col(c), PAGE_HINT, 1), F.lit("")).cast("int")


def type_hint(c: Column | str) -> Column:
    """Content type asked for in the question; the first pattern wins."""
    return first_match(((col(c).rlike(f"(?i){p}"), name) for p, name in TYPE_HINTS))


def structure_boost(title_hit: Column, type_hit: Column, page_hit: Column, cfg: Config = DEFAULT) -> Column:
    """Additive boosts for a title word, the asked type and the asked page."""

    def part(hit: Column, weight: float) -> Column:
        return F.when(F.coalesce(hit, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))

    return part(title_hit, cfg.title_boost) + part(type_hit, cfg.type_boost) + part(page_hit, cfg.page_boost)


def evidence_reliability(weight: Column | str, origin: Column | str, confidence: Column | str) -> Column:
    """P20: explicit weight, else by text origin and OCR confidence."""
    share = clamp(F.coalesce(col(confidence).cast("double"), F.lit(0.0)), 0.0, 100.0) / 100.0
    return (
        F.when(col(weight).isNotNull(), clamp(col(weight).cast("double"), 0.45, 1.0))
        .when(col(origin) == "ocr", F.lit(0.5) + share * 0.45)
        .when(col(origin) == "mixed", F.lit(0.72) + share * 0.25)
        .when(col(origin) == "vision", F.lit(0.72))
        .otherwise(F.lit(1.0))
    )


def is_document_wide(question: Column | str, mode: Column | str) -> Column:
    """Review mode, or a question about the whole document."""
    text = F.lower(normalize_ws(question))
    asked = F.lit(False)
    for pattern in DOCUMENT_WIDE:
        asked = asked | text.rlike(pattern)
    return F.coalesce(col(mode) == "review", F.lit(False)) | F.coalesce(asked, F.lit(False))


def strip_attribution_normalized(text: Column) -> Column:
    text = F.regexp_replace(
        text,
        r"(?i)[\s\p{Z}\x{FEFF}]*\[(?:source|citation|来源)[\s\p{Z}\x{FEFF}]*\d+\]",
        "",
    )
    text = F.regexp_replace(text, r"[\s\p{Z}\x{FEFF}]*\[\d+\](?=[\s\p{Z}\x{FEFF}]|$|[.,;:!?])", "")
    return trim_ws(F.regexp_replace(text, r"[ \t]+\n", "\n"))


def strip_attribution(c: Column | str) -> Column:
    """P25: remove source and citation markers from an answer."""
    return strip_attribution_normalized(canonical_text(c))


def redact_text(c: Column | str, limit: int | None = None) -> Column:
    """Replace credential-shaped values in free text."""
    text = cut(c, limit)
    for pattern in SECRET_VALUES:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


#: A quoted credential name and its value, in text that cannot be parsed as JSON; quotes may be escaped.
NAMED = re.compile(
    r'(\\*")([^"\\]{0,200}?(?:%s)[^"\\]{0,200})\1\s*:\s*(?:(\\*")(?:(?!\3).)*(?:\3|$)|[^\s",\[{}\]]+|(?=[\[{]))' % SECRET_KEY.removeprefix("(?i)"),
    re.DOTALL | re.IGNORECASE,
)


def _names_redacted(text: str) -> str:
    """Text without the values of credential-named entries; where such a value is an object or a list, all from there on goes."""
    out, done = [], 0
    for m in NAMED.finditer(text):
        out.append(f"{text[done : m.start()]}{m[1]}{m[2]}{m[1]}:{m[1]}{REDACTED}{m[1]}")
        done = m.end()
        if text[done : done + 1] in ("{", "["):
            return "".join(out)
    return "".join([*out, text[done:]]) if out else text


def _without_secrets(text: str | None) -> str | None:
    """JSON text whose credential-named keys lose their value at every depth, in JSON held as strings too.

    Fails closed: what cannot be parsed, as it is broken or nested too deeply, loses such values by their names in the text.
    """
    if not text or text.lstrip()[:1] not in ("{", "[", '"'):
        return text
    try:
        body = json.loads(text)
        if isinstance(body, str):
            inner = _without_secrets(body)
            return text if inner == body else json.dumps(inner, ensure_ascii=False)
        found, todo = False, [body]
        while todo:
            node = todo.pop()
            entries = node.items() if isinstance(node, dict) else enumerate(node)
            for key, value in list(entries):
                if isinstance(key, str) and re.search(SECRET_KEY, key):
                    node[key], found = REDACTED, True
                elif isinstance(value, (dict, list)):
                    todo.append(value)
                elif isinstance(value, str) and (inner := _without_secrets(value)) != value:
                    node[key], found = inner, True
        return json.dumps(body, ensure_ascii=False, separators=(",", ":")) if found else text
    except (ValueError, RecursionError):
        return _names_redacted(text)


@F.pandas_udf(StringType())
def _keys_redacted(values: pd.Series) -> pd.Series:
    return values.map(_without_secrets, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _all_keys_redacted(values: pd.Series) -> pd.Series:
    return values.map(lambda texts: None if texts is None else [_without_secrets(t) for t in texts])


def redact_json(c: Column | str) -> Column:
    """P28 on JSON text: credential-named keys lose their value at every depth, also in JSON held as text; then ``redact_text``.

    Text that is no JSON loses the values that follow quoted names of that kind; all text passes through ``redact_text``.
    """
    return redact_text(_keys_redacted(col(c)))


def redact_map(c: Column | str) -> Column:
    """P28 on a string map: credential-named keys lose their value, values that are JSON lose theirs at every depth."""
    values = _all_keys_redacted(F.map_values(col(c)))
    return F.transform_values(
        F.map_from_arrays(F.map_keys(col(c)), values),
        lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(redact_text(v)),
    )


def sanitize_metadata(c: Column | str) -> Column:
    """Allow-listed keys with a scalar value, redacted; a value that is the text of an object or a list is dropped."""
    kind = lambda v: F.schema_of_variant(F.try_parse_json(v))
    scalar = lambda v: ~F.coalesce(kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY"), F.lit(False))
    # An object too broken or too deep to be parsed is no scalar either.
    kept = F.map_filter(col(c), lambda k, v: k.isin(METADATA_KEYS) & v.isNotNull() & ~F.ltrim(v).startswith("{") & scalar(v))
    return redact_map(kept)


def safe_identifier(c: Column | str, fallback: str | Column, limit: int | None = None) -> Column:
    """Letters, digits, underscore and hyphen only; a fallback when nothing remains."""
    kept = cut(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^A-Za-z0-9_-]", ""), limit)
    return F.coalesce(F.nullif(kept, F.lit("")), fallback if isinstance(fallback, Column) else F.lit(fallback))


def question_style(c: Column | str) -> Column:
    """How long an answer the question asks for."""
    return let(
        F.lower(normalize_ws(c)),
        lambda q: F.when(q.rlike(DETAILED), "detailed")
        .when(q.rlike(BRIEF) | q.rlike(BRIEF_START), "brief")
        .otherwise("normal"),
    )


def wants_example(c: Column | str) -> Column:
    return normalize_ws(c).rlike(WANTS_EXAMPLE)


def token_jaccard(left: Column, right: Column) -> Column:
    """Shared share of distinct tokens; zero when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def unit(c: Column | str) -> Column:
    """Vector of length one; NULL for a missing, empty or zero vector."""
    norm = F.sqrt(dot(col(c), col(c)))
    return let(norm, lambda n: F.when(n > 0, F.transform(col(c), lambda x: x.cast("double") / n)))


def cosine(left: Column | str, right: Column | str) -> Column:
    """J4 scalar: zero for missing, empty, mismatched or zero-length vectors."""
    a, b = col(left), col(right)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(usable, let(norm, lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))
