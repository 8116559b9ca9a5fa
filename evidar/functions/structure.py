"""Line classes, structural units and chunk pieces of one text, all inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidar.config import DEFAULT, Config
from evidar.functions.expr import SPACE, col, first_match, let, trim_ws, word
from evidar.functions.text import normalize_ws

# ---- fixed values: patterns, priorities and target sizes ---------------------
CODE_LINE = r"^```|^(?: {2,}|\t)|" + word("const|let|var|function|class|import|def|return")
TABLE_LINE = r"^\|.*\|$"
WIDE_GAP = r"[^\s\p{Z}\x{FEFF}][\s\p{Z}\x{FEFF}]{3,}[^\s\p{Z}\x{FEFF}]"
LIST_LINE = r"^(?:[-*•·▪◦]|\d+[.)]|[一二三四五六七八九十]+[、.])"
DEFINITION_LINE = r"(?i)^.{1,48}(?:是指|定义为|定义：|定义:| means | refers to )"
HEADING_LINES = [
    rf"^#{{1,6}}{SPACE}+",
    rf"^(?:\d+(?:\.\d+)*|[一二三四五六七八九十]+)[、.)]{SPACE}*[^\s\p{{Z}}\x{{FEFF}}]+",
    r"^(?=[A-Z0-9][A-Z0-9 &:/_-]{3,}$)(?=.*[A-Z])",
]
HEADING_MAX = 90
PRIORITY = {"list": 1, "definition": 2, "table": 3, "code": 4}
TARGET = {"definition": 760, "code": 900, "table": 1_000, "list": 1_000}
SENTENCE_END = "。！？.!?；;\n"
BREAK_TAIL, BREAK_HEAD = 240, 320
# ---- end of fixed values -----------------------------------------------------


def classify_line(line: Column | str) -> Column:
    """Class of one line; the first rule that holds decides."""
    line = col(line)
    value = trim_ws(line)
    heading = F.lit(False)
    for pattern in HEADING_LINES:
        heading = heading | value.rlike(pattern)
    return first_match(
        [
            (value == "", "blank"),
            (line.rlike(CODE_LINE), "code"),
            (value.rlike(TABLE_LINE) | line.rlike(WIDE_GAP), "table"),
            (value.rlike(LIST_LINE), "list"),
            (value.rlike(DEFINITION_LINE), "definition"),
            ((F.length(value) <= HEADING_MAX) & heading, "heading"),
        ],
        "prose",
    )


def segment_text(text: Column | str) -> Column:
    """Runs of lines of one class as ``array<struct<type, text>>``.

    A run starts where the class changes, after a blank and at every heading, so
    the run starts follow from the line classes without any sequential state.
    """

    def runs(whole: Column, lines: Column, kinds: Column) -> Column:
        n = F.size(lines)
        kind = lambda i: F.element_at(kinds, i)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == 1) | kind(i).isin("blank", "heading") | (kind(i) != kind(F.greatest(i - 1, F.lit(1)))),
        )
        units = let(
            starts,
            lambda b: F.transform(
                b,
                lambda at, k: F.struct(
                    kind(at).alias("type"),
                    normalize_ws(
                        F.array_join(F.slice(lines, at, F.coalesce(F.get(b, k + 1), n + 1) - at), "\n")
                    ).alias("text"),
                ),
            ),
        )
        kept = F.filter(units, lambda u: (u["type"] != "blank") & (u["text"] != ""))
        whole_unit = F.array(F.struct(F.lit("prose").alias("type"), whole.alias("text")))
        return let(kept, lambda u: F.when(F.size(u) > 0, u).otherwise(whole_unit))

    return let(
        normalize_ws(text),
        lambda whole: let(
            F.split(whole, "\n"),
            lambda lines: let(F.transform(lines, classify_line), lambda kinds: runs(whole, lines, kinds)),
        ),
    )


def structure_types(units: Column) -> Column:
    """Distinct classes of the units without headings, first seen first."""
    return F.array_distinct(F.filter(F.transform(units, lambda u: u["type"]), lambda kind: kind != "heading"))


def _priority(kind: Column) -> Column:
    return first_match(((kind == name, value) for name, value in PRIORITY.items()), 0)


def dominant_type(kinds: Column) -> Column:
    """P10: the class with the highest priority; prose when there is none."""
    ranked = F.transform(kinds, lambda k: F.struct(_priority(k).alias("p"), k.alias("kind")))
    return let(F.array_max(ranked), lambda top: F.when(top["p"] > 0, top["kind"]).otherwise(F.lit("prose")))


def target_size(kind: Column, cfg: Config = DEFAULT) -> Column:
    return first_match(((kind == name, size) for name, size in TARGET.items()), cfg.chunk_size)


def split_long(text: Column, target: Column, cfg: Config = DEFAULT) -> Column:
    """Overlapping windows of a text that end after a sentence where possible."""
    n = F.length(text)

    def window_end(start: Column) -> Column:
        ideal = F.least(n, start + target)
        low = F.greatest(start + BREAK_HEAD, ideal - BREAK_TAIL)
        tail = F.substring(text, low + 1, ideal - low + 1)
        upto = F.length(F.regexp_extract(tail, f"(?s)^(.*[{SENTENCE_END}])", 1))
        return F.when(ideal >= n, n).when(upto > 0, low + upto).otherwise(ideal)

    def step(state: Column, _: Column) -> Column:
        moved = let(
            window_end(state["start"]),
            lambda end: F.struct(
                F.when(end >= n, n).otherwise(F.greatest(state["start"] + 1, end - cfg.chunk_overlap)).alias("start"),
                (end >= n).alias("done"),
                F.concat(state["pieces"], F.array(F.substring(text, state["start"] + 1, end - state["start"]))).alias("pieces"),
            ),
        )
        return F.when(state["done"], state).otherwise(moved)

    # Every window advances by more than BREAK_HEAD - overlap characters.
    steps = F.sequence(F.lit(1), F.ceil(n / F.lit(BREAK_HEAD - cfg.chunk_overlap)).cast("int") + 1)
    begin = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("pieces"))
    pieces = F.aggregate(steps, begin, step, lambda state: state["pieces"])
    return F.filter(F.transform(pieces, normalize_ws), lambda p: p != "")


def section_segments(units: Column, title: Column, cfg: Config = DEFAULT) -> Column:
    """P12 first half: what is kept together, as ``array<struct<title, type, text>>``.

    Prose is packed up to the chunk size below the active heading; code, tables,
    lists and definitions stand alone.
    """
    segment = "array<struct<title:string,type:string,text:string>>"

    def one(state: Column, kind: Column, text: Column) -> Column:
        return F.array(F.struct(state["title"].alias("title"), kind.alias("type"), text.alias("text")))

    def flushed(state: Column) -> Column:
        return F.when(
            state["held"] != "", F.concat(state["done"], one(state, F.lit("prose"), state["held"]))
        ).otherwise(state["done"])

    def step(state: Column, unit: Column) -> Column:
        def next_state(new_title: Column, held: Column, done: Column) -> Column:
            return F.struct(new_title.alias("title"), held.alias("held"), done.alias("done"))

        overflow = (state["held"] != "") & (F.length(state["held"]) + 1 + F.length(unit["text"]) > cfg.chunk_size)
        return (
            F.when(unit["type"] == "heading", next_state(unit["text"], unit["text"], flushed(state)))
            .when(
                unit["type"] != "prose",
                next_state(state["title"], F.lit(""), F.concat(flushed(state), one(state, unit["type"], unit["text"]))),
            )
            .when(overflow, next_state(state["title"], unit["text"], flushed(state)))
            .otherwise(
                next_state(
                    state["title"],
                    F.when(state["held"] == "", unit["text"]).otherwise(F.concat_ws("\n", state["held"], unit["text"])),
                    state["done"],
                )
            )
        )

    begin = F.struct(title.alias("title"), F.lit("").alias("held"), F.array().cast(segment).alias("done"))
    return F.aggregate(units, begin, step, flushed)


def chunk_pieces(text: Column | str, title: Column | str, cfg: Config = DEFAULT) -> Column:
    """Chunks of one section as ``array<struct<title, content_type, structure_types, text>>``."""

    def row(t: Column, kind: Column, kinds: Column, body: Column) -> Column:
        return F.struct(
            t.alias("title"), kind.alias("content_type"), kinds.alias("structure_types"), body.alias("text")
        )

    def long(whole: Column) -> Column:
        segments = section_segments(segment_text(whole), col(title), cfg)
        return F.flatten(F.transform(
            segments,
            lambda s: F.transform(
                split_long(s["text"], target_size(s["type"], cfg), cfg),
                lambda piece: row(s["title"], s["type"], structure_types(segment_text(piece)), piece),
            ),
        ))

    def short(whole: Column) -> Column:
        return let(
            structure_types(segment_text(whole)),
            lambda kinds: F.array(row(col(title), dominant_type(kinds), kinds, whole)),
        )

    return let(
        normalize_ws(text),
        lambda whole: F.when(F.length(whole) <= cfg.chunk_size, short(whole)).otherwise(long(whole)),
    )
