"""Fuzzy search for short license notices (operator 12).

A notice is words around a name that must stand exactly. What stands before and after the name may each differ by one edit (inserted, deleted
or replaced character) per ``EDIT_LENGTH`` characters. With k edits allowed, one of k + 1 pieces stands unchanged, so the pieces of
the longer side are seeds: one pass of an automaton finds them all, and the bounded-error matching of the regex library decides
around each seed. Texts are compared as lower-cased (A-Z) words joined by single blanks, so line breaks and punctuation don't matter, and a notice
begins and ends with whole words.

Rules: a NULL text is empty. Empty texts and texts without words have no places and score 0. Every row is scanned for itself: repeated rows and ids, NULL ids and
further columns (none is read) change nothing. Equal texts give equal results. Texts are read whole; a place is reported once per notice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidar.llm.common import blocks, text_bytes

BLOCK = 4 << 20
EDIT_LENGTH = 8
#: Bytes of a word as they are or lower-cased, any other byte as a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """Lower-cased words; ``name`` is one or more of them that must stand exactly."""

    label: str
    words: str
    name: str

    @property
    def sides(self) -> tuple[str, str]:
        before, after = f" {self.words} ".split(f" {self.name} ", 1)
        return (before + " ").lstrip(), (" " + after).rstrip()


#: Phrases whose exact places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices searched for with errors.
NOTICES = (
    Notice("mit", "released under the mit license", "mit"),
    Notice("mit", "licensed under the mit license", "mit"),
    Notice("mit", "distributed under the terms of the mit license", "mit"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "person"),
    Notice("apache", "licensed under the apache license version 2 0", "apache"),
    Notice("apache", "released under the apache license", "apache"),
    Notice("gpl", "licensed under the gnu general public license version 3", "gnu"),
    Notice("gpl", "licensed under the gnu general public license", "gnu"),
    Notice("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu"),
    Notice("lgpl", "licensed under the gnu lesser general public license", "lesser"),
    Notice("agpl", "licensed under the gnu affero general public license", "affero"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary"),
    Notice("bsd", "licensed under the bsd license", "bsd"),
    Notice("cc", "licensed under cc by nc 4 0", "cc"),
    Notice("cc", "licensed under cc by sa 4 0", "cc"),
    Notice("cc", "licensed under a creative commons attribution license", "creative"),
    Notice("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee"),
)


def allowed(side: str) -> int:
    """Edits that one side of a name may have."""
    return len(side) // EDIT_LENGTH


class Searcher:
    """Seeds and patterns of a list of notices; small and built once per task."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices, self.patterns = notices, []
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for k, notice in enumerate(notices):
            before, after = notice.sides
            parts = [f"(?:{regex.escape(side)}){{e<={allowed(side)}}}" if allowed(side) else regex.escape(side) for side in (before, after)]
            self.patterns.append(regex.compile(rf"(?e)(?<!\S){parts[0]}{regex.escape(notice.name)}{parts[1]}(?!\S)"))
            side, shift = (before, 0) if len(before) >= len(after) else (after, len(before) + len(notice.name))
            pieces, edits = allowed(side) + 1, allowed(before) + allowed(after)
            total = len(before) + len(notice.name) + len(after)
            for i in range(pieces):
                begin, end = len(side) * i // pieces, len(side) * (i + 1) // pieces
                # How far a place reaches before and after the end of this seed.
                seeds.setdefault(side[begin:end], []).append((k, shift + end + edits, total - shift - end + edits))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, uses)
        self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(notice number, begin, end, edits) in a text of words joined by blanks; places of a notice don't overlap."""
        windows: dict[int, list[list[int]]] = {}
        for last, uses in self.automaton.iter(text):
            for k, back, ahead in uses:
                begin, end = max(0, last + 1 - back), min(len(text), last + 1 + ahead)
                known = windows.setdefault(k, [])
                if known and begin <= known[-1][1]:
                    known[-1][0], known[-1][1] = min(known[-1][0], begin), max(known[-1][1], end)
                else:
                    known.append([begin, end])
        for k, found in windows.items():
            # Seeds come by their end; a window that begins earlier may still swallow its neighbour.
            merged: list[list[int]] = []
            for begin, end in sorted(found):
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            for begin, end in merged:
                for m in self.patterns[k].finditer(text, begin, min(len(text), end + 1)):
                    yield k, m.start(), m.end(), sum(m.fuzzy_counts)


SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, the exact phrase places, and the spans of notices.

    ``phrases``: array of (label, first_word) of every place. ``spans``: label, notice, begin and end (code points of the whole text, end
    excluded), first and last word (from 0) and edits of every place, by begin.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        searcher = Searcher(tuple(notices))
        exact = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        for block in blocks(batches, "body", BLOCK):
            n_words, places, spans = [], [], []
            for body in block.column("body").to_pylist():
                folded = body.translate(FOLD)
                words = folded.split()
                joined = b" %b " % b" ".join(words)
                n_words.append(len(words))
                found = []
                for phrase, label in exact:
                    at = joined.find(phrase)
                    while at >= 0:
                        found.append({"label": label, "first_word": joined.count(b" ", 0, at)})
                        at = joined.find(phrase, at + 1)
                places.append(found)
                text = joined[1:-1].decode(errors="replace")
                hits = sorted((begin, end, k, edits) for k, begin, end, edits in searcher.places(text))
                spans.append(located(body, folded, text, hits, searcher.notices) if hits else [])
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()),
                pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))), pa.array(spans, pa.list_(SPAN)),
            ], ["doc_id", "n_words", "phrases", "spans"])

    schema = (
        f"doc_id {kind}, n_words long, phrases array<struct<label:string,first_word:long>>, "
        "spans array<struct<label:string,notice:string,begin:long,end:long,first_word:long,last_word:long,edits:int>>"
    )
    return docs.select("doc_id", text_bytes().alias("body")).mapInArrow(run, schema)


def located(body: bytes, folded: bytes, text: str, hits: list, notices: tuple[Notice, ...]) -> list[dict]:
    """Spans with their places in the text as it was given."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
    out = []
    for begin, end, k, edits in hits:
        first, last = text.count(" ", 0, begin), text.count(" ", 0, end)
        start = len(body[: at[first][0]].decode(errors="replace"))
        out.append({
            "label": notices[k].label, "notice": notices[k].words, "begin": start,
            "end": start + len(body[at[first][0] : at[last][1]].decode(errors="replace")), "first_word": first, "last_word": last, "edits": edits,
        })
    return out


def op12_license_notices(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 12: exact phrases and notices of every whole text; the score is the best share of unedited characters."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    at = F.col("phrases.first_word")
    base = F.array_distinct("phrases.label")
    score = F.aggregate("spans", F.lit(0.0), lambda best, s: F.greatest(best, 1.0 - s["edits"] / F.char_length(s["notice"])))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.col("spans.label"))), ",").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(score).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"], s["begin"], s["end"], s["edits"])).alias("spans"),
    )
