"""P27 keys and C1 terms of claims and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidar.functions.expr import col, first_match, let, one_of

# ---- fixed values -------------------------------------------------------------
HYPOTHETICAL_LABEL = "Hypothetical example - not taken directly from the lecture."
LECTURE_LABEL = "Lecture example - taken directly from the lecture."
TERM_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "each", "for", "from", "has", "have",
    "in", "is", "it", "its", "of", "on", "one", "or", "that", "the", "their", "this", "to",
    "used", "using", "while", "with", "within",
]
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}
CRITICAL_TERMS = [
    "0", "add", "alter", "chang", "change", "decreas", "decrease", "delet", "delete",
    "empty", "fix", "increas", "increase", "insert", "never", "no", "not", "null",
    "remov", "remove", "updat", "update", "without",
]
# suffix, shortest word it applies to, what replaces it
SUFFIXES = [("ies", 5, "y"), ("ing", 6, ""), ("ed", 5, "")]
# ---- end of fixed values ------------------------------------------------------


def words(text: Column | str) -> Column:
    """Lower-case words of canonical text, repeats kept."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def stem(word: Column) -> Column:
    rules = [(word == name, str(value)) for name, value in NUMBER_WORDS.items()]
    for suffix, shortest, replacement in SUFFIXES:
        cut = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(replacement))
        rules.append((word.endswith(suffix) & (F.length(word) >= shortest), cut))
    plural = word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3)
    rules.append((plural, F.substring(word, F.lit(1), F.length(word) - 1)))
    return first_match(rules, word)


def attribution_terms(text: Column | str) -> Column:
    """Stemmed content words of a claim or quote; provenance labels do not count."""
    plain = F.replace(F.replace(col(text), F.lit(HYPOTHETICAL_LABEL), F.lit("")), F.lit(LECTURE_LABEL), F.lit(""))
    kept = F.filter(words(plain), lambda w: ~one_of(w, TERM_STOP_WORDS))
    return F.filter(F.transform(kept, stem), lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]+$"))


def coverage_of(claim_terms: Column, evidence_terms: Column) -> Column:
    """Share of the claim's terms found in the evidence.

    Zero when a number or a term that changes the meaning is missing, or fewer
    than two terms match.
    """
    return let(F.array_distinct(claim_terms), lambda claim: coverage_in(claim, critical_in(claim), evidence_terms))


def critical_in(claim: Column) -> Column:
    """Terms of a claim that evidence must not miss."""
    return F.filter(claim, lambda w: w.rlike("^[0-9]+$") | one_of(w, CRITICAL_TERMS))


def coverage_in(claim: Column, critical: Column, evidence: Column) -> Column:
    """C3 for the distinct terms of a claim and those of them that must not miss."""
    return let(
        F.size(F.array_intersect(claim, evidence)),
        lambda hits: F.when(
            (F.size(claim) == 0) | (hits < 2) | (F.size(F.array_except(critical, evidence)) > 0), F.lit(0.0)).otherwise(hits / F.size(claim)),
    )


def content_key(**fields: Column) -> Column:
    """SHA-256 of the JSON of the fields in key order; NULL fields are left out."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)
