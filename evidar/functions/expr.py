"""Small column helpers used by every operator."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the web understands it: ASCII blanks, Unicode separators, BOM.
SPACE = r"[\s\p{Z}\x{FEFF}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Catalyst inlines a projected expression into lambdas, where it would be
    evaluated again for every array element; a lambda variable is not inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def half_up(c: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(c + F.lit(0.5))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def cut(c: Column | str, limit: int | None) -> Column:
    """The first ``limit`` characters; the whole text without a limit."""
    return col(c) if limit is None else F.substring(col(c), 1, limit)


def word(pattern: str) -> str:
    """ASCII word boundaries on both sides of ``pattern``."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """First rule whose condition holds gives the value."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def safe_number(c: Column) -> Column:
    """String or number to a finite double, NULL otherwise."""
    number = c.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def one_of(c: Column, words: Iterable[str]) -> Column:
    """Whether a text without spaces is one of ``words``; a single literal, so cheap to plan."""
    return F.contains(F.lit(" " + " ".join(words) + " "), F.concat(F.lit(" "), c, F.lit(" ")))
