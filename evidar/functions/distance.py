"""Edit distance of long texts: bit vectors along the diagonal, in a band that doubles until the distance fits it."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

FIRST_BAND = 32
STRIP = 4096


def positions(codes: np.ndarray, wanted: set[int]) -> dict[int, int]:
    """For each wanted code a whole number whose bit i says that place i holds it."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    bounds = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])) if len(codes) else np.zeros(1, int)
    bits, out = np.zeros(len(codes), np.uint8), {}
    for begin, end in zip(bounds[:-1], bounds[1:]):
        if (code := int(ranked[begin])) in wanted:
            at = order[begin:end]
            bits[at] = 1
            out[code] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            bits[at] = 0
    return out


def within(long: np.ndarray, short: np.ndarray, k: int) -> int | None:
    """Edit distance of two code arrays if it is at most ``k``; ``k`` is at most the longer length and at least the difference of lengths.

    The cells of one column that lie within ``k`` of the diagonal are one number of 2k + 2 bits, shifted by one place from column to
    column; a column costs a dozen operations on such numbers.
    """
    m, n = len(long), len(short)
    width = 2 * k + 2
    full, top, low = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    up, down, distance = ((1 << (k + 1)) - 1) << (width - k - 1), 0, k
    most = 2 * k + n - m
    strip = max(STRIP, 2 * width)
    for begin in range(0, n, strip):
        text = short[begin : begin + strip].tolist()
        base = max(0, begin + k + 1 - width)
        places = positions(long[base : begin + strip + k + 1], set(text))
        for i, code in enumerate(text, begin):
            same = places.get(code, 0)
            if same:
                shift = i + k + 1 - width - base
                same = (same >> shift if shift >= 0 else same << -shift) & full
            level = ((((same & up) + up) ^ up) | same | down) & full
            right = down | (full ^ (level | up))
            left = level & up
            if i < m - k:
                distance += not level & top
                if distance > most:
                    return None
            else:
                distance += bool(right & low) - bool(left & low)
                low >>= 1
            level >>= 1
            up = left | (full ^ (level | right))
            down = level & right
    return distance if distance <= k else None


def edit_steps(a: str, b: str) -> int:
    """Fewest inserted, deleted and replaced code points between two texts."""
    head = len(os.path.commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    long, short = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    k = max(FIRST_BAND, len(a) - len(b))
    while True:
        k = min(k, len(a))
        found = within(long, short, k)
        if found is not None:
            return found
        k *= 2


def edit_distance(left: Column, right: Column) -> Column:
    """Edit distance in code points, as ``levenshtein`` gives it; NULL if a text is NULL.

    Work grows with the longer length times the distance, over 64. Equal texts are settled without Python.
    """
    @F.pandas_udf(LongType())
    def steps(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edit_steps(x, y) for x, y in zip(a, b)], dtype="Int64")

    differ = left != right
    return F.when(left == right, F.lit(0).cast("long")).otherwise(steps(F.when(differ, left), F.when(differ, right)))
