"""Assessments: what a measure must be, as text or as a function of its Column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_INTERVAL = re.compile(rf"([\[(])\s*({_NUMBER})\s*,\s*({_NUMBER})\s*([\])])")
_COMPARE = re.compile(rf"(>=|<=|==|!=|>|<)\s*({_NUMBER})")
_MEMBER = re.compile(r"(not\s+in|in)\s*\[(.*)\]", re.S)
_APPLY = {
    ">=": lambda c, x: c >= x, "<=": lambda c, x: c <= x, "==": lambda c, x: c == x,
    "!=": lambda c, x: c != x, ">": lambda c, x: c > x, "<": lambda c, x: c < x,
}


def _literal(text: str):
    t = text.strip()
    return float(t) if re.fullmatch(_NUMBER, t) else t.strip("'\"")


def assess(must_be: str | Callable[[Column], Column], lenient: bool = False) -> Callable[[Column], Column]:
    """Column test for ``>= 3``, ``[0, 1)``, ``in [a, b]``, ``not in [..]`` or a function.

    A text that is none of these is a ValueError, or always true if ``lenient``.
    """
    if callable(must_be):
        return must_be
    t = (must_be or "").strip()
    if m := _INTERVAL.fullmatch(t):
        low, high = float(m[2]), float(m[3])
        if low >= high:
            raise ValueError(f"empty interval {t!r}")
        return lambda c: (c >= low if m[1] == "[" else c > low) & (c <= high if m[4] == "]" else c < high)
    if m := _COMPARE.fullmatch(t):
        return lambda c: _APPLY[m[1]](c, float(m[2]))
    if m := _MEMBER.fullmatch(t):
        values = [_literal(x) for x in m[2].split(",") if x.strip()]
        return lambda c: ~c.isin(values) if m[1].startswith("not") else c.isin(values)
    if lenient:
        return lambda c: F.lit(True)
    raise ValueError(f"no assessment: {must_be!r}")
