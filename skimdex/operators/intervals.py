"""Sets of key values as sorted lists of intervals, with an extra member for null."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cmp_to_key
from typing import Any


def compare(a: Any, b: Any) -> int:
    """Spark's order of non-null values of one type: text by its bytes, NaN above all numbers."""
    if isinstance(a, str):
        a, b = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    if isinstance(a, float) and math.isnan(a):
        return 0 if isinstance(b, float) and math.isnan(b) else 1
    if isinstance(b, float) and math.isnan(b):
        return -1
    return (a > b) - (a < b)


@dataclass(frozen=True)
class Interval:
    """Values from ``low`` to ``high``; None is no bound. ``null``: just the null key."""

    low: Any = None
    high: Any = None
    low_in: bool = True
    high_in: bool = True
    null: bool = False

    @property
    def point(self) -> bool:
        return not self.null and self.low is not None and self.high is not None and self.low_in and self.high_in and compare(self.low, self.high) == 0

    @property
    def empty(self) -> bool:
        if self.null or self.low is None or self.high is None:
            return False
        order = compare(self.low, self.high)
        return order > 0 or order == 0 and not (self.low_in and self.high_in)

    def holds(self, value: Any) -> bool:
        if value is None or self.null:
            return value is None and self.null
        if self.low is not None and ((c := compare(value, self.low)) < 0 or c == 0 and not self.low_in):
            return False
        return self.high is None or (c := compare(value, self.high)) < 0 or c == 0 and self.high_in


NULL, NOT_NULL = Interval(null=True), Interval()


def _low(a: Interval, b: Interval) -> int:
    if a.low is None or b.low is None:
        return (b.low is None) - (a.low is None)
    return compare(a.low, b.low) or a.low_in * -1 + b.low_in


def _high(a: Interval, b: Interval) -> int:
    if a.high is None or b.high is None:
        return (a.high is None) - (b.high is None)
    return compare(a.high, b.high) or a.high_in - b.high_in


def _meet(a: Interval, b: Interval) -> bool:
    """Whether b, which doesn't start before a, overlaps or adjoins it."""
    if a.high is None or b.low is None:
        return True
    order = compare(b.low, a.high)
    return order < 0 or order == 0 and (a.high_in or b.low_in)


def union(intervals: list[Interval]) -> list[Interval]:
    """The null member first, then disjoint intervals in order."""
    plain = sorted((x for x in intervals if not x.null and not x.empty), key=cmp_to_key(_low))
    out: list[Interval] = []
    for x in plain:
        if out and _meet(out[-1], x):
            last = out.pop()
            top = last if _high(last, x) >= 0 else x
            out.append(Interval(last.low, top.high, last.low_in, top.high_in))
        else:
            out.append(x)
    return [NULL] * any(x.null for x in intervals) + out


def intersect(a: list[Interval], b: list[Interval]) -> list[Interval]:
    out = [NULL] * (any(x.null for x in a) and any(x.null for x in b))
    for x in a:
        for y in b:
            if not (x.null or y.null):
                low, high = (y if _low(x, y) < 0 else x), (x if _high(x, y) <= 0 else y)
                out.append(Interval(low.low, high.high, low.low_in, high.high_in))
    return union([x for x in out if not x.empty])


def prefix(text: str) -> Interval:
    """Every text that begins with ``text``, as a range: from it up to the next text of its length."""
    head = text
    while head:
        code = ord(head[-1]) + 1
        code = 0xE000 if 0xD800 <= code < 0xE000 else code
        if code < 0x110000:
            return Interval(text, head[:-1] + chr(code), True, False)
        head = head[:-1]
    return Interval(text, None, True, True) if text else NOT_NULL
