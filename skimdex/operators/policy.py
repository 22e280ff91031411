"""Per file: skip it, look its rows up in the index, or scan it in full."""

from __future__ import annotations

from enum import Enum

from .choose import Candidate
from .intervals import Interval, compare

#: Above this share of a file's keys an index doesn't pay.
FULL_SCAN_THRESHOLD = 0.2
#: Above this ratio of an index's bytes to those of the files it may rule out, looking keys up doesn't pay.
SIZE_RATIO = 0.7


class Verdict(Enum):
    SKIP = -1
    USE = 0
    FULL = 1


def bounds(c: Candidate) -> list[tuple[Interval, ...]]:
    """The key space of a candidate as boxes: an interval for each matched column."""
    head = tuple(i for _, i in c.equal)
    return [(*head, i) for i in c.last[1]] if c.last else [head]


def _tuple_compare(a: tuple, b: tuple) -> int:
    return next((d for x, y in zip(a, b, strict=False) if (d := compare(x, y))), 0)


def outside(box: tuple[Interval, ...], low: tuple, high: tuple) -> bool:
    """Whether no key between ``low`` and ``high`` (in key order) can lie in ``box``."""
    starts = tuple(i.low for i in box)
    ends = tuple(i.high for i in box)
    starts = starts[: starts.index(None)] if None in starts else starts
    ends = ends[: ends.index(None)] if None in ends else ends
    after = _tuple_compare(starts, high) if starts else -1
    before = _tuple_compare(ends, low) if ends else 1
    if after > 0 or before < 0:
        return True
    return after == 0 and len(starts) == len(high) and not box[len(starts) - 1].low_in or before == 0 and len(ends) == len(low) and not box[len(ends) - 1].high_in


def inside(boxes: list[tuple[Interval, ...]], key: tuple) -> bool:
    return any(all(i.holds(v) for i, v in zip(box, key, strict=False)) for box in boxes)


def sample_coverage(boxes, sample: list[tuple]) -> float | None:
    return sum(inside(boxes, k) for k in sample) / len(sample) if sample else None


def part_coverage(boxes, parts: list[tuple]) -> float | None:
    """Share of rows by equi-depth parts ``(low, high, rows up to high)``; a part that is cut counts half."""
    if not parts:
        return None
    total, covered, before = parts[-1][2], 0.0, 0
    for low, high, upto in parts:
        hit = [box for box in boxes if not outside(box, low, high)]
        share = 1.0 if any(inside([box], low) and inside([box], high) for box in hit) else 0.5 if hit else 0.0
        covered += share * (upto - before)
        before = upto
    return covered / total if total else None


def verdict(c: Candidate, stats: dict | None, bloom_hits: bool | None = None, threshold: float = FULL_SCAN_THRESHOLD) -> Verdict:
    """``stats``: a row of file statistics, keys as tuples; None: the file has no index, or a stale one.

    Its sample may be there as keys, or as the share of them that is asked for.
    """
    if stats is None:
        return Verdict.FULL
    boxes = bounds(c)
    if not boxes:
        return Verdict.SKIP
    plain = [b for b in boxes if not any(i.null for i in b)]
    null_possible = len(boxes) > len(plain) and stats["nulls"] > 0
    if len(c.index.columns) > 1 and stats["nulls"]:
        null_possible = True  # a null beside the matched columns; bounds and samples don't speak of it
    if not null_possible:
        if stats["low"] is None or all(outside(b, stats["low"], stats["high"]) for b in plain):
            return Verdict.SKIP
        if bloom_hits is False and len(plain) == len(boxes):
            return Verdict.SKIP
    sampled = sample_coverage(plain, stats["sample"]) if "sample" in stats else stats["share"]
    shares = [x for x in (sampled, part_coverage(plain, stats["parts"])) if x is not None]
    return Verdict.FULL if shares and sum(shares) / len(shares) > threshold else Verdict.USE


def combined(verdicts: list[Verdict]) -> Verdict:
    """Of several indexes on one file: any skip skips; all full is full; else all are used."""
    if Verdict.SKIP in verdicts:
        return Verdict.SKIP
    return Verdict.FULL if all(v is Verdict.FULL for v in verdicts) else Verdict.USE

