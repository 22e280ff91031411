"""Intervals, index choice and the per-file verdict, without data."""

from hypothesis import given
from hypothesis import strategies as st

from skimdex.operators.choose import candidate, choose
from skimdex.operators.intervals import NOT_NULL, NULL, Interval, intersect, prefix, union
from skimdex.operators.policy import Verdict, combined, outside, verdict
from skimdex.sources.catalog import IndexMeta

BOUND = st.one_of(st.none(), st.integers(-4, 4))
PIECES = st.lists(st.one_of(st.just(NULL), st.builds(Interval, BOUND, BOUND, st.booleans(), st.booleans())), max_size=4)
VALUES = [None, *(x / 2 for x in range(-10, 11))]


def members(pieces):
    return {v for v in VALUES if any(p.holds(v) for p in pieces)}


@given(PIECES, PIECES)
def test_union_and_intersect_are_those_of_sets(a, b):
    assert members(union([*a, *b])) == members(a) | members(b)
    assert members(intersect(a, b)) == members(a) & members(b)


@given(PIECES)
def test_union_is_disjoint_and_in_order(a):
    plain = [x for x in union(a) if not x.null]
    for x, y in zip(plain, plain[1:]):
        assert x.high is not None and y.low is not None and x.high <= y.low


@given(st.text(max_size=3), st.text(max_size=5))
def test_prefix_holds_just_what_starts_with_it(head, text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in head + text):
        assert prefix(head).holds(text) == text.startswith(head)


def index(name, *columns, kind="btree"):
    return IndexMeta(name, kind, list(columns), [True] * len(columns))


def point(x):
    return [Interval(x, x)]


def test_composite_takes_equal_columns_and_one_range():
    c = candidate(index("i", "a", "b", "c"), {"a": point(1), "b": [Interval(2, 5)], "c": point(3)})
    assert [n for n, _ in c.equal] == ["a"] and c.last[0] == "b"
    assert candidate(index("i", "a", "b"), {"b": point(1)}) is None


def test_bitmap_serves_single_values_only():
    assert candidate(index("i", "a", kind="bitmap"), {"a": [Interval(1, 1), Interval(5, None)]}) is None
    assert candidate(index("i", "a", kind="bitmap"), {"a": [NULL, Interval(1, 1)]}) is not None


def test_choice_prefers_the_better_match_and_disjoint_columns():
    found = choose([index("wide", "a", "b", "c"), index("one", "a"), index("other", "d")], {"a": point(1), "d": [Interval(1, 9)]}, most=2)
    assert [c.index.name for c in found] == ["one", "other"]
    assert [c.index.name for c in choose([index("one", "a")], {"a": point(1)}, disabled={"one"})] == []


def stats(low, high, sample=(), nulls=0):
    return {"rows": 10, "nulls": nulls, "low": (low,), "high": (high,), "sample": [(x,) for x in sample], "parts": [((low,), (high,), 10)]}


def test_verdicts():
    c = candidate(index("i", "a"), {"a": [Interval(10, 20)]})
    assert verdict(c, None) is Verdict.FULL
    assert verdict(c, stats(21, 30)) is Verdict.SKIP
    assert verdict(c, stats(0, 9)) is Verdict.SKIP
    assert verdict(c, stats(0, 1000, range(0, 1000, 50))) is not Verdict.SKIP
    assert verdict(c, stats(10, 20, range(10, 21))) is Verdict.FULL
    nulls = candidate(index("i", "a"), {"a": [NULL]})
    assert verdict(nulls, stats(0, 9)) is Verdict.SKIP and verdict(nulls, stats(0, 9, nulls=2)) is not Verdict.SKIP
    assert combined([Verdict.USE, Verdict.SKIP]) is Verdict.SKIP and combined([Verdict.FULL, Verdict.USE]) is Verdict.USE


@given(BOUND, BOUND, st.booleans(), st.booleans(), st.integers(-4, 4), st.integers(0, 4))
def test_outside_never_rules_out_a_member(low, high, low_in, high_in, start, size):
    box = Interval(low, high, low_in, high_in)
    if not box.empty and outside((box,), (start,), (start + size,)):
        assert not any(box.holds(v) for v in range(start, start + size + 1))


def test_no_bound_is_not_null():
    assert NOT_NULL.holds(1) and not NOT_NULL.holds(None)
