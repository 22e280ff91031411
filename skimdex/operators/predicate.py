"""Predicates: Catalyst's own optimised condition, reduced to what an index can answer.

The predicate is analysed and optimised against the table's schema, so that literals are already of their column's
type (a comparison that no value of that type can meet is gone) and of the session's time zone. A conjunct is usable
if all its leaves are about one column and it is made of AND, OR, IN, comparisons with a literal, IS [NOT] NULL and
prefix matches. It becomes a set of intervals of that column. All other conjuncts are left to the filter that every
scan applies again in full.

Bounds are Spark's internal values: microseconds for timestamps, days for dates.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .intervals import NOT_NULL, NULL, Interval, intersect, prefix, union


@dataclass
class Compiled:
    """For each column (lower case) the values that can pass; ``never``: no row can."""

    ranges: dict[str, list[Interval]] = field(default_factory=dict)
    never: bool = False


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _children(node) -> list:
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def _column(node) -> str | None:
    return node.name() if _kind(node) == "AttributeReference" else None


_MISSING = object()
_PLAIN = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def _value(kind: str, value):
    """The Python value of an internal one, or ``_MISSING``."""
    if value is None:
        return None
    if kind == "string":
        return value.toString() if hasattr(value, "toString") else str(value)
    if kind.startswith("decimal"):
        return decimal.Decimal(value.toString() if hasattr(value, "toString") else str(value))
    return value if kind in _PLAIN and isinstance(value, (bool, int, float)) else _MISSING


def _literal(node):
    return _value(node.dataType().simpleString(), node.value()) if _kind(node) == "Literal" else _MISSING


_FLIPPED = {"LessThan": "GreaterThan", "GreaterThan": "LessThan", "LessThanOrEqual": "GreaterThanOrEqual", "GreaterThanOrEqual": "LessThanOrEqual"}


def _compared(kind: str, value) -> list[Interval] | None:
    if value is None:
        return [NULL] if kind == "EqualNullSafe" else []  # a comparison with null holds for no row
    if isinstance(value, float) and value != value:
        return None
    return {
        "EqualTo": [Interval(value, value)],
        "EqualNullSafe": [Interval(value, value)],
        "LessThan": [Interval(None, value, True, False)],
        "LessThanOrEqual": [Interval(None, value)],
        "GreaterThan": [Interval(value, None, False, True)],
        "GreaterThanOrEqual": [Interval(value, None)],
    }.get(kind)


def _members(kind: str, node, children: list) -> list:
    """The values of an IN list."""
    if kind == "In":
        return [_literal(x) for x in children[1:]]
    of, values = children[0].dataType().simpleString(), node.hset().toSeq()
    return [_value(of, values.apply(i)) for i in range(values.size())]


def _ranges(node) -> tuple[str, list[Interval]] | None:
    kind, children = _kind(node), _children(node)
    if kind in ("And", "Or"):
        a, b = _ranges(children[0]), _ranges(children[1])
        if kind == "And" and (a is None or b is None):
            return a or b  # the other side can only narrow it
        if a is None or b is None or a[0].lower() != b[0].lower():
            return None
        return a[0], (intersect if kind == "And" else lambda x, y: union([*x, *y]))(a[1], b[1])
    if kind in ("IsNull", "IsNotNull") and (column := _column(children[0])):
        return column, [NULL if kind == "IsNull" else NOT_NULL]
    if kind == "AttributeReference" and node.dataType().simpleString() == "boolean":
        return node.name(), [Interval(True, True)]
    if kind == "Not" and _column(children[0]) and children[0].dataType().simpleString() == "boolean":
        return children[0].name(), [Interval(False, False)]
    if kind in ("In", "InSet") and (column := _column(children[0])):
        parts = [_compared("EqualTo", v) if v is not _MISSING else None for v in _members(kind, node, children)]
        return None if None in parts else (column, union([x for part in parts for x in part]))
    if kind in ("EqualTo", "EqualNullSafe", *_FLIPPED):
        left, right = children
        if (column := _column(left)) is None:
            left, right, kind = right, left, _FLIPPED.get(kind, kind)
            column = _column(left)
        if column is None or (value := _literal(right)) is _MISSING or (found := _compared(kind, value)) is None:
            return None
        return column, found
    if kind == "StartsWith" and (column := _column(children[0])) and isinstance(text := _literal(children[1]), str):
        return column, [prefix(text)]
    return None


def conjuncts(node) -> list:
    if _kind(node) == "And":
        return [x for child in _children(node) for x in conjuncts(child)]
    return [node]


def compile_condition(condition) -> Compiled:
    """What an optimised Catalyst condition says of each column."""
    out = Compiled()
    for node in conjuncts(condition):
        if (found := _ranges(node)) is not None:
            column, intervals = found[0].lower(), union(found[1])
            out.ranges[column] = intersect(out.ranges[column], intervals) if column in out.ranges else intervals
        elif _kind(node) == "Literal" and not node.value():
            out.never = True
    return out


def compile_predicate(frame: DataFrame, text: str) -> Compiled:
    """``text`` optimised as a filter of ``frame``, an empty table of the right schema that Catalyst can't see through."""
    plan = frame.where(text)._jdf.queryExecution().optimizedPlan()
    kind = _kind(plan)
    if kind == "Filter":
        return compile_condition(plan.condition())
    return Compiled(never=kind == "LocalRelation")  # or true for every row, or not a plain filter


def blank(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), schema)


def columns_of(spark: SparkSession, text: str) -> set[str]:
    """The columns (lower case) that a predicate speaks of."""

    def own(node) -> set[str]:
        here = {node.nameParts().mkString(".").lower()} if _kind(node) == "UnresolvedAttribute" else set()
        return here.union(*map(own, _children(node)))

    return own(spark._jsparkSession.sessionState().sqlParser().parseExpression(text))


def filters_of(plan, paths: set[str]) -> dict[str, list]:
    """For each of ``paths`` that an optimised plan scans: the condition right above each scan, None for none."""
    out: dict[str, list] = {}

    def scanned(node) -> str | None:
        if _kind(node) != "LogicalRelation" or not hasattr(node.relation(), "location"):
            return None
        roots = node.relation().location().rootPaths()
        return next((r for i in range(roots.size()) if (r := roots.apply(i).toString().rstrip("/")) in paths), None)

    def walk(node, condition) -> None:
        if (path := scanned(node)) is not None:
            out.setdefault(path, []).append(condition)
        below = node.condition() if _kind(node) == "Filter" else condition if _kind(node) == "Project" and condition is not None else None
        for child in _children(node):
            walk(child, below)
        for plan in _subqueries(node):
            walk(plan, None)

    walk(plan, None)
    return out


def _subqueries(node) -> list:
    found = node.subqueries()
    return [found.apply(i) for i in range(found.size())]
