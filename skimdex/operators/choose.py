"""Which indexes answer a compiled predicate best (plain Python; no data is read)."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from enum import Flag, auto

from ..sources.catalog import IndexMeta
from .intervals import Interval


class Able(Flag):
    """What an index can do beside ruling out files."""

    EXISTENCE = auto()  # tell whether a key is there
    GROUP = auto()  # count the rows of each key
    ITERATE = auto()  # list the rows of each key in order
    ORDER = auto()  # give keys in order over a range


#: A bitmap serves single values only, so it gives no order.
ABILITIES = {"btree": Able.EXISTENCE | Able.GROUP | Able.ITERATE | Able.ORDER, "bitmap": Able.EXISTENCE | Able.GROUP}


def satisfies(kind: str, needs: Able) -> bool:
    """Whether an index of ``kind`` can do all that ``needs`` names."""
    return needs in ABILITIES[kind]


@dataclass(frozen=True)
class Candidate:
    """``equal``: leading columns bound to one value; ``last``: the column after them with its intervals."""

    index: IndexMeta
    equal: tuple[tuple[str, Interval], ...]
    last: tuple[str, tuple[Interval, ...]] | None

    @property
    def matched(self) -> int:
        return len(self.equal) + (self.last is not None)

    @property
    def score(self) -> float:
        entries = len(self.last[1]) if self.last else 1
        return (len(self.index.columns) + entries) / self.matched


def candidate(index: IndexMeta, ranges: dict[str, list[Interval]]) -> Candidate | None:
    """A B-tree serves the longest run of its leading columns bound to one value and one more column.

    A bitmap serves its column if every interval is a single value or null: with a range among them it can't.
    """
    if index.kind == "bitmap":
        own = ranges.get(index.columns[0].lower())
        return Candidate(index, (), (index.columns[0], tuple(own))) if own and all(x.point or x.null for x in own) else None
    equal: list[tuple[str, Interval]] = []
    for column in index.columns:
        own = ranges.get(column.lower())
        if own is None:
            break
        if len(own) == 1 and own[0].point and column != index.columns[-1]:
            equal.append((column, own[0]))
            continue
        return Candidate(index, tuple(equal), (column, tuple(own)))
    return Candidate(index, tuple(equal), None) if equal else None


def choose(indexes: list[IndexMeta], ranges: dict[str, list[Interval]], disabled: Collection[str] = (), most: int = 1) -> list[Candidate]:
    """Up to ``most`` candidates with no column in common, best score first; ties by name."""
    found = [c for x in indexes if x.name not in disabled and (c := candidate(x, ranges)) is not None]
    out: list[Candidate] = []
    used: set[str] = set()
    for c in sorted(found, key=lambda c: (c.score, c.index.name)):
        own = {x.lower() for x in c.index.columns}
        if len(out) < most and not own & used:
            out.append(c)
            used |= own
    return out
