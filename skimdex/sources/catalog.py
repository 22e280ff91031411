"""The sidecar of a table: its indexes, and for each the files it was built over.

It lives in ``<table>/_skimdex/``, which Spark's readers pass over, or below a directory of the user's choice.
The file names each index version holds are in that version's own Parquet tables; the JSON here stays small. Each
change is a new numbered file, made only if no one else made that number: two writers at a time lose nothing.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from .store import Store


#: Milliseconds for which a state of the catalog is kept once there is a newer one. A change takes far less from its
#: reading to its commit, so no number comes free while someone may still want it.
KEPT_STATES = 600_000


class IndexExists(ValueError):
    """An index of that name is there already."""


class NoSuchIndex(ValueError):
    """There is no index of that name."""


@dataclass
class IndexMeta:
    name: str
    kind: str  # btree or bitmap
    columns: list[str]
    ascending: list[bool]
    versions: list[str] = field(default_factory=list)  # one folder for each build or refresh
    scopes: list[dict] = field(default_factory=list)  # partitions that it covers; none: the whole table
    without: list[dict] = field(default_factory=list)  # partitions that were dropped from it

    def covers(self, partition: dict) -> bool:
        """Whether a file in ``partition`` (column: value as text) is its business."""
        return (not self.scopes or any(within(partition, s) for s in self.scopes)) and not any(within(partition, s) for s in self.without)


def within(partition: dict, scope: dict | None) -> bool:
    """Whether a partition lies in ``scope``, which may name some of its columns only."""
    known = {k.lower(): v for k, v in partition.items()}
    return not scope or all(known.get(k.lower()) == v for k, v in scope.items())


class Catalog:
    def __init__(self, spark: SparkSession, table: str, directory: str | None = None):
        self.store = Store(spark)
        self.table = self.store.qualified(table).rstrip("/")
        named = hashlib.sha1(self.table.encode()).hexdigest()[:16]
        self.root = f"{self.store.qualified(directory).rstrip('/')}/{named}" if directory else f"{self.table}/_skimdex"

    def _numbers(self) -> dict[int, int]:
        """The number of each state, in order, and when it was written."""
        return dict(sorted((int(m[1]), at) for name, at in self.store.names(self.root).items() if (m := re.fullmatch(r"catalog-(\d+)\.json", name))))

    @property
    def exists(self) -> bool:
        return bool(self._numbers())

    def _newest(self) -> tuple[int, list[IndexMeta]]:
        """The last state that was committed, and its number. A file that a writer has just tidied away is passed over."""
        for number in reversed(self._numbers()):
            if (state := self.store.read_json(f"{self.root}/catalog-{number}.json")) is not None:
                return number, [IndexMeta(**x) for x in state["indexes"]]
        return 0, []

    def indexes(self) -> list[IndexMeta]:
        return self._newest()[1]

    def index(self, name: str) -> IndexMeta:
        found = next((x for x in self.indexes() if x.name == name), None)
        if found is None:
            raise NoSuchIndex(name)
        return found

    def _change(self, edit: Callable[[list[IndexMeta]], list[IndexMeta]]) -> None:
        """Commits ``edit`` of the newest state as the next number; who comes second does so again on the new state."""
        while True:
            number, indexes = self._newest()
            if self.store.create_json(f"{self.root}/catalog-{number + 1}.json", {"indexes": [asdict(x) for x in edit(indexes)]}):
                break
        *old, (_, now) = self._numbers().items()
        for n, at in old:
            if at < now - KEPT_STATES:
                self.store.delete(f"{self.root}/catalog-{n}.json")

    def save(self, indexes: list[IndexMeta]) -> None:
        self._change(lambda _: indexes)

    def put(self, index: IndexMeta) -> None:
        """Adds the index, or replaces it in its place."""
        self._change(lambda known: [index if x.name == index.name else x for x in known] + [index] * all(x.name != index.name for x in known))

    def remove(self, name: str) -> None:
        self.index(name)
        self._change(lambda known: [x for x in known if x.name != name])
        self.store.delete(f"{self.root}/{name}")

    def new_version(self, name: str) -> str:
        return f"{self.root}/{name}/v{time.time_ns() // 1000:x}"
