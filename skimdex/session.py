"""The engine: tables with secondary indexes beside a plain SparkSession, and DDL for them.

Index statements are recognised before Spark sees them; every other statement goes to ``spark.sql`` unchanged.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import strategies
from .operators.build import build_version
from .operators.metadata import table_of
from .operators.policy import FULL_SCAN_THRESHOLD
from .operators.predicate import compile_condition, filters_of
from .operators.scan import Scanner, ScanReport
from .sources.catalog import Catalog, IndexExists, IndexMeta, NoSuchIndex, within
from .sources.store import DataFile
from .sources.writer import write_table

DEFAULTS = {
    "index.enabled": True,
    "index.most": 1,  # indexes that one scan may intersect
    "index.directory": None,
    "index.codec": "snappy",  # of index entries and statistics: any Parquet codec, or none
    "statistics.enabled": True,
    "statistics.bloom": True,
    "statistics.threshold": FULL_SCAN_THRESHOLD,
    "parquet.cache": False,
}
#: Versions of an index (one a refresh) beyond which a refresh builds it anew.
MOST_VERSIONS = 20
#: Reports of scans that an engine keeps for ``metrics``.
MOST_SCANS = 1000
METRICS_SCHEMA = "scan int, table string, indexes array<string>, files int, skipped int, used int, full int, missed int, looked_up boolean, rows_known long, rows_skipped long, index_rows long, bytes_read long, bytes_skipped long"
CACHE_SCHEMA = "name string, partitions int, cached_partitions int, memory_bytes long, disk_bytes long"
SHOW_SCHEMA = "table string, key_name string, seq_in_index int, column_name string, collation string, index_type string, enabled boolean"


class Table:
    """A folder of Parquet files, perhaps in Hive-style partitions, and its indexes."""

    def __init__(self, engine: Engine, path: str, name: str | None = None):
        self.engine, self.name = engine, name or path.rstrip("/").rsplit("/", 1)[-1]
        self.catalog = Catalog(engine.spark, path, engine.conf["index.directory"])
        self.path = self.catalog.table
        self.scanner = Scanner(engine, self)
        self.last_report: ScanReport | None = None
        self._schema = None

    def files(self) -> list[DataFile]:
        return self.catalog.store.data_files(self.path)

    @property
    def schema(self):
        if self._schema is None:
            self._schema = self.engine.spark.read.parquet(self.path).schema
        return self._schema

    def scan(self, predicate: str | None = None, columns: Sequence[str] | None = None, fetch: str = "files", cache: bool | None = None) -> tuple[DataFrame, ScanReport]:
        """Rows that meet ``predicate`` (a SQL condition), and what the scan decided.

        ``fetch``: "files" reads the files that may match; "rows" joins on the index's row numbers. ``cache``
        keeps the result in Spark's block manager (memory, then disk).
        """
        df, self.last_report = self.scanner.scan(predicate, columns, fetch, self.engine.conf["parquet.cache"] if cache is None else cache)
        return df, self.last_report

    def filter(self, predicate: str | None, columns: Sequence[str] | None = None, **options) -> DataFrame:
        return self.scan(predicate, columns, **options)[0]

    def write(self, df: DataFrame, **options) -> None:
        """Writes or appends ``df`` (see ``write_table``); new files are scanned in full until a refresh."""
        write_table(df, self.path, **options)
        self._schema = None

    def top_k(self, predicate: str, key: str, n: int, ascending: bool = True, columns: Sequence[str] | None = None, ties: Sequence[str] = ()) -> DataFrame:
        return strategies.top_k(self, predicate, key, n, ascending, columns, ties)

    def group_by(self, predicate: str, key: str, **aggregates: Column) -> DataFrame:
        return strategies.group_by(self, predicate, key, **aggregates)

    def count_by_key(self, predicate: str, key: str) -> DataFrame:
        return strategies.count_by_key(self, predicate, key)

    def first_rows(self, predicate: str, key: str, n: int = 1) -> DataFrame:
        return strategies.first_rows(self, predicate, key, n)


class Engine:
    def __init__(self, spark: SparkSession, **conf):
        unknown = set(conf) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        self.spark, self.conf, self.disabled = spark, {**DEFAULTS, **conf}, set()
        self.tables: dict[str, Table] = {}
        self.scans: deque[tuple[str, ScanReport]] = deque(maxlen=MOST_SCANS)

    def table(self, path: str, name: str | None = None) -> Table:
        """The table at ``path``; with ``name``, DDL and ``sql`` know it by that name too."""
        table = Table(self, path, name)
        if name:
            self.tables[name.lower()] = table
        return table

    def register(self, name: str) -> Table:
        """A table that the session's catalog knows, by its location."""
        rows = {r.col_name: r.data_type for r in self.spark.sql(f"describe extended {name}").collect()}
        if rows.get("Provider", "").lower() != "parquet" or not rows.get("Location"):
            raise ValueError(f"{name} is not a Parquet table")
        return self.table(rows["Location"], name)

    def _named(self, name: str) -> Table:
        return self.tables.get(name.lower()) or self.register(name)

    # -- indexes ---------------------------------------------------------------------------------------------

    def create_index(self, name: str, table: Table, columns: Sequence[str], kind: str = "btree", if_not_exists: bool = False, partition: dict | None = None) -> None:
        """``columns``: names, each perhaps followed by ASC or DESC (for SHOW and top-k; lookups don't care)."""
        kind = kind.lower()
        if kind not in ("btree", "bitmap"):
            raise ValueError(f"no such index type: {kind}")
        parsed = [c.split() for c in columns]
        names = [p[0].strip("`") for p in parsed]
        known = {f.name.lower(): f.name for f in table.schema.fields}
        if missing := [n for n in names if n.lower() not in known]:
            raise ValueError(f"no such column: {', '.join(missing)}")
        if kind == "bitmap" and len(names) != 1:
            raise ValueError("a bitmap index has one column")
        fresh = IndexMeta(name, kind, [known[n.lower()] for n in names], [len(p) < 2 or p[1].lower() != "desc" for p in parsed], scopes=[partition] if partition else [])
        index = next((x for x in table.catalog.indexes() if x.name == name), None)
        if index is not None:
            # One name may be built in several partitions, each at its own time.
            same = (index.kind, index.columns, index.ascending) == (fresh.kind, fresh.columns, fresh.ascending)
            if not same or not partition or partition not in index.without and (not index.scopes or partition in index.scopes):
                if if_not_exists:
                    return
                raise IndexExists(name)
            index.without = [x for x in index.without if x != partition]
            index.scopes = [*index.scopes, partition] if index.scopes else []
        else:
            index = fresh
        self._build(table, index, [f for f in table.files() if within(f.partition(table.path), partition)])

    def _build(self, table: Table, index: IndexMeta, files: list[DataFile]) -> None:
        if files:
            path = table.catalog.new_version(index.name)
            build_version(self.spark, table.path, files, index, path, self.conf["index.codec"])
            index.versions.append(path.rsplit("/", 1)[-1])
        table.catalog.put(index)

    def refresh_index(self, table: Table, partition: dict | None = None) -> None:
        """Builds every index over the files it doesn't know as they are now; one that is over partitions keeps to them.

        An index of over ``MOST_VERSIONS`` versions is built anew over all its files, and its old versions go.
        """
        for index in table.catalog.indexes():
            known = self._known(table, index)
            mine = [f for f in table.files() if index.covers(f.partition(table.path))]
            new = [f for f in mine if within(f.partition(table.path), partition) and known.get(f.path) != (f.size, f.modified)]
            if not new:
                continue
            if len(index.versions) < MOST_VERSIONS:
                self._build(table, index, new)
            else:
                old, index.versions = index.versions, []
                self._build(table, index, mine)
                for version in old:
                    table.catalog.store.delete(f"{table.catalog.root}/{index.name}/{version}")

    def _known(self, table: Table, index: IndexMeta) -> dict[str, tuple[int, int]]:
        files = table_of(self.spark, table.catalog, index, "files")
        rows = files.select("file", "size", "modified", "version").orderBy("version").collect() if files is not None else []
        return {row.file: (row["size"], row.modified) for row in rows}

    def drop_index(self, name: str, table: Table, if_exists: bool = False, partition: dict | None = None) -> None:
        """Drops the index, or its part in one partition; with its last partition the index goes."""
        index = next((x for x in table.catalog.indexes() if x.name == name), None)
        if index is None or partition and (partition in index.without or index.scopes and partition not in index.scopes):
            if not if_exists and table.files():
                raise NoSuchIndex(name)
            return
        if partition and not index.scopes:
            index.without.append(partition)
        elif partition:
            index.scopes.remove(partition)
        if not partition or not any(index.covers(f.partition(table.path)) for f in table.files()) or not index.scopes and not index.without:
            table.catalog.remove(name)
        else:
            table.catalog.put(index)

    def show_index(self, table: Table) -> DataFrame:
        rows = [(table.name, x.name, i, c, "A" if up else "D", x.kind.upper(), x.name not in self.disabled) for x in table.catalog.indexes() for i, (c, up) in enumerate(zip(x.columns, x.ascending, strict=True))]
        return self.spark.createDataFrame(rows, SHOW_SCHEMA)

    def check_index(self, table: Table, partition: dict | None = None) -> DataFrame:
        """One line for each problem: files that are gone, changed or not indexed, and index data that is gone.

        With ``partition``, of the files in it only.
        """
        at = lambda p: DataFile(p, 0, 0).partition(table.path)
        lines, now = [], {f.path: (f.size, f.modified) for f in table.files() if within(at(f.path), partition)}
        if partition and not now:
            raise ValueError(f"no such partition: {partition}")
        if not table.catalog.exists:
            lines.append(f"Meta file not found: {table.path}")
        for index in table.catalog.indexes():
            whole = [v for v in index.versions if table.catalog.store.exists(f"{table.catalog.root}/{index.name}/{v}/files/_SUCCESS")]
            lines += [f"Index data not found: {index.name} ({v})" for v in index.versions if v not in whole]
            known = self._known(table, IndexMeta(index.name, index.kind, index.columns, index.ascending, whole))
            known = {p: v for p, v in known.items() if within(at(p), partition) and index.covers(at(p))}
            lines += [f"Data file not found: {p} ({index.name})" for p in sorted(known) if p not in now]
            lines += [f"Data file changed since it was indexed: {p} ({index.name})" for p in sorted(known) if p in now and now[p] != known[p]]
            lines += [f"Index file not found for: {p} ({index.name})" for p in sorted(now) if p not in known and index.covers(at(p))]
        return self.spark.createDataFrame([(x,) for x in lines], "`Analysis Result` string")

    def disable_index(self, name: str) -> None:
        self.disabled.add(name)

    def enable_index(self, name: str) -> None:
        self.disabled.discard(name)

    def semi_join(self, left: DataFrame, on: str, right: Table, predicate: str, key: str, residual: str | None = None) -> DataFrame:
        return strategies.semi_join(left, on, right, predicate, key, residual)

    # -- monitoring ------------------------------------------------------------------------------------------

    def metrics(self) -> DataFrame:
        """What the last scans (up to ``MOST_SCANS``) decided, one row each, oldest first."""
        columns = [x.split()[0] for x in METRICS_SCHEMA.split(", ")][2:]
        rows = [(i, name, *(getattr(report, c) for c in columns)) for i, (name, report) in enumerate(self.scans)]
        return self.spark.createDataFrame(rows, METRICS_SCHEMA)

    def cached(self) -> DataFrame:
        """What Spark's block managers hold of cached scans and tables."""
        found = self.spark.sparkContext._jsc.sc().getRDDStorageInfo()
        return self.spark.createDataFrame([(x.name(), x.numPartitions(), x.numCachedPartitions(), x.memSize(), x.diskSize()) for x in found], CACHE_SCHEMA)

    # -- statements ------------------------------------------------------------------------------------------

    def sql(self, statement: str) -> DataFrame:
        text = statement.strip().rstrip(";").strip()
        for pattern, act in _STATEMENTS:
            if (m := re.fullmatch(pattern, text, re.I | re.S)) is not None:
                out = act(self, m)
                return out if out is not None else self.spark.createDataFrame([], "result string")
        return self._select(text)

    def _select(self, text: str) -> DataFrame:
        """Any other statement: the engine's tables are known by name, and scans of them leave out files.

        Catalyst plans the statement over whole tables first. The condition that it pushes down to each scan says
        which files the indexes rule out; then the statement is planned over the rest. A table that is scanned in
        several places is read where any of them needs it.
        """
        named = {n: t for n, t in self.tables.items() if "." not in n and re.search(rf"\b{re.escape(n)}\b", text, re.I) and t.files()}
        if not named:
            return self.spark.sql(text)
        try:
            for name, table in named.items():
                table.scanner.over([table.path]).createOrReplaceTempView(name)
            df = self.spark.sql(text)
            if not self.conf["index.enabled"]:
                return df
            found = filters_of(df._jdf.queryExecution().optimizedPlan(), {t.path for t in named.values()})
            fewer = False
            for name, table in named.items():
                if None in (conditions := found.get(table.path, [None])):
                    continue
                read: set[str] = set()
                for condition in conditions:
                    table.last_report = table.scanner.plan(compile_condition(condition))[0]
                    read |= set(table.last_report.read)
                if len(read) < table.last_report.files:
                    table.scanner.over(sorted(read)).createOrReplaceTempView(name)
                    fewer = True
            return self.spark.sql(text) if fewer else df
        finally:
            for name in named:
                self.spark.catalog.dropTempView(name)


def _scope(text: str | None) -> dict | None:
    return {k.strip("` "): v.strip("'\" ") for k, v in (x.split("=", 1) for x in text.split(","))} if text else None


_INDEX, _NAME = r"(?:SINDEX|OINDEX)", r"`?([\w.]+)`?"
_PART = r"(?:\s+PARTITION\s*\((.+?)\))?"
_STATEMENTS: list[tuple[str, Callable]] = [
    (rf"CREATE\s+{_INDEX}\s+(IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+ON\s+(?:TABLE\s+)?{_NAME}\s*\((.+?)\)(?:\s+USING\s+(\w+))?{_PART}", lambda e, m: e.create_index(m[2], e._named(m[3]), m[4].split(","), m[5] or "btree", bool(m[1]), _scope(m[6]))),
    (rf"DROP\s+{_INDEX}\s+(IF\s+EXISTS\s+)?{_NAME}\s+ON\s+(?:TABLE\s+)?{_NAME}{_PART}", lambda e, m: e.drop_index(m[2], e._named(m[3]), bool(m[1]), _scope(m[4]))),
    (rf"REFRESH\s+{_INDEX}\s+ON\s+(?:TABLE\s+)?{_NAME}{_PART}", lambda e, m: e.refresh_index(e._named(m[1]), _scope(m[2]))),
    (rf"SHOW\s+{_INDEX}\s+(?:FROM|IN)\s+{_NAME}", lambda e, m: e.show_index(e._named(m[1]))),
    (rf"CHECK\s+{_INDEX}\s+ON\s+(?:TABLE\s+)?{_NAME}{_PART}", lambda e, m: e.check_index(e._named(m[1]), _scope(m[2]))),
    (rf"DISABLE\s+{_INDEX}\s+{_NAME}", lambda e, m: e.disable_index(m[1])),
    (rf"ENABLE\s+{_INDEX}\s+{_NAME}", lambda e, m: e.enable_index(m[1])),
]
