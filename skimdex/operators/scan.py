"""Scans that read only the files an index can't rule out; the whole predicate is applied again to what is read.

So an index changes the speed of a query and never its answer: an index that is missing, stale, disabled or not
worth it just leaves more files in the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import located
from .choose import Candidate, choose
from .metadata import matching, size_of, table_of, verdicts
from .policy import SIZE_RATIO, Verdict, combined
from .predicate import Compiled, blank, compile_predicate


@dataclass
class ScanReport:
    """What a scan decided: files by verdict, indexes used, files with rows in the index, and its mode."""

    files: int = 0
    skipped: int = 0
    used: int = 0
    full: int = 0
    missed: int = 0  # of those used: files whose index has no matching key
    indexes: list[str] = field(default_factory=list)
    looked_up: bool = False  # whether keys were looked up; else files to be used are read as they are
    index_rows: int = 0
    rows_known: int = 0  # rows of the files that an index knows as they are now
    rows_skipped: int = 0  # of those: in files that are not read
    bytes_read: int = 0
    bytes_skipped: int = 0
    read: list[str] = field(default_factory=list)


class Scanner:
    """Plans scans of one table; see ``Table`` for the public face."""

    def __init__(self, engine, table):
        self.engine, self.table, self.spark = engine, table, engine.spark
        self._blank: tuple | None = None  # a schema, and an empty table of it

    def compiled(self, predicate: str | None) -> Compiled:
        if not predicate or not self.engine.conf["index.enabled"]:
            return Compiled()
        schema = self.table.schema
        if self._blank is None or self._blank[0] is not schema:
            self._blank = schema, blank(self.spark, schema)
        return compile_predicate(self._blank[1], predicate)

    def candidates(self, compiled: Compiled) -> list[Candidate]:
        if not self.engine.conf["index.enabled"] or not compiled.ranges:
            return []
        return choose(self.table.catalog.indexes(), compiled.ranges, self.engine.disabled, self.engine.conf["index.most"])

    def live(self, c: Candidate, now: dict) -> dict[str, tuple[str, Verdict, int]]:
        """Of the files that the index covers and knows as they are now: the version they are in, the verdict, and their rows."""
        kinds = {f.name: f.dataType for f in self.table.schema.fields}
        out = {}
        for path, size, modified, version, found, rows in verdicts(self.spark, self.table.catalog, c, [kinds[x] for x in c.index.columns], self.engine.conf):
            f = now.get(path)
            if f is not None and (f.size, f.modified) == (size, modified) and c.index.covers(f.partition(self.table.path)):
                out[path] = version, Verdict(found), rows
        return out

    def entries(self, c: Candidate, live: dict[str, tuple[str, Verdict, int]]) -> DataFrame:
        """The matching entries of just those (file, version) that are ``live``."""
        pairs = self.spark.createDataFrame([(p, known[0]) for p, known in live.items()], "file string, version string")
        return matching(table_of(self.spark, self.table.catalog, c.index, "entries"), c).join(pairs, ["file", "version"], "left_semi")

    def _found(self, chosen: list[Candidate], live: list[dict]) -> list[dict[str, int]]:
        """For each candidate, the rows of each file that its index says match: one job, one row a file."""
        hits = [self.entries(c, known).groupBy("file").agg(F.sum("n").alias("n")).select(F.lit(i).alias("i"), "file", "n") for i, (c, known) in enumerate(zip(chosen, live, strict=True)) if known]
        out: list[dict[str, int]] = [{} for _ in chosen]
        if hits:
            for row in reduce(DataFrame.union, hits).collect():
                out[row.i][row.file] = row.n
        return out

    def _worth(self, c: Candidate, data_bytes: int) -> bool:
        """Whether the index is small beside the files that its keys may rule out."""
        catalog = self.table.catalog
        return sum(size_of(catalog, f"{catalog.root}/{c.index.name}/{v}/entries") for v in c.index.versions) <= SIZE_RATIO * data_bytes

    def plan(self, compiled: Compiled, fetch: str = "files") -> tuple[ScanReport, list[Candidate], list[dict]]:
        """Which files to read; also the candidates and the files that each knows. The engine keeps the report."""
        out = self._plan(compiled, fetch)
        self.engine.scans.append((self.table.name, out[0]))
        return out

    def _plan(self, compiled: Compiled, fetch: str) -> tuple[ScanReport, list[Candidate], list[dict]]:
        now = {f.path: f for f in self.table.files()}
        report, size = ScanReport(files=len(now)), lambda paths: sum(now[p].size for p in paths)
        if compiled.never:
            report.skipped, report.bytes_skipped = len(now), size(now)
            return report, [], []
        chosen = self.candidates(compiled) if now else []
        if not chosen:
            report.full, report.read, report.bytes_read = len(now), list(now), size(now)
            return report, [], []
        report.indexes = [c.index.name for c in chosen]
        live = [self.live(c, now) for c in chosen]
        final = {path: combined([known[path][1] if path in known else Verdict.FULL for known in live]) for path in now}
        use = [p for p, v in final.items() if v is Verdict.USE]
        full = [p for p, v in final.items() if v is Verdict.FULL]
        hit = use
        if use and (fetch == "rows" or all(self._worth(c, size(use)) for c in chosen)):
            found = self._found(chosen, [{p: known[p] for p in use if p in known} for known in live])
            hit = [p for p in use if all(p not in known or p in rows for known, rows in zip(live, found, strict=True))]
            report.looked_up, report.missed = True, len(use) - len(hit)
            report.index_rows = min((sum(rows.get(p, 0) for p in hit) for rows in found), default=0)
        report.skipped, report.used, report.full = len(now) - len(use) - len(full), len(use), len(full)
        report.read = sorted([*hit, *full])
        rows = {p: known[p][2] for known in live for p in known}
        report.rows_known = sum(rows.values())
        report.rows_skipped = report.rows_known - sum(rows.get(p, 0) for p in report.read)
        report.bytes_read = size(report.read)
        report.bytes_skipped = size(now) - report.bytes_read
        return report, chosen, live

    def scan(self, predicate: str | None, columns: Sequence[str] | None = None, fetch: str = "files", cache: bool = False) -> tuple[DataFrame, ScanReport]:
        report, chosen, live = self.plan(self.compiled(predicate), fetch)
        if fetch == "rows" and chosen and report.read:
            df = self._fetched(report.read, chosen, live)
        else:
            df = self.over([self.table.path] if 0 < report.files == len(report.read) else report.read)
        df = df.where(predicate) if predicate else df
        df = df.select(*columns) if columns else df
        return (df.persist(StorageLevel.MEMORY_AND_DISK) if cache else df), report

    def over(self, files: list[str]) -> DataFrame:
        """The rows of just those files of the table."""
        if not files:
            return self.spark.createDataFrame([], self.table.schema)
        return self.spark.read.schema(self.table.schema).option("basePath", self.table.path).parquet(*files)

    def _fetched(self, files: list[str], chosen: list[Candidate], live: list[dict]) -> DataFrame:
        """Rows by their numbers. A file's rows are held against the indexes that know it, and against no other."""
        rows = located(self.spark, self.table.path, files)
        for c, known in zip(chosen, live, strict=True):
            mine = {p: known[p] for p in files if p in known and known[p][1] is Verdict.USE}
            if not mine:
                continue
            picked = self._picked(rows, c, mine)
            if len(mine) < len(files):
                others = self.spark.createDataFrame([(p,) for p in mine], "_file string")
                picked = picked.unionByName(rows.join(others, "_file", "left_anti"))
            rows = picked
        return rows.select(*self.table.schema.names)

    def _picked(self, rows: DataFrame, c: Candidate, live: dict) -> DataFrame:
        """Of the ``live`` files' rows, those whose numbers the candidate's entries hold."""
        entries = self.entries(c, live)
        if c.index.kind != "bitmap":
            ids = entries.select(F.col("file").alias("_file"), F.explode("rows").alias("_row"))
            return rows.join(ids, ["_file", "_row"], "left_semi")
        # Each row asks its own bit of the merged bitmap of its bucket. Bit 0 of a bucket is number 1.
        merged = entries.groupBy("file", "bucket").agg(F.bitmap_or_agg("bitmap").alias("_bits")).select(F.col("file").alias("_file"), F.col("bucket").alias("_bucket"), "_bits")
        at = F.bitmap_bit_position(F.col("_row") + 1).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        asked = rows.withColumn("_bucket", F.bitmap_bucket_number(F.col("_row") + 1)).join(merged, ["_file", "_bucket"])
        return asked.where(F.getbit(byte, at % 8) == 1).select(*rows.columns)
