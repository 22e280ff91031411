"""File statistics of an index, and the verdicts they give: on the driver for small tables, on executors for large ones.

Both ways run one function over the same rows. Statistics that fit ``LOCAL_BYTES`` are read once and kept; larger
ones are never gathered: Spark counts the sampled keys that are asked for and looks up Bloom bits, each executor
judges its own rows, and one short row a file comes back.
"""

from __future__ import annotations

import datetime as dt
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Catalog, IndexMeta
from .build import BLOOM_HASHES, SEGMENT, bloom_hash, key_names, spots
from .choose import Candidate
from .intervals import Interval
from .policy import Verdict, bounds, verdict

#: Bytes of an index's statistics, as stored, that the driver keeps; indexes whose statistics it keeps.
LOCAL_BYTES, KEPT = 16 << 20, 64
_kept: OrderedDict[tuple, list[dict]] = OrderedDict()
_sizes: OrderedDict[str, int] = OrderedDict()
_EPOCH = dt.datetime(1970, 1, 1)


def internal(value):
    """Spark's internal value of a key: microseconds for timestamps, days for dates."""
    if isinstance(value, dt.datetime):
        since = value - (_EPOCH if value.tzinfo is None else _EPOCH.replace(tzinfo=dt.UTC))
        return since // dt.timedelta(microseconds=1)
    return (value - _EPOCH.date()).days if isinstance(value, dt.date) else value


def literal(value, kind: T.DataType) -> Column:
    """A column of an internal value."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestamp_ntz '{(_EPOCH + dt.timedelta(microseconds=value)).isoformat(sep=' ')}'")
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.lit(value))
    return F.lit(value).cast(kind)


def size_of(catalog: Catalog, path: str) -> int:
    """Bytes below a folder of an index version (versions never change)."""
    if path not in _sizes:
        _sizes[path] = catalog.store.size(path)
        while len(_sizes) > 10_000:
            _sizes.popitem(last=False)
    return _sizes[path]


def table_of(spark: SparkSession, catalog: Catalog, index: IndexMeta, part: str) -> DataFrame | None:
    """``files`` or ``entries`` of all versions of an index in one scan, with the ``version`` that each row is of."""
    paths = [f"{catalog.root}/{index.name}/{v}/{part}" for v in index.versions]
    if not paths:
        return None
    return spark.read.parquet(*paths).withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), rf"/(v[0-9a-f]+)/{part}/", 1))


def read_rows(table: pa.Table | pa.RecordBatch, names: list[str]) -> Iterator[dict]:
    """Statistics of each file, keys as tuples of internal values; also the share of its sample and the Bloom hit where the table has them."""
    key = lambda s: None if s is None else tuple(internal(s[n]) for n in names)
    for row in table.to_pylist():
        yield {
            "file": row["file"], "size": row["size"], "modified": row["modified"], "version": row["version"], "id": row["id"], "rows": row["rows"] or 0, "nulls": row["nulls"] or 0,
            "low": key(row["low"]), "high": key(row["high"]), "parts": [(key(p["low"]), key(p["high"]), p["upto"]) for p in row["parts"] or []], "segments": row["segments"] or 0, "share": row.get("share"), "hit": row.get("hit"),
        }


def gathered(rows: list[dict], sample: pa.Table, bloom: pa.Table, names: list[str]) -> list[dict]:
    """The statistics with the sample and the Bloom segments of each file."""
    of = {(row["version"], row["id"]): row | {"sample": [], "bloom": {}} for row in rows}
    for s in sample.to_pylist():
        of[s["version"], s["id"]]["sample"].append(tuple(internal(s[n]) for n in names))
    for s in bloom.to_pylist():
        of[s["version"], s["id"]]["bloom"][s["segment"]] = s["bits"]
    return [row | {k: of[row["version"], row["id"]][k] for k in ("sample", "bloom")} for row in rows]


def asked_keys(spark: SparkSession, c: Candidate, kinds: list[T.DataType]) -> list[int] | None:
    """The Bloom hash of each key that a candidate of single values asks for; None if it asks for anything else."""
    boxes = [(*(i for _, i in c.equal), i) for i in c.last[1]] if c.last else [tuple(i for _, i in c.equal)]
    if not boxes or any(not i.point for box in boxes for i in box):
        return None
    n = len(boxes[0])
    if len(kinds) > 4 and n not in (1, len(kinds)):
        return None
    made = [bloom_hash([literal(i.low, kinds[j]) for j, i in enumerate(box)], (1 << n) - 1) for box in boxes]
    return spark.sql("values (1)").select(F.array(*made).alias("h")).collect()[0].h  # folded by the optimiser: no job


def holds_spots(bits: bytes | None, asked: np.ndarray) -> bool:
    """Whether a segment has all the bits."""
    if bits is None:
        return False
    if len(bits) < (1 << SEGMENT) // 8:
        there = np.frombuffer(bits, "<u2")
        return len(there) > 0 and bool((there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked).all())
    return all(bits[i >> 3] >> (i & 7) & 1 for i in asked.tolist())


def may_hold(stats: dict, asked: list[int] | None) -> bool | None:
    if asked is None or not stats["segments"]:
        return None
    return any(holds_spots(stats["bloom"].get(h & stats["segments"] - 1), spots(h)) for h in asked)


def judged(c: Candidate, rows: Iterable[dict], asked: list[int] | None, plain: bool, threshold: float) -> Iterator[tuple[str, int, int, str, int, int]]:
    """``(file, size, modified, version, verdict, rows)`` of each row; ``plain``: statistics aren't asked."""
    for stats in rows:
        found = Verdict.USE if plain else verdict(c, stats, may_hold(stats, asked) if "bloom" in stats else stats["hit"], threshold)
        yield stats["file"], stats["size"], stats["modified"], stats["version"], found.value, stats["rows"]


def shares_of(sample: DataFrame, c: Candidate, names: list[str], kinds: list[T.DataType]) -> DataFrame:
    """``version, id, share``: how much of each file's sample lies in the candidate's key space (nulls aside: a sample has none)."""
    boxes = [box for box in bounds(c) if not any(i.null for i in box)]
    within = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (holds(F.col(names[j]), kinds[j], [i]) for j, i in enumerate(box))) for box in boxes), F.lit(False))
    return sample.groupBy("version", "id").agg(F.avg(F.when(within, 1.0).otherwise(0.0)).alias("share"))


def hits_of(bloom: DataFrame, asked: list[int]) -> DataFrame:
    """``version, id, hit`` for each file whose Bloom filter may hold one of the hashes."""
    found = F.explode(F.array(*(F.lit(h).cast("long") for h in asked))).alias("h")
    # However many segments a file has, it can only be these that are asked for: the scan reads little else.
    wanted = sorted({h & (1 << i) - 1 for h in asked for i in range(31 - SEGMENT)})
    rows = bloom.where(F.col("segment").isin(wanted)) if len(wanted) <= 4096 else bloom
    rows = rows.select("version", "id", "segments", "segment", "bits", found).where("segment = cast(h & (segments - 1) as int)")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [holds_spots(bits.as_py(), at) for bits, at in zip(batch.column(2), spots(batch.column(3).to_numpy(zero_copy_only=False)).reshape(-1, BLOOM_HASHES), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], ["version", "id", "hit"])

    return rows.select("version", "id", "bits", "h").mapInArrow(run, "version string, id long, hit boolean").where("hit").distinct()


def verdicts(spark: SparkSession, catalog: Catalog, c: Candidate, kinds: list[T.DataType], conf: dict) -> list[tuple[str, int, int, str, int, int]]:
    """What the statistics of one candidate's index say of each file that it was built over."""
    index, names = c.index, key_names(c.index)
    if not index.versions:
        return []
    plain = index.kind == "bitmap" or not conf["statistics.enabled"]
    asked = asked_keys(spark, c, kinds) if conf["statistics.bloom"] and not plain else None
    at, needed = (catalog.root, index.name, plain, *index.versions), ["files"] if plain else ["files", "sample", "bloom"]
    if at not in _kept:
        files, *more = (table_of(spark, catalog, index, part) for part in needed)
        if sum(size_of(catalog, f"{catalog.root}/{index.name}/{v}/{part}") for v in index.versions for part in needed) > LOCAL_BYTES:
            threshold = conf["statistics.threshold"]
            if more:
                files = files.join(shares_of(more[0], c, names, kinds), ["version", "id"], "left")
            if asked:
                files = files.join(hits_of(more[1], asked), ["version", "id"], "left").withColumn("hit", F.when(F.col("segments") > 0, F.coalesce("hit", F.lit(False))))

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = list(judged(c, read_rows(batch, names), asked, plain, threshold))
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["file", "size", "modified", "version", "verdict", "rows"])

            got = files.mapInArrow(run, "file string, size long, modified long, version string, verdict int, rows long").toArrow()
            return list(zip(*(got.column(i).to_pylist() for i in range(6)), strict=True))
        rows = list(read_rows(files.toArrow(), names))
        _kept[at] = gathered(rows, *(x.toArrow() for x in more), names) if more else rows
        while len(_kept) > KEPT:
            _kept.popitem(last=False)
    _kept.move_to_end(at)
    return list(judged(c, _kept[at], asked, plain, conf["statistics.threshold"]))


def holds(column: Column, kind: T.DataType, intervals: Iterable[Interval]) -> Column:
    parts = []
    for i in intervals:
        if i.null:
            parts.append(column.isNull())
            continue
        part = column.isNotNull()
        if i.low is not None:
            low = literal(i.low, kind)
            part &= column >= low if i.low_in else column > low
        if i.high is not None:
            high = literal(i.high, kind)
            part &= column <= high if i.high_in else column < high
        parts.append(part)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def matching(entries: DataFrame, c: Candidate) -> DataFrame:
    """The rows of index ``entries`` that lie in the candidate's key space; the range reaches the Parquet scan."""
    names, kinds = dict(zip(c.index.columns, key_names(c.index), strict=True)), {f.name: f.dataType for f in entries.schema.fields}
    wanted = [(column, [interval]) for column, interval in c.equal] + ([c.last] if c.last else [])
    for column, intervals in wanted:
        entries = entries.where(holds(F.col(names[column]), kinds[names[column]], intervals))
    return entries
