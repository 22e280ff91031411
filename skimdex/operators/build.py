"""Building index versions: ordinary DataFrame jobs over the files that have none.

A version holds ``entries`` (a row for each key of each file, clustered by key), ``files`` (a short row for each
file with its statistics), which comes last, and ``counts`` (a row for each file and range of keys); of a B-tree also
``sample`` (a row for each sampled key) and ``bloom`` (a row for each segment of a file's Bloom filter, 4 KB at most).
B-tree entries list row numbers; bitmap entries hold Spark's own bitmaps. No task of the statistics holds a whole
file's keys, however large the file is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import IndexMeta
from ..sources.store import DataFile

#: Keys of a sample: a share of a file's keys, and at least so many; parts of the equi-depth statistics.
SAMPLE_RATE, SAMPLE_LEAST, PARTS = 0.05, 24, 5
#: Least bits of a file's Bloom filter (a power of two), bits for each key and subset of columns, and hash functions.
BLOOM_LEAST, BLOOM_PER_KEY, BLOOM_HASHES = 1 << 20, 10, 3
#: Powers of two: bits of a segment of a Bloom filter (all bits of a key lie in one), and hash ranges that a sample is cut from.
SEGMENT, RANGES = 15, 12
_SPOTS = (1 << SEGMENT) - 1


def located(spark: SparkSession, table: str, files: Sequence[str]) -> DataFrame:
    """The rows of ``files`` with ``_file`` (as the catalog spells it) and ``_row``, the place in the file."""
    df = spark.read.option("basePath", table).parquet(*files)
    path = F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "^([A-Za-z0-9]+):/{3}", "$1:/")
    return df.withColumn("_file", path).withColumn("_row", F.col("_metadata.row_index"))


def key_names(index: IndexMeta) -> list[str]:
    return [f"k{i}" for i in range(len(index.columns))]


def file_id(file: Column) -> Column:
    """Stands for a file's name in statistics. Two files of one id would share theirs, which hold for each of them."""
    return F.xxhash64(file)


def bloom_hash(keys: Sequence[Column], mask: int) -> Column:
    """The hash of one subset of the key columns (bit i of ``mask``: column i): its low bits tell the segment, the rest the bits in it."""
    return F.xxhash64(F.lit(mask), *(k for i, k in enumerate(keys) if mask >> i & 1))


def spots(hashes) -> np.ndarray:
    """Bits in their segment of each hash, a row each."""
    of = np.asarray(hashes, np.int64)
    return np.stack([of >> SEGMENT * (i + 1) & _SPOTS for i in range(BLOOM_HASHES)], axis=-1)


def bloom_size(keys: Column, subsets: int) -> Column:
    """Bits for so many keys: the next power of two, so that the filter never fills up however large the file is."""
    wanted = F.greatest(keys * (BLOOM_PER_KEY * subsets), F.lit(BLOOM_LEAST)).cast("double")
    return F.pow(F.lit(2.0), F.least(F.ceil(F.log2(wanted)), F.lit(30))).cast("long")


def masks(n: int) -> list[int]:
    """Every non-empty subset of up to 4 key columns; of more, each alone and all."""
    if n > 4:
        return [*(1 << i for i in range(n)), (1 << n) - 1]
    return sorted(sum(1 << i for i in chosen) for size in range(1, n + 1) for chosen in combinations(range(n), size))


def build_version(spark: SparkSession, table: str, files: Sequence[DataFile], index: IndexMeta, path: str, codec: str = "snappy") -> None:
    """Writes entries and file statistics of ``files`` below ``path``, compressed by a Parquet codec (or "none")."""
    names = key_names(index)
    rows = located(spark, table, [f.path for f in files]).select(F.col("_file").alias("file"), F.col("_row").alias("row"), *(F.col(c).alias(n) for c, n in zip(index.columns, names, strict=True)))
    if index.kind == "bitmap":
        entries = bitmaps(rows, names)
    else:
        entries = rows.groupBy("file", *names).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("row")).alias("rows"))  # at most a file's rows
    entries.repartitionByRange(*names, "file").sortWithinPartitions(*names, "file").write.option("compression", codec).parquet(f"{path}/entries")
    # All of a key's entries of a file are in one range.
    stored = spark.read.parquet(f"{path}/entries")
    held = stored.select(range_number().alias("p"), file_id(F.col("file")).alias("id"), *names, "n")
    if index.kind == "bitmap":
        held = held.groupBy("p", "id", *names).agg(F.sum("n").alias("n"))
    key_counts(held, names).write.option("compression", codec).parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    if index.kind != "bitmap":  # whose samples and Bloom bits nothing asks for
        key_sample(held, names).write.option("compression", codec).parquet(f"{path}/sample")
        bloom_segments(held, names, counts).write.option("compression", codec).parquet(f"{path}/bloom")
    sizes = spark.createDataFrame([(f.path, f.size, f.modified) for f in files], "file string, size long, modified long").withColumn("id", file_id(F.col("file")))
    sizes.join(file_statistics(held, names, counts), "id", "left").write.option("compression", codec).parquet(f"{path}/files")


def bitmaps(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``file, k0.., bucket, n, bitmap`` as ``bitmap_construct_agg`` makes them of ``rows (file, row, k0..)``, but without a sort of all rows: 64 row numbers become one word first.

    Bit 0 of a bucket is number 1, so row numbers are moved up by one.
    """
    number = F.col("row") + 1
    at = rows.select("file", *names, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).cast("int").alias("at"))
    bit = F.expr("shiftleft(1L, 56 - (at & 56) + (at & 7))")  # the first byte of a word is its highest
    words = at.groupBy("file", *names, "bucket", F.shiftright("at", 6).alias("word")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"))
    buckets = words.groupBy("file", *names, "bucket").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    gap = lambda x, i: x["word"] - F.coalesce(F.get("words", i - 1)["word"], F.lit(-1)) - 1
    each = F.transform("words", lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i) * 16), F.lpad(F.hex(x["bits"]), 16, "0")))
    return buckets.select("file", *names, "bucket", "n", F.unhex(F.rpad(F.array_join(each, ""), 8192, "0")).alias("bitmap"))


def _whole(names: Sequence[str]) -> Column:
    return F.expr(" and ".join(f"{n} is not null" for n in names))


def key_counts(held: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row for each file (``id``) and range of keys (``p``) of ``held (p, id, k0.., n)``: its keys without nulls, rows of those, and how many the ranges before it and the whole file have."""
    n = F.when(_whole(names), F.col("n")).otherwise(0)
    found = held.groupBy("id", "p").agg(F.sum("n").alias("rows"), F.sum(n).alias("held"), F.count_if(_whole(names)).alias("keys"))
    before, file = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("id")
    return found.select("*", F.coalesce(F.sum("keys").over(before), F.lit(0)).alias("keys_before"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("held_before"), F.sum("keys").over(file).alias("total"))


def range_number() -> Column:
    """Which range of keys a row of a range-partitioned Parquet table is of: Spark numbers the files that it writes in that order."""
    return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")


def tile(at: Column, parts: int) -> Column:
    """The part (from 1, as ``ntile`` deals them) of row number ``at`` of ``total``; before the first row 0, after the last ``parts + 1``."""
    short, more = F.expr(f"total div {parts}"), F.expr(f"total % {parts}")
    longer = more * (short + 1)
    div = lambda a, b: F.floor(a / F.nullif(b, F.lit(0)))
    return F.when(at < 1, F.lit(0)).when(at > F.col("total"), F.lit(parts + 1)).when(at <= longer, div(at - 1, short + 1) + 1).otherwise(more + div(at - longer - 1, short) + 1).cast("int")


def file_statistics(held: DataFrame, names: Sequence[str], counts: DataFrame) -> DataFrame:
    """One row a file: row counts, bounds, and parts. Only ranges in which a part begins or ends are looked through."""
    at, last = F.col("keys_before") + 1, F.col("keys_before") + F.col("keys")
    edges = counts.where("keys > 0").where((tile(at - 1, PARTS) != tile(at, PARTS)) | (tile(at, PARTS) != tile(last, PARTS)) | (tile(last, PARTS) != tile(last + 1, PARTS)))
    order = Window.partitionBy("id", "p").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.where(_whole(names)).join(edges.select("id", "p", "keys_before", "held_before", "total"), ["id", "p"])
    ranked = ranked.select("id", *names, "total", (F.count("*").over(order) + F.col("keys_before")).alias("at"), (F.sum("n").over(order) + F.col("held_before")).alias("upto"))
    at, key = F.col("at"), F.struct(*names)
    ends = ranked.withColumn("part", tile(at, PARTS)).where((tile(at - 1, PARTS) != F.col("part")) | (tile(at + 1, PARTS) != F.col("part")))
    parts = ends.groupBy("id", "part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max("upto").alias("upto"))
    stats = parts.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("part", "low", "high", "upto"))).alias("parts"))
    whole = counts.groupBy("id").agg(F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("held")).alias("nulls"), F.max("total").alias("keys"))
    return whole.withColumn("segments", _segments(F.col("keys"), names)).join(stats, "id", "left")


def key_sample(held: DataFrame, names: Sequence[str]) -> DataFrame:
    """``id, k0..``: of each file the keys of least hash. Hash ranges are counted first, so that only the sample is ranked."""
    keys = held.where(_whole(names)).select("id", *names, F.xxhash64(*names).alias("h")).withColumn("range", F.shiftright("h", 64 - RANGES))
    upto, file = Window.partitionBy("id").orderBy("range").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("id")
    ranges = keys.groupBy("id", "range").agg(F.count("*").alias("c")).select("id", "range", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(file).alias("total"))
    wanted = F.greatest(F.ceil(F.col("total") * SAMPLE_RATE), F.least(F.lit(SAMPLE_LEAST), F.col("total")))
    left = ranges.withColumn("left", wanted - F.col("upto") + F.col("c")).where("left > 0 and upto - c + left <= upto")
    cut = left.select("id", F.col("range").alias("cut"), "left")
    order = Window.partitionBy("id", "range").orderBy("h", *names)
    return keys.join(cut, "id").where("range <= cut").withColumn("at", F.row_number().over(order)).where("range < cut or at <= left").select("id", *names)


def _segments(keys: Column, names: Sequence[str]) -> Column:
    """How many segments the Bloom filter of a file with so many keys has: a power of two."""
    return F.when(keys > 0, F.shiftright(bloom_size(keys, len(masks(len(names)))), SEGMENT).cast("int"))


def bloom_segments(held: DataFrame, names: Sequence[str], counts: DataFrame) -> DataFrame:
    """``id, segments, segment, bits`` for each segment of a file's Bloom filter in which a bit is set.

    Of subsets of the columns each value goes there once; whole keys are distinct already.
    """
    keys, columns, all_of = held.where(_whole(names)), [F.col(n) for n in names], masks(len(names))
    hashes = keys.select("id", bloom_hash(columns, (1 << len(names)) - 1).alias("h"))
    if len(all_of) > 1:
        hashes = hashes.union(keys.select("id", F.explode(F.array(*(bloom_hash(columns, m) for m in all_of[:-1]))).alias("h")).distinct())
    sizes = counts.where("total > 0").groupBy("id").agg(F.max("total").alias("keys")).select("id", _segments(F.col("keys"), names).alias("segments"))
    dealt = hashes.join(sizes, "id").withColumn("segment", F.col("h").bitwiseAND(F.col("segments") - 1).cast("int"))
    return dealt.repartition("segment", "id").sortWithinPartitions("segment", "id").select("id", "segments", "segment", "h").mapInArrow(_packed, "id long, segments int, segment int, bits binary")


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of one segment and file: its set bits as 16-bit numbers in order, or as a bitmap where that is no longer."""
    now, flags, out = None, np.zeros(1 << SEGMENT, bool), []

    def close() -> None:
        at = np.flatnonzero(flags)
        out.append((*now, (at.astype("<u2") if len(at) * 2 < len(flags) // 8 else np.packbits(flags, bitorder="little")).tobytes()))
        flags[:] = False

    def done() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["id", "segments", "segment", "bits"])
        out.clear()
        return made

    for batch in batches:
        ids, segments, segment, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        starts = np.flatnonzero((np.diff(ids, prepend=ids[:1]) != 0) | (np.diff(segment, prepend=segment[:1]) != 0))
        for a, b in zip([0, *starts], [*starts, len(ids)], strict=True):
            if a == b:
                continue
            this = int(ids[a]), int(segments[a]), int(segment[a])
            if this != now:
                if now is not None:
                    close()
                now = this
            flags[spots(h[a:b])] = True
            if len(out) >= 1024:
                yield done()
    if now is not None:
        close()
    if out:
        yield done()
