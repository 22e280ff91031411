"""What the operators of this subpackage share: shared storage and flat views of Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as numpy arrays at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch on its way to a Python worker; both sides hold a batch whole.
BATCH_BYTES = 8 << 20
#: Rows of a few numbers each that are worth a file of their own.
FILE_ROWS = 20_000


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset (tests in local mode) a fresh temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if (known := spark.sparkContext.getCheckpointDir()) is not None:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="skimdex-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that only this application needs; what lies there is deleted when its JVM ends."""
    home = f"{shared_root(spark)}/skimdex-llm-{spark.sparkContext.applicationId}"
    if home not in _homes:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _homes.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


_homes: set[str] = set()


def dropped(*tables: DataFrame) -> None:
    """Deletes scratch tables (see ``written``) that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def batched(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded by ``BATCH_BYTES`` where they were larger.

    Python workers and the JVM beside them then hold little at once, however long the texts are.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not (known := conf.get(key, None)) or not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows of a few numbers each, dealt evenly to so many tasks as they are worth.

    Each task that writes makes a file of its own, for which Hadoop's local file system may start processes (``chmod``).
    Where Spark doesn't merge small partitions itself, a small table would be a file for each shuffle partition.
    Tables of more than ``FILE_ROWS`` rows for each of those stay as they are.
    """
    conf, few = df.sparkSession.conf, max(1, -(-rows // FILE_ROWS))
    merged = all(conf.get(f"spark.sql.adaptive.{k}enabled") == "true" for k in ("", "coalescePartitions."))
    return df if merged or few >= parts(df.sparkSession) else df.repartition(few)


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder; ``rows``: it is ``packed``."""
    shared_root(df.sparkSession)
    return (df if rows is None else packed(df, rows)).checkpoint(eager=True)


def written(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: columnar, prunable and free of lineage.

    ``rows``, where it is known that there are no more: the table is ``packed``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if rows is None else packed(df, rows)).write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, rows: int, *keys: str, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """At most ``rows`` rows of ``df``: those of the least XXH64 of ``keys``, ties in the order of the keys.

    A count first tells below which hash they lie, so that no more than about ``rows`` meet in one task. ``cut``
    may make those rows smaller (one for one, keeping the keys) before they do.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    if total > rows:
        share = min(1.0, (rows + 8 * rows**0.5 + 50) / total)
        df = df.where(h <= min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))
    return cut(df).orderBy(h, *keys).limit(rows)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and each row's offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` that hold at most ``most`` bytes of text, or a single row.

    Memory is given back when a task ends, as workers live on beside the next stage's.
    """
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                floor = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, floor + most, side="right")))
                yield batch.slice(at, to - at)
                at = to
    finally:
        released()


def released() -> None:
    """Gives memory that this process holds in reserve back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` in ``data``, and the row that it is in."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 to base**n modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        size = max(1024, 1 << int(n + 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        _powers[int(base)] = known
    return known[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, so that a polynomial in them has no structure of its own.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """data[start:end] of each pair as an Arrow array over the same bytes; spans are in order and don't overlap.

    Its dictionary encoding compares the bytes themselves, so what it calls equal is equal.
    """
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[0], edges[1::2], edges[2::2] = 0, start, end
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return every.take(pa.array(np.arange(1, 2 * len(start), 2)))


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each span of ``data``: two have the same number just if their bytes are equal."""
    return spans(data, start, end).dictionary_encode().indices.to_numpy().astype(np.int64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; zeros follow its end."""
    padded = data if len(data) > 7 and not data[-8:].any() else np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i, whether ``size[i]`` bytes of ``a`` from a_start[i] equal those of ``b`` from b_start[i]."""
    x = _words(a)
    y = x if b is a else _words(b)
    same = (x[a_start] ^ y[b_start]) & _LOW_BYTES[np.minimum(size, 8)] == 0
    more = np.flatnonzero(same & (size > 8))
    same[more] = x[a_start[more] + size[more] - 8] == y[b_start[more] + size[more] - 8]
    more = np.flatnonzero(same & (size > 16))
    if len(more):
        i, j, n = a_start[more], b_start[more], size[more].astype(np.int64)
        ends = np.cumsum(n)
        within = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        differ = np.concatenate(([0], np.cumsum(a[np.repeat(i, n) + within] != b[np.repeat(j, n) + within])))
        same[more] = differ[ends] == differ[ends - n]
    return same


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * base**-j below each index: a polynomial hash of every prefix, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), _INVERSE)[: len(values)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] that doesn't depend on where it stands; lengths are mixed in."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix))[start]
    return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
