"""Removal of long repeated byte strings across documents.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or further up in
the document). Sorting every suffix of a corpus would shuffle many times its size, so windows that can't repeat
are left out first, exactly:

1. Each window of ``LENGTH`` bytes names the least of its ``GRAM``-byte hashes, its anchor. Equal windows name
   equal anchors. Successive windows with one anchor are a run; its context is the bytes of all its windows.
2. The least place of each (anchor, context) is its first run; windows of any other run repeat those of the
   first. An anchor with one context repeats nowhere else. Contexts are told apart by 128 bits (XXH3), which no
   polynomial structure of a text can defeat: among 10**14 runs two are mistaken with a chance of 10**-11.
3. Windows of first runs whose anchor has several contexts may still repeat in part. Their contexts are
   suffix-sorted (see ``suffix_sort``), anchors dealt out over tasks; in the sorted order, neighbours that share
   ``LENGTH`` bytes are copies, verified by their bytes.
4. An anchor of over ``HOT_RUNS`` contexts isn't sorted: each of its windows is told by its own 128 bits, and a
   grouped minimum, combined before the shuffle, says where it comes first.

Anchors that are very frequent, as a sample of the documents tells, are dealt out by anchor and context in step 2
(to none of the answers does it matter which they are). So no task gathers an anchor's runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, batched, chunks, flat, parts, prefix_hashes, released, span_hashes, written
from .suffix_sort import Suffixes

LENGTH, GRAM = 100, 32
#: Contexts of one anchor that are sorted together; a block of contexts that a task sorts at once, in bytes.
HOT_RUNS, SORT_BYTES = 2000, 1 << 20
#: One of so many documents is looked at for frequent anchors; an anchor is one with so many runs there, and at
#: least one of so many of all runs there, which bounds their number.
SAMPLED, FREQUENT, LARGEST = 64, 2000, 50_000


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """First and last window start of each run, its anchor's hash, and the text it is in."""
    grams, span = len(data) - gram + 1, length - gram + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, np.empty(0, np.uint64), none
    prefix = prefix_hashes(BYTE_VALUE[data])
    at = np.arange(grams)
    hashes = span_hashes(prefix, at, at + gram)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: grams - span + 1], least[span - width : span - width + grams - span + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(len(anchor) + 1, np.int8)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    fits[offsets[long]] += 1
    fits[offsets[long + 1] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(fits[:-1], dtype=np.int8))  # windows inside one text
    if not len(start):
        return none, none, np.empty(0, np.uint64), none
    new = np.concatenate(([True], (np.diff(start) > 1) | (np.diff(anchor[start]) != 0)))
    row = np.searchsorted(offsets, start, side="right") - 1
    new[1:] |= row[1:] != row[:-1]
    heads = np.flatnonzero(new)
    first, last = start[heads], start[np.append(heads[1:], len(start)) - 1]
    return first, last, hashes[anchor[first]], row[heads]


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each raw[start:end], as two columns."""
    h = xxhash.xxh3_128_digest
    made = b"".join([h(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def _named_runs(length: int, gram: int):
    """``(anchor, c0, c1, k, s)`` of each run, copies of a block reduced to the first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            data, offsets = flat(batch.column("t"))
            first, last, anchor, row = runs(data, offsets, length, gram)
            context = digests(data.tobytes(), first, last + length)
            k, s = batch.column("k").to_numpy()[row], first - offsets[row]
            order = np.lexsort((s, k, context[:, 1], context[:, 0]))  # the block's first of each context
            sorted_ = context[order]
            order = order[np.concatenate(([True], (sorted_[1:] != sorted_[:-1]).any(1)))[: len(order)]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[order].view(np.int64)), pa.array(context[order, 0]), pa.array(context[order, 1]), pa.array(k[order]), pa.array(s[order].astype(np.int32))], ["anchor", "c0", "c1", "k", "s"])

    return run


def _anchors(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            yield pa.RecordBatch.from_arrays([pa.array(runs(*flat(batch.column("t")), length, gram)[2].view(np.int64))], ["anchor"])

    return run


def frequent_anchors(docs: DataFrame, length: int, gram: int, sampled: int = SAMPLED, frequent: int = FREQUENT) -> DataFrame:
    """``(anchor)``: at most ``LARGEST`` of those that a sample of ``docs (k, t)`` has often."""
    some = docs.where(F.pmod(F.xxhash64("k"), F.lit(sampled)) == 0).select("k", "t")
    counts = written(some.mapInArrow(_anchors(length, gram), "anchor long").groupBy("anchor").agg(F.count("*").alias("c")), "sampled-anchors")
    least = max(frequent, (counts.agg(F.sum("c")).first()[0] or 0) // LARGEST)
    return counts.where(F.col("c") > least).select("anchor")


def _firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (anchor, c0, c1, k, s): the first of each context, and whether its anchor has others.

    A frequent anchor (``hot``) has others, perhaps in other tasks.
    """
    last = None  # the last first: (anchor, c0, c1, k, s, shared)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, c, d, k, s, hot = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "c0", "c1", "k", "s", "hot"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        if last is not None:
            new[0] = (a[0], c[0], d[0]) != last[:3]
        at = np.flatnonzero(new)
        if not len(at):
            continue
        a, c, d, k, s, shared = a[at], c[at], d[at], k[at], s[at], hot[at].copy()
        shared[1:] |= a[1:] == a[:-1]
        shared[:-1] |= a[1:] == a[:-1]
        if last is not None:
            same = last[0] == a[0]
            shared[0] |= same
            yield _first_rows([last[3]], [last[4]], [last[5] or same])
        if len(a) > 1:
            yield _first_rows(k[:-1], s[:-1], shared[:-1])
        last = (a[-1], c[-1], d[-1], k[-1], s[-1], bool(shared[-1]))
    if last is not None:
        yield _first_rows([last[3]], [last[4]], [last[5]])
    released()


def _first_rows(k, s, shared) -> pa.RecordBatch:
    code = np.asarray(s, np.int64) * 2 + np.asarray(shared, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(k, np.int64)), pa.array(code)], ["k", "code"])


def _sifted(length: int, gram: int):
    """Of texts with their first runs: stretches of windows that repeat (kind 0), and contexts to sort (kind 1)."""
    names = ["kind", "k", "s", "n", "anchor", "bytes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            data, offsets = flat(batch.column("t"))
            first, last, anchor, row = runs(data, offsets, length, gram)
            if not len(first):
                continue
            k = batch.column("k").to_numpy()
            codes = batch.column("codes")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(codes.offsets.to_numpy()))
            code = codes.flatten().to_numpy()
            where = np.searchsorted(first, (code >> 1) + offsets[owner])
            own, shared = np.zeros(len(first), bool), np.zeros(len(first), bool)
            own[where] = True
            shared[where] = (code & 1).astype(bool)
            s, e = _stretches(first[~own], last[~own] + 1, row[~own])
            r = np.searchsorted(offsets, s, side="right") - 1
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(s), np.int32)), pa.array(k[r]), pa.array((s - offsets[r]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.binary())], names)
            raw, pick = data.tobytes(), np.flatnonzero(shared)
            if len(pick):
                f, l, r = first[pick], last[pick], row[pick]
                texts = [raw[a : b + length] for a, b in zip(f.tolist(), l.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(f), np.int32)), pa.array(k[r]), pa.array((f - offsets[r]).astype(np.int32)), pa.array((l - f + 1).astype(np.int32)), pa.array(anchor[pick].view(np.int64)), pa.array(texts, pa.binary())], names)

    return run


def _stretches(start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjoining [start, end) of one row as one."""
    if not len(start):
        return start, end
    new = np.concatenate(([True], (start[1:] != end[:-1]) | (row[1:] != row[:-1])))
    heads = np.flatnonzero(new)
    return start[heads], end[np.append(heads[1:], len(start)) - 1]


def _sorted_copies(length: int, block: int):
    """Of contexts in order of their anchors: stretches of windows that repeat an earlier window."""

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = flat(table.column("bytes"))
        k, s, n = (table.column(c).to_numpy() for c in ("k", "s", "n"))
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[row] + within
        place = np.lexsort((s[row] + within, k[row]))  # equal suffixes keep this order, so the first is the earliest
        row, within, start = row[place], within[place], start[place]
        order, shared = Suffixes(data, start, length).sort()
        again = np.sort(order[shared >= length])
        again = again[np.lexsort((within[again], row[again]))]
        at, owner = s[row[again]] + within[again], row[again]
        b, e = _stretches(at, at + 1, owner)
        if len(b):
            heads = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(k[owner[heads]]), pa.array(b.astype(np.int32)), pa.array((e - b).astype(np.int32))], ["k", "s", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column("anchor").to_numpy()
            cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
            bytes_upto = np.concatenate(([0], np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy())))
            at = 0
            for edge in [0, *cuts.tolist()]:
                new = edge > 0 or a[0] != last
                if new and size + bytes_upto[edge] - bytes_upto[at] >= block:
                    if edge > at:
                        held.append(batch.slice(at, edge - at))
                    yield from answer(held)
                    held, size, at = [], 0, edge
            held.append(batch.slice(at))
            size += int(bytes_upto[-1] - bytes_upto[at])
            last = a[-1]
        if held:
            yield from answer(held)
        released()

    return run


def _windows(length: int):
    """``(w0, w1, k, s)``: each window of contexts by itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "bytes", 1 << 16):
            data, offsets = flat(batch.column("bytes"))
            k, s, n = (batch.column(c).to_numpy() for c in ("k", "s", "n"))
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = offsets[row] + within
            told = digests(data.tobytes(), start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1]), pa.array(k[row]), pa.array((s[row] + within).astype(np.int32))], ["w0", "w1", "k", "s"])

    return run


def hot_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """``(k, s, n)``: windows of ``contexts`` that come earlier in another of them."""
    windows = written(contexts.select("k", "s", "n", "bytes").mapInArrow(_windows(length), "w0 long, w1 long, k long, s int"), "windows")
    # The least place of each: of the least document, then in it. Both are grouped minima of plain numbers.
    inside = windows.groupBy("w0", "w1", "k").agg(F.min("s").alias("s"))
    least = written(inside.groupBy("w0", "w1").agg(F.min("k").alias("k0"), F.min_by("s", "k").alias("s0"), F.count("*").alias("docs")), "first-windows")
    return windows.join(least, ["w0", "w1"]).where("k <> k0 or s <> s0").select("k", "s", F.lit(1).alias("n"))


def _numbered(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, bool]:
    """``(k, t)`` with k unique: the keys, or if some repeat or are null, numbers in the order of (key, text)."""
    plain = batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    row = plain.agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).first()
    if row.n == row.d:
        return plain.withColumn("k", F.col("k").cast("long")), True
    ranged = plain.repartitionByRange(parts(docs.sparkSession), "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    return written(ranged.select(F.col("k").alias("key"), F.monotonically_increasing_id().alias("k"), "t"), "numbered"), False


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``(k, s, n)``: windows s to s+n-1 of ``docs (k unique, t)`` that start earlier elsewhere too; stretches may overlap."""
    spark = docs.sparkSession
    named = docs.select("k", "t").mapInArrow(_named_runs(length, gram), "anchor long, c0 long, c1 long, k long, s int")
    frequent = F.broadcast(frequent_anchors(docs, length, gram).withColumn("hot", F.lit(True)))  # LARGEST rows at most
    named = named.join(frequent, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = named.withColumn("piece", F.when(F.col("hot"), F.col("c0"))).repartition(parts(spark), "anchor", "piece").sortWithinPartitions("anchor", "c0", "c1", "k", "s")
    firsts = dealt.mapInArrow(_firsts, "k long, code long").groupBy("k").agg(F.sort_array(F.collect_list("code")).alias("codes"))  # at most a document's windows
    sifted = docs.select("k", "t").join(firsts, "k", "left").select("k", "t", F.coalesce("codes", F.array().cast("array<long>")).alias("codes"))
    sifted = written(sifted.mapInArrow(_sifted(length, gram), "kind int, k long, s int, n int, anchor long, bytes binary"), "sifted")
    contexts = sifted.where("kind = 1")
    hot = written(contexts.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > hot_runs).select("anchor"), "hot-anchors")
    many = hot.count()
    hot = F.broadcast(hot) if many <= 100_000 else hot
    grouped = contexts.join(hot, "anchor", "left_anti").select("anchor", "k", "s", "n", "bytes").repartition(parts(spark), "anchor").sortWithinPartitions("anchor")
    again = grouped.mapInArrow(_sorted_copies(length, SORT_BYTES), "k long, s int, n int")
    if many:
        again = again.union(hot_repeats(contexts.join(hot, "anchor", "left_semi"), length))
    return sifted.where("kind = 0").select("k", "s", "n").union(again)


def _kept(raw: bytes, stretches: list, length: int) -> tuple[bytes, int, int]:
    edge = np.zeros(len(raw) + 1, np.int64)
    for s, n in stretches:
        edge[s] += 1
        edge[s + n + length - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[:1].sum()))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def strip(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``(key, kept binary, n_bytes, n_removed, n_spans)`` for each row of ``docs``.

    ``kept``: the text's UTF-8 bytes without the repeated ones; strings are judged on the input. A null text
    counts as empty. Rows whose key repeats or is null are ordered by a hash of their text (null keys first);
    a repeated row is a later copy. Other columns, whatever their names, aren't looked at. An empty table gives
    an empty result. ``length`` is at least 2 and ``gram`` at most ``length``.
    """
    whole, same = _numbered(docs, text, key)
    stretches = repeats(whole, length, min(gram, length), hot_runs).groupBy("k").agg(F.collect_list(F.struct("s", "n")).alias("stretches"))
    shown = F.col("k") if same else F.col("key")
    joined = whole.join(stretches, "k", "left").select(shown.alias("k"), "t", F.col("stretches.s").alias("s"), F.col("stretches.n").alias("n"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            out, texts = [], batch.column("t").cast(pa.large_binary()).to_pylist()
            for t, s, n in zip(texts, batch.column("s").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out.append((t or b"", 0, 0) if not s else _kept(t, list(zip(s, n, strict=True)), length))
            sizes = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([o[0] for o in out], pa.binary()), pa.array(sizes, pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string())], ["k", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    kind = "long" if same else kind
    return joined.mapInArrow(run, f"k {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("k", key)


def op4(spark, sf_dir: str) -> DataFrame:
    return strip(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: What op4 returns, in DuckDB's SQL: every window of 100 bytes is held against every other.
SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
s as (select doc_id, b, unnest(range(0, octet_length(b) - 99)) as i from d),
c as (select doc_id, i, row_number() over (partition by b[i + 1 : i + 100] order by doc_id, i) > 1 as later from s),
m as (select doc_id, i, coalesce(i > lag(i) over p + 100, true) as opens from c where later window p as (partition by doc_id order by i)),
n as (select doc_id, i, sum(opens::int) over (partition by doc_id order by i) as span from m),
spans as (select doc_id, min(i) as low, max(i) + 100 as high from n group by doc_id, span),
gaps as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as after from spans),
cut as (select doc_id, sum(high - low)::bigint as n_removed, count(*) as n_spans, max(high) as last,
    string_agg(hex(b[after + 1 : low]), '' order by low) as kept from gaps join d using (doc_id) group by doc_id)
select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept || hex(b[last + 1 :]), hex(b)))) as kept_sha256
from d left join cut using (doc_id)
"""
