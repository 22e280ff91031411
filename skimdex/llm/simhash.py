"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of its shingles' hashes. For a radius r every fingerprint is
cut down by 2**(r+1)-1 structured masks: bit i has a vector m(i) of r+1 bits, and mask v keeps the bits whose
m(i) has odd overlap with v. At most r differing bits leave a v that is even with all their vectors, so the
pair agrees under that mask: no pair within the radius is missed (Pagh, "CoveringLSH", SODA 2016).

Equal fingerprints meet in a grouped minimum first, so that copies never form pairs. Within a bucket only
enough links to connect its members are returned. A bucket over ``HOT`` fingerprints is dealt out again: its
free bits are cut into r+1 parts, one of which any pair within the radius shares, and so on until it fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, checkpointed, chunks, mixed, parts, released, written
from .components import components

#: Fingerprints of one bucket that a task links by itself when the bucket can still be split.
HOT = 4096
#: The same for buckets of sampled bits; of larger ones, what their least row doesn't settle is searched in pairs
#: of blocks of about this size.
WIDE_HOT = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the lower-cased text; a shorter text is one shingle."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], 42) for s, e in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 bits a lane, each set if it is set in over half the hashes; further lanes remix the hashes."""
    out = np.zeros(lanes, np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        h = hashes if lane == 0 else mixed(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            piece = np.ascontiguousarray(h[at : at + (1 << 16)])
            count += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[lane] = np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, f0, f1, ..`` for every row of ``docs``; a text that is null or has no word gets zeros."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            texts = batch.column("t").cast(pa.large_binary()).to_pylist()
            bits = np.array([fingerprint(shingle_hashes(t or b"", words), lanes) for t in texts], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(lanes))], ["k", *names])

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, " + ", ".join(f"{n} long" for n in names))


def covering_masks(radius: int, width: int = 64) -> list[int]:
    """The 2**(radius+1)-1 masks of ``width`` bits under one of which any two values within the radius agree."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(width) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def submasks(mask: int, pieces: int) -> list[int]:
    """``mask`` with one of ``pieces`` parts of its free bits added to it each time."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[p::pieces]) for p in range(pieces) if free[p::pieces]] or [mask]


def link(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``(i, j)`` of links that connect whatever is connected by pairs within ``radius``.

    Members within half the radius of a pivot are linked to each other through it, so no pair of them is
    tested; two such clumps are tested against each other only while nothing connects them.
    """
    n = len(bits)
    parent = np.arange(n)
    left, right, clumps = [], [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            left.append(i)
            right.append(j)

    def apart(i: int, among: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bits[among] ^ bits[i]).sum(1, dtype=np.int64)

    free = np.ones(n, bool)
    everyone = np.arange(n)
    while (rest := np.flatnonzero(free)).size:
        pivot = int(rest[0])
        far = apart(pivot, everyone)
        for j in np.flatnonzero(far <= radius).tolist():
            join(pivot, j)
        own = np.flatnonzero(free & (2 * far <= radius))
        free[own] = False
        if len(own) > 1:
            clumps.append((pivot, own, int(far[own].max())))
    for x, (p, members, r) in enumerate(clumps):
        for q, others, s in clumps[:x]:
            if root(p) != root(q) and int(np.bitwise_count(bits[p] ^ bits[q]).sum()) <= radius + r + s:
                for i in members.tolist():
                    near = others[apart(i, others) <= radius]
                    if near.size:
                        join(i, int(near[0]))
                        break
    return np.array(left, np.int64), np.array(right, np.int64)


def _linker(lanes: int, radius: int, hot: int | None):
    """Links of each run of equal ``(mask, bucket)``; of one over ``hot`` rows only its name (kind 1)."""
    names = ["a", "b", "kind"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at, held, count = None, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if open_at is not None and hot is not None and count > hot:
                yield pa.RecordBatch.from_arrays([pa.array([open_at[0]], pa.int64()), pa.array([open_at[1]], pa.int64()), pa.array([1], pa.int32())], names)
            elif count > 1:
                rows = np.concatenate(held)
                i, j = link(rows[:, 1:], radius)
                if len(i):
                    node = rows[:, 0].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(np.zeros(len(i), np.int32))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, bucket = batch.column("mask").to_numpy(), batch.column("bucket").to_numpy()
            rows = np.stack([batch.column(n).to_numpy().view(np.uint64) for n in ("node", *(f"f{i}" for i in range(lanes)))], 1)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(mask)], strict=True):
                if (at := (int(mask[s]), int(bucket[s]))) != open_at:
                    yield from close()
                    open_at, held, count = at, [], 0
                count += e - s
                if hot is not None and count > hot:
                    held = []
                else:
                    held.append(rows[s:e])
        yield from close()

    return run


def _links(buckets: DataFrame, lanes: int, radius: int, hot: int | None) -> DataFrame:
    dealt = buckets.repartition(parts(buckets.sparkSession), "mask", "bucket").sortWithinPartitions("mask", "bucket")
    return dealt.mapInArrow(_linker(lanes, radius, hot), "a long, b long, kind int")


def covered_links(prints: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """``(a, b)``: links that connect all ``prints (node, f0)`` with fingerprints within ``radius`` bits.

    Exact: a bucket over ``hot`` rows is split by r+1 parts of its free bits until none is; a mask of 64 bits
    holds one fingerprint only, so this ends.
    """
    spark = prints.sparkSession
    masks = [_SIGNED(m) for m in covering_masks(radius)]
    buckets = prints.select("node", "f0", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")).withColumn("bucket", F.col("f0").bitwiseAND(F.col("mask")))
    found = []
    while True:
        step = checkpointed(_links(buckets, 1, radius, hot))
        found.append(step.where("kind = 0").select("a", "b"))
        over = step.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("bucket"))
        if over.isEmpty():
            break
        # 31 * 5**depth rows; each level adds bits to every mask, so 64 bits bound the depth and no data does.
        finer = spark.createDataFrame([(m, _SIGNED(s)) for m in masks for s in submasks(m % (1 << 64), radius + 1)], "mask long, sub long")
        deeper = buckets.join(over, ["mask", "bucket"]).join(F.broadcast(finer) if len(masks) <= 20_000 else finer, "mask")
        buckets = checkpointed(deeper.select("node", "f0", F.col("sub").alias("mask"), F.col("f0").bitwiseAND(F.col("sub")).alias("bucket")))
        masks = sorted({_SIGNED(s) for m in masks for s in submasks(m % (1 << 64), radius + 1)})
    return reduce(DataFrame.union, found)


def sampled_masks(tables: int, bits: int, lanes: int) -> list[list[int]]:
    """For each table one mask a lane: ``bits`` of all the bits, dealt so that tables use every bit equally often."""
    width, rng = 64 * lanes, np.random.default_rng(20160110)
    order = np.concatenate([rng.permutation(width) for _ in range(-(-tables * bits // width))])
    return [_lanes(order[t * bits : (t + 1) * bits], lanes) for t in range(tables)]


def _lanes(chosen: Iterable[int], lanes: int) -> list[int]:
    bits = {int(i) for i in chosen}
    return [_SIGNED(sum(1 << i % 64 for i in bits if i // 64 == lane)) for lane in range(lanes)]


def _apart(lanes: int):
    """Differing bits of the fingerprints ``f0, ..`` and ``p0, ..``."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"p{i}"))) for i in range(lanes)))


def near_pivots(mine: DataFrame, distinct: DataFrame, lanes: int, radius: int) -> DataFrame:
    """``mine (node, .., mask, bucket)`` with ``pivot``, the least node of the bucket, and whether it is ``near``."""
    least = written(mine.groupBy("mask", "bucket").agg(F.min("node").alias("pivot")), "least")
    lane = [F.col(f"f{i}").alias(f"p{i}") for i in range(lanes)]
    pivots = written(least.join(distinct.select(F.col("node").alias("pivot"), *lane), "pivot"), "pivots")
    near = (F.col("node") != F.col("pivot")) & (_apart(lanes) <= radius)
    return mine.join(pivots, ["mask", "bucket"]).withColumn("near", near).drop(*(f"p{i}" for i in range(lanes)))


def block_pairs(mine: DataFrame, hot: int) -> DataFrame:
    """The rows of buckets ``mine (node, .., mask, bucket, settled)``, dealt out so that pairs of one bucket meet again.

    Rows that are ``settled`` are linked to their bucket's pivot, so only pairs with an open row are of interest.
    Open and settled rows of a bucket are cut into blocks of about ``hot`` rows by hash, and each two blocks one
    of which is open become a bucket of their own. A family of near copies, settled but for a few, is so sent once.
    """
    cut = lambda c: F.ceil(F.count_if(c) / hot).cast("int")
    sizes = written(mine.groupBy("mask", "bucket").agg(cut(~F.col("settled")).alias("open"), cut(F.col("settled")).alias("shut")).where("open > 0"), "sizes")
    dealt = mine.join(sizes, ["mask", "bucket"])
    among = F.when(F.col("settled"), F.col("shut")).otherwise(F.col("open"))
    own = F.pmod(F.xxhash64("node"), among).cast("int") + F.when(F.col("settled"), F.col("open")).otherwise(0)
    last = F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("shut")) - 1
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("own <> other")
    return dealt.withColumn("bucket", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).drop("open", "shut", "own", "other", "settled", "pivot", "near")


def wide_buckets(prints: DataFrame, lanes: int, tables: int, bits: int) -> DataFrame:
    """``(node, f0, .., mask, bucket)``: each fingerprint under each of the sampled masks."""
    lane = [F.col(f"f{i}") for i in range(lanes)]
    under = lambda row: F.xxhash64(*(c.bitwiseAND(F.lit(m).cast("long")) for c, m in zip(lane, row, strict=True)))
    made = [F.struct(F.lit(t).cast("long").alias("mask"), under(row).alias("bucket")) for t, row in enumerate(sampled_masks(tables, bits, lanes))]
    return prints.select("node", *lane, F.explode(F.array(*made)).alias("at")).select("node", *lane, "at.mask", "at.bucket")


def _far(bits: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits ^ row).sum(1, dtype=np.int64)


def star(bits: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """``(pivot, rows)``: pivots in order, each with all rows within ``radius`` of it that are no earlier pivots.

    A row near a pivot is none itself. Each pair within the radius has a pivot in it or is of two rows near pivots.
    """
    if len(bits) <= 256 and np.count_nonzero(np.bitwise_count(bits[:, None] ^ bits[None]).sum(2, dtype=np.int64) <= radius) == len(bits):
        return []
    free, out = np.ones(len(bits), bool), []
    while (rest := np.flatnonzero(free)).size:
        pivot = int(rest[0])
        near = np.flatnonzero(_far(bits, bits[pivot]) <= radius)
        near = near[near != pivot]
        free[pivot] = free[near] = False
        if near.size:
            out.append((pivot, near))
    return out


def _grouped(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str], hot: int | None = None) -> Iterator[tuple[tuple, np.ndarray | None]]:
    """Each run of equal ``keys`` with its ``columns`` as a matrix of 64 bits, or None for over ``hot`` rows."""
    open_at, held, count = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        rows = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in columns], 1)
        cuts = (np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()
        for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if (now := tuple(at[s].tolist())) != open_at:
                if open_at is not None:
                    yield open_at, None if hot is not None and count > hot else np.concatenate(held)
                open_at, held, count = now, [], 0
            count += e - s
            if hot is not None and count > hot:
                held = []
            else:
                held.append(rows[s:e])
    if open_at is not None:
        yield open_at, None if hot is not None and count > hot else np.concatenate(held)


def _stars(lanes: int, radius: int, hot: int | None):
    """Kind 0: pivot and row of a star. Kind 1: mask and bucket over ``hot``. Kind 2: a bucket's name and a row near a pivot in it."""
    columns = ["node", *(f"f{i}" for i in range(lanes))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = np.concatenate([np.full(len(a), kind, np.int32) for a, _, kind in out])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)] + [pa.array(kinds)], ["a", "b", "kind"])

        for (mask, bucket), rows in _grouped(batches, ["mask", "bucket"], columns, hot):
            if rows is None:
                out.append((np.array([mask]), np.array([bucket]), 1))
            elif len(rows) > 1 and (found := star(rows[:, 1:], radius)):
                node = rows[:, 0].view(np.int64)
                out.extend((np.full(len(near), node[p]), node[near], 0) for p, near in found)
                near = np.unique(np.concatenate([n for _, n in found]))
                if len(near) > 1:
                    name = mixed(np.array([mask], np.int64).view(np.uint64) + mixed(np.array([bucket], np.int64).view(np.uint64))).view(np.int64)
                    out.append((np.repeat(name, len(near)), node[near], 2))
                size += sum(len(n) for _, n in found)
            if size > 50_000 or len(out) > 20_000:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()
        released()

    return run


def _common(own: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of ``own`` (sorted) each set flat[start:start+size] has."""
    ends = np.cumsum(size)
    values = flat[np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)]
    hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[ends] - total[ends - size]


def _rest(lanes: int, radius: int):
    """Links of each run of one group: pairs within ``radius`` with a similarity of 0.8 or more.

    Only enough of them are returned to tie together what has different roots, so a group of n rows gives n-1 links
    at most, however many of its pairs must be looked at.
    """

    def links(node: np.ndarray, root: np.ndarray, bits: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(x) for x in sets])
        flat, start = np.concatenate(sets), np.cumsum(size) - size
        root = np.unique(root, return_inverse=True)[1].copy()
        for i in range(len(node) - 1):
            near = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (_far(bits[i + 1 :], bits[i]) <= radius))
            near = near[(9 * np.minimum(size[near], size[i]) >= 4 * (size[near] + size[i])) & (size[near] > 0)]
            if not near.size or not size[i]:
                continue
            alike = near[9 * _common(sets[i], flat, start[near], size[near]) >= 4 * (size[near] + size[i])]
            for j in alike.tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    yield int(node[i]), int(node[j])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []

        def close(held: list) -> None:
            if len(held) > 1:
                node, root = (np.array([r[c] for r in held], np.int64) for c in (0, 1))
                bits = np.array([r[2] for r in held], np.int64).view(np.uint64)
                out.extend(links(node, root, bits, [np.frombuffer(r[3], np.uint64) for r in held]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "node", "root", "shingles")]
            bits = np.stack([batch.column(f"f{i}").to_numpy() for i in range(lanes)], 1) if batch.num_rows else ()
            for grp, node, root, shingles, own in zip(*columns, bits, strict=True):
                if grp != at:
                    close(held)
                    at, held = grp, []
                held.append((node, root, own, shingles))
            if len(out) > 50_000:
                yield _pairs(out)
                out.clear()
        close(held)
        if out:
            yield _pairs(out)
        released()

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def sketches(docs: DataFrame, words: int, lanes: int, shingles: bool = False) -> DataFrame:
    """``(k, node, h, f0, ..)``: the hash of the set of a text's shingles, of the text, and the set's fingerprint.

    With ``shingles``: ``(node, shingles)``, the sorted hashes of the set themselves.
    """
    lane = [f"f{i}" for i in range(lanes)]
    names = ["node", "shingles"] if shingles else ["k", "node", "h", *lane]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            hashes = [np.unique(shingle_hashes(t, words)) for t in batch.column("t").cast(pa.large_binary()).to_pylist()]
            sets = [h.tobytes() for h in hashes]
            node = pa.array(np.array([xxhash.xxh64_intdigest(x, 42) for x in sets], np.uint64).view(np.int64))
            if shingles:
                yield pa.RecordBatch.from_arrays([node, pa.array(sets, pa.binary())], names)
            else:
                bits = np.array([fingerprint(h, lanes) for h in hashes], np.uint64).reshape(-1, lanes)
                cut = [pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(lanes)]
                yield pa.RecordBatch.from_arrays([batch.column("k"), node, batch.column("h"), *cut], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = "node long, shingles binary" if shingles else f"k {kind}, node long, h long, " + ", ".join(f"{c} long" for c in lane)
    return batched(docs).select(F.col("doc_id").alias("k"), F.col("text").cast("string").alias("t")).withColumn("h", F.xxhash64("t")).mapInArrow(run, shape)


def shingle_sets(docs: DataFrame, distinct: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of ``nodes (node)``: one text of each, by ``distinct (node, h, ..)``, is shingled again."""
    asked = written(distinct.join(nodes.distinct(), "node").select("h"), "asked")
    asked = F.broadcast(asked) if asked.count() <= 1_000_000 else asked
    texts = docs.select("doc_id", "text").join(asked, F.xxhash64(F.col("text").cast("string")) == asked["h"], "left_semi")
    made = written(sketches(texts, words, 1, True), "sets")
    return written(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``(a, b)`` whose sets have a Jaccard similarity of 4/5 or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            n = len(p) + len(q)
            small = min(len(p), len(q))
            keep.append(9 * small >= 4 * n and 9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * n)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    released()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct ``pairs (a, b)`` whose ``sets (node, shingles)`` have a similarity of 0.8 or more."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "verified")


def similar_links(distinct: DataFrame, sets_of: Callable[[DataFrame], DataFrame], lanes: int, radius: int, tables: int, bits: int, hot: int = WIDE_HOT) -> DataFrame:
    """``(a, b)``: links of similarity 0.8 or more that connect what such pairs connect, of pairs that meet.

    ``distinct (node, f0, ..)`` are the fingerprints, ``sets_of`` gives the shingle sets of a table of nodes.
    A pair meets if it agrees under a mask and is within ``radius``: two fingerprints that differ in a share s of
    their bits agree with probability 1-(1-(1-s)**bits)**tables, whatever else is in their buckets. A bucket over
    ``hot`` rows is held against its least row first, and what that doesn't settle is searched in pairs of blocks.
    In each bucket the pairs of a star are verified first; then all its other pairs, but for those that verified
    pairs connect already.
    """
    spark, lane = distinct.sparkSession, [f"f{i}" for i in range(lanes)]
    deal = lambda rows, most: written(batched(rows).repartition(parts(spark), "mask", "bucket").sortWithinPartitions("mask", "bucket", "node").mapInArrow(_stars(lanes, radius, most), "a long, b long, kind int"), "stars")
    buckets = wide_buckets(distinct, lanes, tables, bits)
    step, settled = deal(buckets, hot), None
    over = step.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("bucket"))
    if not over.isEmpty():
        mine = written(near_pivots(written(buckets.join(over, ["mask", "bucket"]), "hot"), distinct, lanes, radius), "hot")
        asked = mine.where("near").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        settled = verified(asked, sets_of(asked.select(F.col("a").alias("node")).union(asked.select("b"))))
        known = settled.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.lit(True).alias("settled"))
        mine = mine.join(known, ["pivot", "node"], "left").withColumn("settled", F.coalesce("settled", F.col("node") == F.col("pivot")))
        step = step.where("kind <> 1").union(deal(block_pairs(written(mine, "hot"), hot), None))
    stars = step.where("kind = 0").select("a", "b")
    sets = sets_of(stars.select(F.col("a").alias("node")).union(stars.select("b")))  # other pairs are of these rows too
    first = verified(stars, sets)
    rooted = written(components(first if settled is None else first.union(settled)), "rooted")
    near = step.where("kind = 2").select(F.col("a").alias("grp"), F.col("b").alias("node")).distinct()
    near = written(near.join(rooted, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root")), "near")
    mixed_groups = written(near.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp"), "groups")
    rest = near.join(mixed_groups, "grp").join(distinct.select("node", *lane), "node").join(sets, "node").select("grp", "node", "root", *lane, "shingles")
    rest = rest.repartition(parts(spark), "grp").sortWithinPartitions("grp").mapInArrow(_rest(lanes, radius), "a long, b long")
    return rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).union(written(rest, "rest"))


def classes(docs: DataFrame, words: int = 4, radius: int = 4, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """One row ``(key, f0, component_id)`` for each row of ``docs``.

    component_id is the smallest key that is reachable over links of at most ``radius`` differing bits, the
    row's own included; the search is exact (``covered_links``). Null and empty texts share the fingerprint
    zero and are linked like any other. Rows whose key is null keep a row and never name a component unless no other key is in it (then it is null).
    Repeated rows give repeated rows. Other columns of ``docs``, whatever their names, are not looked at. An
    empty table gives an empty result.
    """
    prints = written(fingerprints(docs, words, 1, text, key), "fingerprints")
    distinct = prints.groupBy("f0").agg(F.min("k").alias("least")).withColumn("node", F.col("f0"))
    links = covered_links(distinct, radius, hot)
    rooted = distinct.join(components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    lookup = rooted.join(named, "root").select(F.col("node").alias("n"), "component_id")
    return prints.withColumn("n", F.col("f0")).join(lookup, "n").select(F.col("k").alias(key), "f0", "component_id")


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles, 64 bits, links at 4 or fewer differing bits."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, words: int = 5, radius: int = 72, lanes: int = 4, tables: int = 64, bits: int = 16, hot: int = WIDE_HOT) -> DataFrame:
    """``docs`` without the later documents of each near-duplicate group (the smallest doc_id stays).

    A group is connected by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Fingerprints only propose pairs: at 0.8 the cosine is about 0.89, hence 15.2 % of SimHash bits differ (39 of
    256, deviation 5.7), and 72 bits are nearly six deviations beyond. Each proposed pair is held against the
    shingles themselves. Rows with one doc_id stay or go together. Texts without a word are no copies of
    anything and stay, and so do rows without a doc_id.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    prints = written(sketches(known, words, lanes), "sketches")
    distinct = written(prints.groupBy("node").agg(F.min("h").alias("h"), *(F.first(f"f{i}").alias(f"f{i}") for i in range(lanes))), "distinct")
    links = similar_links(distinct, lambda nodes: shingle_sets(known, distinct, nodes, words), lanes, radius, tables, bits, hot)
    roots = components(links).withColumnRenamed("node", "n")
    rows = prints.count()
    rooted = prints.join(roots, prints.node == F.col("n"), "left").select("k", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted", rows=rows)
    named = written(rooted.groupBy("root").agg(F.min("k").alias("least")), "named", rows=rows)
    later = rooted.join(named, "root").where("k <> least").select(F.col("k").alias("doc_id")).distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
