"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Each of ``TABLES`` tables hashes a vector by 4 to 16 projections on Gaussian directions, shifted and cut into
cells of one width. A query visits its own bucket and then the buckets a step or two away in some projections,
in the order of the success probability that the query's distance to the cells' edges gives (Lv et al., VLDB
2007). Candidates of all tables are merged and ranked by their exact distance.

Hashes, width and number of probes are fitted: a bounded sample of distinct vectors is searched exactly in one
pass over the whole table, and of the settings that find a given share of those neighbours the one with the least
estimated work at the table's size is taken. So more rows mean finer buckets. Equal vectors share one index entry, which keeps the ``TOP``+1 smallest
ids: more of them can't be answers. Equal queries are searched once. Buckets of over ``BUCKET_ROWS`` entries are cut
into pieces and their visitors, where about as many are expected, into slices; each piece meets each slice under a key
of its own. A query that finds fewer vectors than it should is searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, mixed, parts, written

TOP, TABLES = 10, 6
#: Hashes a table that are tried, with the cells that a probe may move in a projection and the projections that it may
#: move in; cell widths that are tried, in units of the distance to the last neighbour.
HASHES, WIDTHS = {4: (2, 4), 6: (1, 6), 8: (1, 8), 12: (1, 4), 16: (1, 3)}, (0.85, 1.2, 1.7)
#: What a visit to a bucket costs, in distances: it carries the vector through the shuffle.
VISIT = 100
#: Rows of buckets and vectors that a worker sends at once, and answers that it holds before it cuts them down.
SENT, ANSWERS = 8192, 200_000
#: Distinct vectors that the settings are fitted on, how many of them ask, how many candidates are estimated on, and the recall they should reach.
SAMPLE_ROWS, SAMPLE_QUERIES, SAMPLE_MET, RECALL = 2000, 200, 500, 0.95
BUCKET_ROWS = 2048
#: Queries of the exact fallback that one pass over the table answers.
EXACT_QUERIES = 4096


@cache
def steps(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """All steps from a query's cell that probes may take, and their indicators.

    A row of a query's costs of single moves times the indicators gives the steps' scores.
    """
    reach, places = HASHES[hashes]
    moves = [m for m in range(-reach, reach + 1) if m]
    out = [np.zeros(hashes, np.int64)]
    for many in range(1, places + 1):
        for where in combinations(range(hashes), many):
            block = np.zeros((len(moves) ** many, hashes), np.int64)
            block[:, where] = list(product(moves, repeat=many))
            out.append(block)
    every = np.vstack(out)
    marks = (every[:, :, None] == np.arange(-reach, reach + 1)).reshape(len(every), -1)
    return every, np.ascontiguousarray(marks.T.astype(np.float32))


@dataclass
class Index:
    width: float
    probes: int
    hashes: int = 4
    seed: int = 5

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """Real-valued cell coordinates of the rows of ``x``."""
        rng = np.random.default_rng((self.seed, table, x.shape[1]))
        return x @ rng.normal(size=(x.shape[1], self.hashes)) / self.width + rng.random(self.hashes)

    def key(self, cells: np.ndarray, table: int, dim: int) -> np.ndarray:
        key = np.full(cells.shape[:-1], (table * 1_000_003 + dim) & (1 << 64) - 1, np.uint64)
        for j in range(self.hashes):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.int64).view(np.uint64))
        return key.view(np.int64)

    def costs(self, coordinates: np.ndarray) -> np.ndarray:
        """What each move in each projection adds to a step's score: the square of the way to that cell."""
        reach = HASHES[self.hashes][0]
        move = np.arange(-reach, reach + 1)
        inside = (coordinates - np.floor(coordinates))[:, :, None]
        return (np.where(move == 0, 0.0, np.where(move < 0, inside - move - 1, move - inside)) ** 2).astype(np.float32)

    def scores(self, coordinates: np.ndarray) -> np.ndarray:
        """For each row the score of every step, least where success is likeliest."""
        return self.costs(coordinates).reshape(len(coordinates), -1) @ steps(self.hashes)[1]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The keys of each row's bucket in every table."""
        return np.stack([self.key(np.floor(self.cells(x, t)), t, x.shape[1]) for t in range(TABLES)], 1)

    def visited(self, x: np.ndarray, table: int) -> np.ndarray:
        """The keys that each row visits in a table as a query, likeliest first."""
        cells, every = self.cells(x, table), steps(self.hashes)[0]
        score = self.scores(cells)
        best = np.argpartition(score, self.probes - 1, 1)[:, : self.probes]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(score, best, 1), 1), 1)
        return self.key(np.floor(cells)[:, None] + every[best], table, x.shape[1])

    def apart(self, cells: np.ndarray, others: np.ndarray, table: int) -> np.ndarray:
        """Scores of the steps from each row of ``cells`` to the buckets of its row of ``others``; infinite where no probe goes."""
        reach, places = HASHES[self.hashes]
        there = np.floor(self.cells(others.reshape(-1, others.shape[-1]), table)).reshape(*others.shape[:-1], self.hashes)
        step = (there - np.floor(cells)[:, None]).astype(np.int64)
        costs = self.costs(cells)
        score = sum(np.take_along_axis(costs[:, j], np.clip(step[..., j], -reach, reach) + reach, 1) for j in range(self.hashes))
        return np.where((np.abs(step) <= reach).all(-1) & ((step != 0).sum(-1) <= places), score, np.float32(np.inf))


def fit(sample: np.ndarray, near: np.ndarray, rows: int, recall: float = RECALL) -> Index:
    """The index of least estimated work over ``rows`` vectors that finds ``recall`` of ``near``.

    ``near``: the nearest vectors of the first rows of ``sample``, nearest first, in the whole table. If no setting
    reaches the recall, it is the one that finds most.
    """
    if not near.size:
        return Index(1.0, 1)
    asked, best, least = sample[: len(near)], Index(1.0, 1), (2.0, 0.0)
    far = float(np.median(np.sqrt(((near[:, -1] - asked) ** 2).sum(1)))) or 1.0
    others = np.broadcast_to(sample[-SAMPLE_MET:], (len(asked), *sample[-SAMPLE_MET:].shape))
    for hashes, width in product(HASHES, WIDTHS):
        index, needed = Index(far * width, 1, hashes), np.full(near.shape[:2], 1 << 30)
        scores = []
        for t in range(TABLES):
            cells = index.cells(asked, t)
            scores.append((cells, np.sort(index.scores(cells), 1)))
            wanted = index.apart(cells, near, t)
            rank = np.stack([np.searchsorted(s, w) for s, w in zip(scores[-1][1], wanted, strict=True)])
            needed = np.minimum(needed, np.where(np.isfinite(wanted), rank, 1 << 30))
        index.probes = int(min(np.quantile(needed, recall, method="higher") + 1, len(steps(hashes)[0])))
        # Each table's candidates count, as a row that is met in several of them is compared as often.
        work = TABLES * index.probes * VISIT
        if work < least[1] or least[0] > 1 - recall:
            met = sum(float((index.apart(cells, others, t) <= score[:, index.probes - 1 : index.probes]).mean()) for t, (cells, score) in enumerate(scores))
            work += met * rows
        missed = max(float((needed >= index.probes).mean()), 1 - recall)
        if (missed, work) < least:
            best, least = index, (missed, work)
    return best


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column as double-precision matrices, those of one length at a time, with their numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, values[starts[rows][:, None] + np.arange(dim)]


def _exact(q: np.ndarray, x: np.ndarray, tie: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q``: the numbers of its ``top`` nearest rows of ``x`` (ties by ``tie``) and distances."""
    for at in range(0, len(q), 256):
        block = q[at : at + 256]
        rough = (block**2).sum(1)[:, None] + (x**2).sum(1) - 2 * block @ x.T
        edge = np.partition(rough, min(top, len(x)) - 1, 1)[:, min(top, len(x)) - 1]
        slack = 1e-9 * ((block**2).sum(1) + float((x**2).sum(1).max()))
        for i in range(len(block)):
            near = np.flatnonzero(rough[i] <= edge[i] + slack[i])
            far = np.sqrt(((x[near] - block[i]) ** 2).sum(1))
            best = np.lexsort((tie[near], far))[:top]
            yield at + i, near[best], far[best]


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """``(k, v)``: the rows whose vector isn't null, empty or zero and has only finite components, and whose id isn't null."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(key).cast("long").alias("k"), v.alias("v"))


def entries(rows: DataFrame, top: int = TOP) -> DataFrame:
    """``(v, ids)``: each distinct vector with its ``top``+1 smallest ids, cut down before they are shuffled."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("k"))).where(F.col("n") <= top + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("k")).alias("ids"))


def _closest(pool: DataFrame, asked: np.ndarray, count: int) -> DataFrame:
    """``(q, far, v)``: each task's ``count`` nearest vectors to each row of ``asked`` (its number: q)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, near = np.empty((len(asked), 0)), np.empty((len(asked), 0, asked.shape[1]))
        for whole in batches:
            for at in range(0, whole.num_rows, SENT):
                for _, x in _matrix(whole.column("v").slice(at, SENT)):
                    if x.shape[1] != asked.shape[1]:
                        continue
                    d = (asked**2).sum(1)[:, None] + (x**2).sum(1) - 2 * asked @ x.T
                    new = np.argpartition(d, min(count, len(x)) - 1, 1)[:, :count]
                    far, near = np.concatenate((far, np.take_along_axis(d, new, 1)), 1), np.concatenate((near, x[new]), 1)
                    if far.shape[1] > count:
                        kept = np.argpartition(far, count - 1, 1)[:, :count]
                        far, near = np.take_along_axis(far, kept, 1), np.take_along_axis(near, kept[:, :, None], 1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(near.reshape(-1)), asked.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), far.shape[1])), pa.array(far.reshape(-1)), lists], ["q", "far", "v"])

    return pool.select("v").mapInArrow(run, "q long, far double, v array<double>")


def fitted(pool: DataFrame, top: int = TOP, recall: float = RECALL) -> Index:
    """An index for ``pool (v, ids)``, fitted on a sample of its vectors of the commonest length in the sample."""
    sample = hashed_sample(pool.select(F.element_at("ids", 1).alias("k"), "v"), SAMPLE_ROWS, "k").toArrow().column("v").combine_chunks()
    sample = max((x for _, x in _matrix(sample)), key=len, default=np.empty((0, 1)))
    asked = sample[:SAMPLE_QUERIES]
    if len(asked) < 2:
        return Index(1.0, 1)
    order = Window.partitionBy("q").orderBy("far")
    found = _closest(pool, asked, top + 1).withColumn("n", F.row_number().over(order)).where(F.col("n") <= top + 1).select("q", "n", "v").toArrow()
    found = found.sort_by([("q", "ascending"), ("n", "ascending")]).column("v")
    near = next(_matrix(found))[1].reshape(len(asked), -1, asked.shape[1])[:, 1:]  # the first is the asking vector
    return fit(sample, near, pool.count(), recall)


def search(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", top: int = TOP, recall: float = RECALL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``top`` nearest others in ``vectors``.

    Nearest by Euclidean distance in double precision, ties to the smaller id; a row with the query's id is
    never its answer. Vectors that are null, empty, zero or have a null or non-finite component take no part, nor do
    null ids; vectors of different lengths aren't compared. Rows that share an id count as one vector in
    several places. Other columns aren't looked at. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    rows, asking = usable(vectors, vector, key), usable(queries, vector, key)
    kind = vectors.schema[vector].dataType.simpleString()
    pool = written(entries(rows, top), "vectors")
    index = fitted(pool, top, recall)

    def dealt(probing: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                size = max(1, SENT // (index.probes if probing else TABLES))
                for at in range(0, whole.num_rows, size):
                    batch = whole.slice(at, size)
                    for picked, x in _matrix(batch.column("v")):
                        for keys in (index.visited(x, t) for t in range(TABLES)) if probing else [index.buckets(x)]:
                            again = pa.array(np.repeat(picked, keys.shape[1]))
                            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column("v").take(again), batch.column("ids").take(again)], ["bucket", "v", "ids"])

        return run

    shape = f"bucket long, v {kind}, ids array<long>"
    once = written(asking.select("v").distinct().withColumn("k", F.monotonically_increasing_id()), "queries")
    held = pool.mapInArrow(dealt(False), shape)
    pieces, visitors = F.ceil(F.col("c") / BUCKET_ROWS), F.col("c") * (index.probes * once.count() / max(1, pool.count()))
    large = held.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET_ROWS)
    large = written(large.select("bucket", pieces.cast("int").alias("pieces"), F.ceil(visitors / BUCKET_ROWS).cast("int").alias("slices")), "large-buckets")
    large = F.broadcast(large) if large.count() <= 100_000 else large

    def keyed(rows: DataFrame, asks: int, own: str, many: str, other: str, others: str) -> DataFrame:
        one = F.pmod(F.xxhash64("ids"), F.coalesce(many, F.lit(1))).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)).alias(other)
        return rows.join(large, "bucket", "left").select("bucket", one, each, F.lit(asks).alias("asks"), "v", "ids")

    visits = once.select("v", F.array("k").alias("ids")).mapInArrow(dealt(True), shape)
    both = keyed(held, 0, "piece", "pieces", "slice", "slices").unionByName(keyed(visits, 1, "slice", "slices", "piece", "pieces"))
    place = ["bucket", "piece", "slice"]
    met = both.repartition(parts(spark), *place).sortWithinPartitions(*place, "asks").mapInArrow(_meeting(top + 1), "q long, vec_id long, score double")
    found = written(_best(met, top + 1), "neighbours")

    # Whoever found fewer than there are is asked again, against every vector.
    enough = rows.select("k").distinct().limit(top + 1).count()
    short = once.join(found.groupBy("q").agg(F.count("*").alias("c")), once.k == F.col("q"), "left").where(F.coalesce("c", F.lit(0)) < enough).select("k", "v")
    short = written(short, "short")
    extra, n = None, short.count()
    for at in range(0, n, EXACT_QUERIES):
        part = short.orderBy("k").offset(at).limit(EXACT_QUERIES).toArrow()
        one = exact(pool, part.column("k").to_numpy(), part.column("v").combine_chunks(), top + 1)
        extra = one if extra is None else extra.union(one)
    if extra is not None:
        again = short.select(F.col("k").alias("q")).distinct()
        found = found.join(F.broadcast(again) if n <= 100_000 else again, "q", "left_anti").union(_best(extra, top + 1))

    # Each asking row gets what its vector found, but for itself. A hot vector's rows are split by AQE's skew join.
    own = asking.distinct().join(once.select("v", F.col("k").alias("q")), "v").select("k", "q")
    order = Window.partitionBy("k").orderBy("score", "vec_id")
    answers = own.join(found, "q").where("vec_id != k").groupBy("k", "vec_id").agg(F.min("score").alias("score"))
    answers = answers.withColumn("rank", F.row_number().over(order).cast("int"))
    return answers.where(F.col("rank") <= top).select(F.col("k").alias("query_id"), "rank", "vec_id", "score")


def _best(met: DataFrame, top: int) -> DataFrame:
    one = met.groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    return one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select("q", "vec_id", "score")


def _answers(qids: np.ndarray, q: np.ndarray, ids: list[list[int]], x: np.ndarray, top: int) -> pa.RecordBatch:
    out: tuple[list, list, list] = ([], [], [])
    least = np.array([i[0] for i in ids])
    for i, near, far in _exact(q, x, least, top):
        pairs = sorted((d, v) for n, d in zip(near.tolist(), far.tolist(), strict=True) for v in ids[n])[:top]
        out[0].extend([int(qids[i])] * len(pairs))
        out[1].extend(v for _, v in pairs)
        out[2].extend(d for d, _ in pairs)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["q", "vec_id", "score"])


def _meeting(top: int):
    """Queries of each run of one (bucket, piece, slice) against its entries, which come first and are bounded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, x = None, [], [], None
        held, n = [], 0
        for batch in batches:
            place = bucket, piece, slice_, asks = [batch.column(c).to_numpy() for c in ("bucket", "piece", "slice", "asks")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in place], axis=0)) + 1 if len(bucket) else []
            for s, e in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if s == e:
                    continue
                if at != (bucket[s], piece[s], slice_[s]):
                    at, ids, rows, x = (bucket[s], piece[s], slice_[s]), [], [], None
                part = batch.slice(s, e - s)
                if not asks[s]:
                    ids.extend(part.column("ids").to_pylist())
                    rows.extend(m for _, m in _matrix(part.column("v")))  # one length a bucket: it is in the key
                elif ids:
                    x = np.concatenate(rows) if x is None else x
                    qids = np.array([i[0] for i in part.column("ids").to_pylist()])
                    for picked, q in _matrix(part.column("v")):
                        held.append(_answers(qids[picked], q, ids, x, top))
                        n += held[-1].num_rows
            if n > ANSWERS:
                held = [_cut_down(held, top)]
                n = held[0].num_rows
                if 2 * n > ANSWERS:  # too many queries to hold
                    yield held.pop()
                    n = 0
        if held:
            yield _cut_down(held, top)

    return run


def _cut_down(held: list[pa.RecordBatch], top: int) -> pa.RecordBatch:
    """The ``top`` nearest of each query's answers, each of them once."""
    q, v, d = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("q", "vec_id", "score"))
    order = np.lexsort((d, v, q))
    q, v, d = q[order], v[order], d[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, d = q[first], v[first], d[first]
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < top
    return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (q, v, d)], ["q", "vec_id", "score"])


def exact(pool: DataFrame, qids: np.ndarray, vectors: pa.Array, top: int = TOP) -> DataFrame:
    """``(q, vec_id, score)``: the nearest in each batch of ``pool (v, ids)``, for a bounded set of queries."""
    asked = [(picked, q) for picked, q in _matrix(vectors)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for rows, x in _matrix(batch.column("v")):
                for picked, q in asked:
                    if q.shape[1] == x.shape[1]:
                        yield _answers(qids[picked], q, [ids[r] for r in rows.tolist()], x, top)

    return pool.mapInArrow(run, "q long, vec_id long, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
