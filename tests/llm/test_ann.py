"""Nearest neighbours against brute force: recall, ties, lengths, and how the settings follow the table's size."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimdex.llm import ann


def brute(rows: list[tuple[int, np.ndarray]], asked: set[int], top: int = 10) -> dict[int, list[tuple[float, int]]]:
    out = {}
    for q, at in rows:
        if q in asked:
            out[q] = sorted((float(np.sqrt(((v - at) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(at))[:top]
    return out


def found(df, queries) -> dict[int, list[tuple[float, int]]]:
    out = defaultdict(list)
    for r in ann.search(df, queries).orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("hot", [0, 1000])
def test_recall_on_the_embeddings(spark, hot):
    """Also with a vector that is a third of the table."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    first = vectors.where("embedding is not null").orderBy("vec_id").limit(1).select("embedding")
    vectors = vectors.union(spark.range(10_001, 10_001 + hot).crossJoin(first))
    rows = [(r.k, np.array(r.v, float)) for r in ann.usable(vectors, "embedding", "vec_id").collect()]
    queries = vectors.where(F.col("vec_id") % 100 == 0)
    want, got = brute(rows, {i for i, _ in rows if i % 100 == 0}), found(vectors, queries)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_ties_and_lengths(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=6)) for i in range(40)] + [(100 + i, np.ones(6)) for i in range(30)] + [(200 + i, r.normal(size=3)) for i in range(5)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = found(df, df.where("vec_id in (110, 200)"))
    assert [i for _, i in got[110]] == list(range(100, 110)) and {s for s, _ in got[110]} == {0.0}
    assert got[200] == brute(rows, {200})[200]


def clusters(n: int, rows_each: int = 50) -> np.ndarray:
    r = np.random.default_rng(7)
    centres = r.normal(size=(n // rows_each, 64))
    return centres[r.integers(0, len(centres), n)] + 0.15 * r.normal(size=(n, 64))


def nearest(asked: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.argsort((asked**2).sum(1)[:, None] + (x**2).sum(1) - 2 * asked @ x.T, 1)[:, 1:11]


def test_few_candidates_in_a_table_with_structure():
    x = clusters(100_000)
    index = ann.fit(x[:2000], x[nearest(x[:200], x)], len(x))
    asked = x[5000:5050]
    held, seen = index.buckets(x), np.zeros((50, len(x)), bool)
    for t in range(ann.TABLES):
        for i, keys in enumerate(index.visited(asked, t)):
            seen[i] |= np.isin(held[:, t], keys)
    assert np.take_along_axis(seen, nearest(asked, x), 1).mean() >= 0.9 and seen.mean() < 0.05


def test_more_rows_make_finer_buckets():
    x = clusters(20_000)
    near = x[nearest(x[:200], x)]
    small, large = (ann.fit(x[:2000], near, n) for n in (10_000, 10**10))
    assert (large.hashes, large.probes) > (small.hashes, small.probes)


@pytest.mark.parametrize("hashes", ann.HASHES)
def test_probes_come_in_the_order_of_their_scores(hashes):
    x = np.random.default_rng(2).normal(size=(3, 16))
    index = ann.Index(2.0, 40, hashes)
    for t in range(ann.TABLES):
        keys, scores, every = index.visited(x, t), index.scores(index.cells(x, t)), ann.steps(hashes)[0]
        own = np.floor(index.cells(x, t))
        for i in range(3):
            order = np.argsort(scores[i], kind="stable")[:40]
            assert set(keys[i].tolist()) == set(index.key(own[i] + every[order], t, 16).tolist())
            assert keys[i, 0] == index.buckets(x)[i, t] and len(set(keys[i].tolist())) == 40


def test_answers_are_cut_down_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ann, "ANSWERS", 5)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4)) for i in range(300)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got, want = found(df, df.where("vec_id < 20")), brute(rows, set(range(20)))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values()) and hits >= 180


def test_large_buckets_in_pieces_and_slices(spark, monkeypatch):
    """Near-equal vectors that share their buckets, each of them asking, one of them many times."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", 16)
    r = np.random.default_rng(6)
    rows = [(i, np.ones(5) + 1e-3 * r.normal(size=5)) for i in range(200)] + [(500 + i, 3 * r.normal(size=5)) for i in range(100)] + [(900 + i, np.ones(5)) for i in range(50)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got, want = found(df, df), brute(rows, {i for i, _ in rows})
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values()) and hits >= 0.9 * 10 * len(want)
    assert all(got[900 + i] == want[900 + i] for i in range(50))


def test_an_id_in_several_places(spark):
    rows = [(5, [0.0, 1.0]), (7, [0.0, 1.0]), (5, [9.0, 0.5]), (8, [9.0, 1.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {q: dict((i, round(s, 3)) for s, i in a) for q, a in found(df, df.where("vec_id in (5, 7)")).items()}
    assert got == {5: {7: 0.0, 8: 0.5, 9: 1.0}, 7: {5: 0.0, 9: 1.0, 8: 9.0}}
