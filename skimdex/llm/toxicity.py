"""Toxicity by a classifier chain: categories in order, each a linear model that also sees the earlier ones.

A text's features are its distinct lower-cased words and their prefixes of 4 to 6 bytes, as 64-bit hashes.
Each link of the chain is a logistic regression on the presence of the most telling features and on the log
odds of all earlier categories. While fitting, those odds are out-of-fold predictions: each fold's come from a
model that never saw it, as they will for new texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, batched, chunks, flat, hashed_sample, mixed, prefix_hashes, span_hashes, written

#: Most labelled rows that a chain is fitted on, in the order of a hash of their ids; features it keeps; folds.
SAMPLE_ROWS, FEATURES, FOLDS = 6000, 512, 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word and word prefix of all texts, repeats included."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = _LOWER[data]
    inside = _LETTER[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts], ends[cuts - 1] = inside[cuts], inside[cuts - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    prefix = prefix_hashes(BYTE_VALUE[data])
    hashes, rows = [span_hashes(prefix, start, end)], [row]
    for n in (4, 5, 6):
        long = end - start > n
        hashes.append(span_hashes(prefix, start[long], start[long] + n) ^ np.uint64(0x5851F42D4C957F2D * n & (1 << 64) - 1))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _logistic(row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, features: int, strength: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weights and bias of an L2 logistic regression, by accelerated gradient descent.

    The input is 1 at each (row, col), with the dense columns ``extra`` and a constant 1 beside it.
    """
    extra = np.concatenate((extra, np.ones((len(y), 1))), 1)
    # Steps are taken in units of each weight's own curvature, so that rare and common features learn alike.
    scale = np.sqrt(np.concatenate((np.bincount(col, minlength=features), (extra**2).sum(0))) / 4 + strength)
    ridge = np.append(np.full(len(scale) - 1, strength), 0.0) / scale**2
    w = np.zeros(len(scale))
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) * scale[-1]

    def times(v: np.ndarray) -> np.ndarray:
        v = v / scale
        return np.bincount(row, v[col], len(y)) + extra @ v[features:]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(col, r[row], features), extra.T @ r)) / scale

    probe, norm = np.random.default_rng(3).normal(size=len(w)), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        probe = back(times(probe)) / 4 + ridge * probe
        probe /= (norm := float(np.linalg.norm(probe)) or 1.0)
    rate, ahead = 1 / (1.2 * norm), w.copy()
    for step in range(1, steps + 1):
        grad = back(_sigmoid(times(ahead)) - y) + ridge * ahead
        old, w = w, ahead - rate * grad
        ahead = w + step / (step + 3) * (w - old)
    return w / scale


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))[:, None]


@dataclass
class Chain:
    """Categories in order; each one's weights (features, then earlier odds, then bias) and threshold."""

    categories: list[str]
    hashes: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]

    def table(self) -> np.ndarray:
        if (known := getattr(self, "_table", None)) is None:
            known = np.full(1 << 20, -1, np.int16)
            known[(self.hashes >> np.uint64(44)).astype(np.int64)] = np.arange(len(self.hashes))
            self._table = known
        return known

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each category (columns) for each text."""
        rows = len(offsets) - 1
        hashes, row = features(data, offsets)
        slot = self.table()[(hashes >> np.uint64(44)).astype(np.int64)]
        found = np.flatnonzero(slot >= 0)
        found = found[self.hashes[slot[found]] == hashes[found]]
        pairs = np.unique(row[found] * len(self.hashes) + slot[found]) if len(found) else np.empty(0, np.int64)
        row, slot = pairs // max(1, len(self.hashes)), pairs % max(1, len(self.hashes))
        out = np.zeros((rows, len(self.categories)))
        for c, w in enumerate(self.weights):
            z = np.bincount(row, w[slot], rows) + w[-1]
            for earlier in range(c):
                z += w[len(self.hashes) + earlier] * _odds(out[:, earlier])[:, 0]
            out[:, c] = _sigmoid(z)
        return out


def selected(table: DataFrame, names: list[str], most: int = FEATURES) -> np.ndarray:
    """Features whose presence says most of some category (chi-square), one for each slot of the chain's table.

    ``table (f array<long>, a 0/1 column for each of ``names``)`` has each text's features once. They are counted on
    the executors; the driver gets the best 2 * ``most``.
    """
    sums = table.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).first()
    counted = table.select(F.explode("f").alias("f"), *names).groupBy("f").agg(F.count("*").cast("double").alias("df"), *(F.sum(c).alias(c) for c in names))
    score = F.lit(0.0)
    for c in names:
        base = (sums[c] or 0.0) / max(sums.n, 1)
        against = F.col("df") * max(base * (1 - base), 1e-9) * F.greatest(1 - F.col("df") / max(sums.n, 1), F.lit(1e-9))
        score = F.greatest(score, (F.col(c) - F.col("df") * base) ** 2 / against)
    best = counted.where("df >= 4").select("f", score.alias("score")).where("score > 3.84")
    unsigned = F.col("f").bitwiseXOR(F.lit(-(1 << 63)))
    keys = best.orderBy(F.desc("score"), unsigned).limit(2 * most).select("f").toArrow().column("f").to_numpy().view(np.uint64)
    _, first = np.unique(keys >> np.uint64(44), return_index=True)
    return np.sort(keys[np.sort(first)][:most])


def fit_chain(chosen: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: list[str]) -> Chain:
    """``y``: 0 or 1, a column for each category; text row[i] has feature chosen[col[i]].

    Each threshold has the best F1 on out-of-fold predictions.
    """
    odds = np.zeros((len(y), 0))
    weights, thresholds = [], []
    for c in range(y.shape[1]):
        weights.append(_logistic(row, col, odds, y[:, c], len(chosen)))
        p = np.zeros(len(y))
        for f in np.unique(fold):
            at = np.flatnonzero(fold != f) if (fold != f).any() else np.arange(len(y))
            inside = np.isin(row, at)
            w = _logistic(np.searchsorted(at, row[inside]), col[inside], odds[at], y[at, c], len(chosen))
            z = np.bincount(row, w[col], len(y)) + odds @ w[len(chosen) : -1] + w[-1]
            p[fold == f] = _sigmoid(z)[fold == f]
        thresholds.append(_threshold(p, y[:, c]))
        odds = np.concatenate((odds, _odds(p)), 1)
    return Chain(categories, chosen, weights, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p)
    good = np.cumsum(y[order])
    if not len(y) or not y.sum():
        return 0.5
    best = int(np.argmax(2 * good / (np.arange(1, len(y) + 1) + y.sum())))
    low = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float((p[order[best]] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id") -> Chain:
    """A chain fitted on at most ``rows`` labelled rows; rows with a null id or category are not learned from.

    ``categories``: in the chain's order, a 0/1 column of ``labels`` each. With no usable rows the chain gives
    even odds, and nothing reaches its thresholds.
    """
    names = list(categories)
    known = labels.select(F.col(key).alias("k"), *(c.cast("double").alias(n) for n, c in categories.items())).dropna()
    sample = hashed_sample(known, rows, "k", *names)  # bounded, so it can be broadcast

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            hashes, row = features(*flat(batch.column("t")))
            first = np.unique(hashes ^ mixed(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
            first = first[np.argsort(row[first], kind="stable")]
            cuts = np.searchsorted(row[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[first].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(batch.column(n) for n in names), lists], ["k", *names, "f"])

    kind = docs.schema[key].dataType.simpleString()
    joined = batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(sample), "k").select("k", "t", *names)
    table = written(joined.mapInArrow(run, f"k {kind}, {', '.join(f'{n} double' for n in names)}, f array<long>"), "features")
    chosen = selected(table, names)
    own = F.array_intersect("f", F.array(*(F.lit(int(x)) for x in chosen.view(np.int64))).cast("array<long>"))
    got = table.select("k", *names, own.alias("f")).toArrow().combine_chunks()  # FEATURES a row at most
    if not got.num_rows:
        return Chain(names, np.empty(0, np.uint64), [np.zeros(1 + c) for c in range(len(names))], [1.1] * len(names))
    got = got.sort_by([("k", "ascending"), *((n, "ascending") for n in names)])
    lists = got.column("f").combine_chunks()
    row = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    col = np.searchsorted(chosen, lists.flatten().to_numpy().view(np.uint64))
    y = np.stack([got.column(n).to_numpy() for n in names], 1)
    return fit_chain(chosen, row, col, y, np.arange(got.num_rows) % FOLDS, names)


def score(docs: DataFrame, chain: Chain, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, and for each category ``<name>_score`` (0 to 1) and ``<name>`` (score over its threshold).

    One row for each row of ``docs``, repeated rows included; null and empty texts have no features and get the
    chain's score for that. Whole texts are read; other columns, whatever their names, aren't looked at.
    """
    out = [f"{n}_score" for n in chain.categories]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            p = chain.predict(*flat(batch.column("t")))
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(p[:, c]) for c in range(len(out)))], ["k", *out])

    kind = docs.schema[key].dataType.simpleString()
    got = batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, {', '.join(f'{n} double' for n in out)}")
    return got.select(F.col("k").alias(key), *out, *((F.col(f"{n}_score") > F.lit(t)).alias(n) for n, t in zip(chain.categories, chain.thresholds, strict=True)))


def op10(spark, sf_dir: str) -> DataFrame:
    """A text's low quality is told first, its toxicity with that in view."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}))
