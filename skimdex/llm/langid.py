"""Language identification by a byte convolutional network, trained and applied in numpy.

A window of ``WINDOW`` bytes is embedded, filters of several widths slide over it, each filter's maximum over
the window feeds a softmax over the languages of the training rows. A text is cut into windows end to end (the
last one padded), and its answer is the softmax of their mean scores, so every byte of every text counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, chunks, flat, hashed_sample

WINDOW, DIM, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 16
_SPAN = max(WIDTHS)
#: Most labelled rows that a model is fitted on, taken in the order of a hash of their ids.
SAMPLE_ROWS = 3000
#: Windows that training takes of one row at most, and windows that prediction holds at once.
TRAIN_WINDOWS, BLOCK = 4, 512


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts as bytes+1 (0: padding), the text each is of, and its length."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, data[np.where(inside, at, 0)].astype(np.int16) + 1, 0) if len(row) else np.zeros((0, WINDOW), np.int16), row, length


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (257, DIM)).astype(np.float32)
        self.embed[0] = 0
        # Filters of all widths side by side; a narrow filter's outer rows stay zero.
        self.mask = np.concatenate([np.repeat((np.arange(_SPAN * DIM) < w * DIM)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.dense = rng.normal(0, 0.1, (self.mask.shape[1], len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)

    def _pooled(self, batch: np.ndarray):
        x = self.embed[batch]
        patches = np.lib.stride_tricks.sliding_window_view(x.reshape(len(batch), -1), _SPAN * DIM, 1)[:, ::DIM]
        conv = patches.reshape(-1, _SPAN * DIM) @ self.filters
        conv = conv.reshape(len(batch), -1, conv.shape[1])
        return patches, conv.max(1) + self.bias, conv

    def logits(self, batch: np.ndarray) -> np.ndarray:
        return np.maximum(self._pooled(batch)[1], 0) @ self.dense + self.offset

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
        """Adam on the mean cross-entropy of shuffled mini-batches."""
        rng, names = np.random.default_rng(seed), ("embed", "filters", "bias", "dense", "offset")
        first, second, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), size):
                batch, want = x[order[at : at + size]], y[order[at : at + size]]
                patches, pooled, conv = self._pooled(batch)
                hidden = np.maximum(pooled, 0)
                grad = softmax(hidden @ self.dense + self.offset)
                grad[np.arange(len(want)), want] -= 1
                grad /= len(want)
                back = (grad @ self.dense.T) * (pooled > 0)
                best = conv.argmax(1)
                taken = patches[np.arange(len(batch))[:, None], best]  # batch, filter, patch
                to_filters = np.einsum("bf,bfp->pf", back, taken) * self.mask
                to_patch = back[:, :, None] * self.filters.T
                to_embed = np.zeros_like(self.embed)
                for j in range(_SPAN):
                    np.add.at(to_embed, batch[np.arange(len(batch))[:, None], best + j], to_patch[:, :, j * DIM : (j + 1) * DIM])
                to_embed[0] = 0
                t += 1
                for name, g in zip(names, (to_embed, to_filters, back.sum(0), hidden.T @ grad, grad.sum(0)), strict=True):
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    setattr(self, name, (getattr(self, name) - rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))
        return self

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number and probability for each text; a text without bytes gets class 0."""
        total = np.zeros((len(offsets) - 1, len(self.classes)))
        batch, row, length = windows(data, offsets)
        for at in range(0, len(batch), BLOCK):
            scores = self.logits(batch[at : at + BLOCK]) * length[at : at + BLOCK, None]
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(row[at : at + BLOCK], scores[:, c], len(total))
        p = softmax(total / np.maximum(np.diff(offsets), 1)[:, None])
        return p.argmax(1), p.max(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2. A row without an id is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _training_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(k, l, w)``: of each text at most ``TRAIN_WINDOWS`` windows, spread over the whole of it."""
    for batch in chunks(batches, "t"):
        data, offsets = flat(batch.column("t"))
        count = -(-np.diff(offsets) // WINDOW)
        step = np.maximum(1, count // TRAIN_WINDOWS)
        raw, out = data.tobytes(), []
        for at, end, n, by in zip(offsets[:-1].tolist(), offsets[1:].tolist(), count.tolist(), step.tolist(), strict=True):
            out.append([raw[at + i * WINDOW : min(end, at + (i + 1) * WINDOW)] for i in range(0, n, by)[:TRAIN_WINDOWS]])
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("l"), pa.array(out, pa.list_(pa.binary()))], ["k", "l", "w"])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", label: str = "lang", key: str = "doc_id") -> ByteNet | None:
    """A network fitted on at most ``rows`` of the rows that aren't held out and have a label; those without text say nothing.

    The driver gets ``TRAIN_WINDOWS`` windows a row at most, whatever the texts' lengths. None if no row is left.
    """
    known = batched(docs).where(~held_out(key) & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).cast("string").alias("t"))
    shape = f"k {docs.schema[key].dataType.simpleString()}, l {docs.schema[label].dataType.simpleString()}, w array<binary>"
    sample = hashed_sample(known, rows, "k", "l", cut=lambda df: df.mapInArrow(_training_windows, shape)).where(F.size("w") > 0).select("l", "w").toArrow().combine_chunks()
    if not sample.num_rows:
        return None
    labels, cut = sample.column("l").to_pylist(), sample.column("w").combine_chunks()
    classes = sorted(set(labels))
    y = np.repeat(np.array([classes.index(x) for x in labels]), np.diff(cut.offsets.to_numpy()))
    return ByteNet(classes).fit(windows(*flat(cut.flatten()))[0], y)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a character of one of Unicode's letter categories (L*)."""
    count = np.concatenate(([0], np.cumsum(_LETTER[data])))
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = regex.search(r"\p{L}", data[offsets[i] : offsets[i + 1]].tobytes().decode()) is not None
    return out


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row ``(key, held_out, lang_pred, score)`` for each row of ``docs``, repeated rows included.

    ``und`` with score 0 where the text is null, empty or has no letter, and everywhere if ``net`` is None.
    Only the text is looked at; other columns, whatever their names, aren't.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            data, offsets = flat(batch.column("t"))
            found = has_letter(data, offsets) if net else np.zeros(batch.num_rows, bool)
            best, p = net.predict(data, offsets) if net else (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows))
            names = [net.classes[b] if ok else "und" for b, ok in zip(best.tolist(), found.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(names, pa.string()), pa.array(np.where(found, p, 0.0))], ["k", "h", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = batched(docs).select(F.col(key).alias("k"), held_out(key).alias("h"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, h boolean, lang_pred string, score double")
    return out.select(F.col("k").alias(key), F.col("h").alias("held_out"), "lang_pred", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
