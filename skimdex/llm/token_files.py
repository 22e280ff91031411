"""Token ids of whole documents in Simple-8b files, written in ascending order of doc_id and read back.

A file set is a folder of Parquet files that Spark's own writer commits, so that a lost executor or a second
attempt leaves no half file and any store that Spark writes to will do. Each row is a pack of documents: their
ids and token counts, and one Simple-8b stream (see ``simple8b``) of all their tokens. Packs of a shard are in
order, shards cover ascending ranges of doc_id, and each pack has the number of its shard's tokens before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import simple8b
from .common import SPACE, batched, chunks, flat, parts, scratch
from .pieces import PieceMemory


#: Bytes of text in a pack at most (a longer text is a pack of its own).
PACK_BYTES = 2 << 20


def _visible(byte: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether ``byte`` ends a visible ASCII character or a letter of two bytes (``before``: the byte before it).

    Longer characters and U+0080 to U+00BF may be white space.
    """
    return (byte > 0x20) & (byte < 0x7F) | (byte >= 0x80) & (byte < 0xC0) & (before >= 0xC3) & (before < 0xE0)


class Encoder(PieceMemory):
    """``tokenizers`` encoding of many texts, asking the library once for each distinct piece of them.

    A text is cut where white space follows a visible character. A byte-level BPE splits there before it
    merges, whatever stands on either side, and looks ahead no further than a run of white space, so the ids
    of the pieces one after the other are the ids of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes of text that each id stands for: a byte-level token has a character for each.
        known = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        known |= {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = np.zeros(max(known) + 1, np.int64)
        self.bytes[list(known)] = list(known.values())
        super().__init__()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        before = np.concatenate((data[:1], data[:-2]))
        return _visible(data[:-1], before) & SPACE[data[1:]]

    def tokenize(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Many pieces in one text cost the library less than many texts; a cut before white space keeps them apart.
        apart = SPACE[data[start]]
        apart[1:] &= _visible(data[end - 1], data[np.maximum(end - 2, 0)])[:-1]
        first = np.flatnonzero(~apart | (np.arange(len(start)) % 64 == 0))
        raw, edges = data.tobytes(), [*start[first].tolist(), len(data)]
        texts = [raw[s:e].decode() for s, e in zip(edges[:-1], edges[1:], strict=True)]
        found = []
        for i in range(0, len(texts), 64):
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids))))
        ids = np.concatenate(found)
        # Where the bytes that ids stand for run on to the end of each piece, they tell whose an id is.
        reached = np.concatenate(([0], np.cumsum(self.bytes[ids])))
        upto = np.searchsorted(reached, end, side="right") - 1
        if reached[-1] == len(data) and (reached[upto] == end).all():
            return np.diff(upto, prepend=0), ids
        return self._by_offsets(texts, np.searchsorted(start, edges[:-1]), data, start, end)

    def _by_offsets(self, texts: list[str], first: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``tokenize`` by the library's offsets, which cost more, for a tokenizer that changes a text's bytes."""
        begun = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
        size, found = np.zeros(len(start), np.int64), []
        for i in range(0, len(texts), 64):
            encoded = self.tokenizer.encode_batch(texts[i : i + 64], add_special_tokens=False)
            many = np.array([len(x.ids) for x in encoded], np.int64)
            found.extend(np.array(x.ids, np.uint32) for x in encoded)
            ends = np.array([e for x in encoded for _, e in x.offsets], np.int64)
            at = np.searchsorted(begun[start], ends + np.repeat(begun[start[first[i : i + 64]]], many)) - 1
            size += np.bincount(at, minlength=len(size))
        return size, np.concatenate(found)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of the tokenizer file; tasks that share a worker share what it has learned."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encodes every text and writes packs to the new folder ``path``.

    Every row is a document: a null or empty text has only the end id, repeated rows are written repeatedly
    (in no stated order among equal keys), null keys come first. An empty table writes an empty file set.
    Other columns of ``docs`` are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, done = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "t", PACK_BYTES):
            ids, sizes = encode(*flat(batch.column("t")))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            sizes = sizes + 1
            packed = simple8b.encode(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([done], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([batch.column("k").to_pylist()], pa.list_(batch.column("k").type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                ["shard", "before", "n_ids", "keys", "sizes", "payload"],
            )
            done += len(ids)

    kind = docs.schema[key].dataType.simpleString()
    ranged = batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).repartitionByRange(parts(docs.sparkSession), "k").sortWithinPartitions("k")
    ranged.mapInArrow(run, f"shard int, before long, n_ids long, keys array<{kind}>, sizes array<long>, payload binary").write.option("compression", "none").parquet(path)


def packs(spark: SparkSession, path: str) -> DataFrame:
    """The packs of a file set, each with ``start``: the number of tokens before it in all shards."""
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a shard
    bases = totals.select(F.col("shard").alias("s"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(bases), F.col("shard") == F.col("s")).select((F.col("base") + F.col("before")).alias("start"), "n_ids", "keys", "sizes", "payload")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, ids array<long>)`` of each document of a file set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, sizes, ids in _decoded(batches):
            cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int64)))], ["k", "start", "ids"])

    found = packs(spark, path)
    kind = found.schema["keys"].dataType.elementType.simpleString()
    return found.mapInArrow(run, f"k {kind}, start long, ids array<long>").withColumnRenamed("k", key)


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = np.array(batch.column("sizes")[i].values, np.int64)
            ids = simple8b.decode(batch.column("payload")[i].as_py())
            yield batch.column("keys")[i].values, batch.column("start")[i].as_py() + np.cumsum(sizes) - sizes, sizes, ids


def digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of each document, from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, starts, sizes, ids in _decoded(batches):
            raw = memoryview(ids.astype("<u4").tobytes())
            cuts = np.concatenate(([0], np.cumsum(sizes) * 4)).tolist()
            sums = [zlib.crc32(raw[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())], ["k", "start", "n_tokens", "ids_crc32"])

    found = packs(spark, path)
    kind = found.schema["keys"].dataType.elementType.simpleString()
    return found.mapInArrow(run, f"k {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, str(public_tokenizers.path("byte_bpe_50k.json")))
    return digests(spark, path)
