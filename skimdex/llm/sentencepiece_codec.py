"""SentencePiece encoding by streaming Viterbi, and decoding.

The best-scoring split of a text into the vocabulary's pieces is found character by character. A piece is at
most ``longest`` characters, so only that many best scores are open at a time: the window. When the paths back
from all open positions meet in one boundary, nothing to come can change what lies before it; its ids are
committed and its memory freed. A text streams through in memory bounded by the window and the distance
between such boundaries, whatever its length.

The supplied vocabulary is of the BPE kind; here its scores rank paths as those of a unigram model do. The ids
are therefore not its BPE merges but those of the best path (the tests compare them with a search over all
splits). A character without a piece costs 10 less than the least score and becomes its UTF-8 bytes.

A stream that has committed at a boundary is as it was at the start: what it does next depends only on what
follows. No piece has a visible character before a space mark, so every stream commits there, and what lies
between two such places is streamed once and remembered (see ``pieces``, which compares bytes); a vocabulary
with pieces across words has no such places, and its texts are streamed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, chunks, flat
from .pieces import PieceMemory

MARK = "\u2581"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes_at = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        usual = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in usual}
        self.longest = max(map(len, self.pieces))
        self.unknown_score = min(s for _, s in self.pieces.values()) - 10
        self.unknown = model.unk_id()
        self.raw = [b""] * len(ids)
        for piece, (i, _) in self.pieces.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes_at.items():
            self.raw[i] = bytes([value])
        self.heads = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        #: Whether a piece can run from a visible character into a space mark.
        self.spans_words = any(MARK in p.lstrip(MARK) for p in self.pieces)


class StreamingViterbi:
    """``feed`` takes text in portions and returns the ids that are certain; ``close`` returns the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # from the last committed boundary on
        self.best, self.back, self.ids = [0.0], [0], [-1]  # by position in it
        self.done = 0  # positions whose outgoing pieces have been tried

    def _scan(self, last: int) -> None:
        v, text, best, back, ids = self.v, self.text, self.best, self.back, self.ids
        size = len(text)
        best.extend([float("-inf")] * (size + 1 - len(best)))
        back.extend([-1] * (size + 1 - len(back)))
        ids.extend([-1] * (size + 1 - len(ids)))
        heads, pieces, longest = v.heads, v.pieces.get, v.longest
        for at in range(self.done, last):
            here, single = best[at], False
            for end in range(at + 1, min(size, at + longest) + 1):
                piece = text[at:end]
                if piece not in heads:
                    break
                if (known := pieces(piece)) is not None:
                    single |= end == at + 1
                    score = here + known[1]
                    if score > best[end]:
                        best[end], back[end], ids[end] = score, at, known[0]
            if not single and here + v.unknown_score > best[at + 1]:
                best[at + 1], back[at + 1], ids[at + 1] = here + v.unknown_score, at, -1
        self.done = last

    def _path(self, end: int) -> list[int]:
        parts: list[list[int]] = []
        while end > 0:
            start = self.back[end]
            if self.ids[end] >= 0:
                parts.append([self.ids[end]])
            else:
                parts.append([self.v.bytes_at.get(b, self.v.unknown) for b in self.text[start:end].encode()])
            end = start
        return [x for part in reversed(parts) for x in part]

    def _boundary(self) -> int:
        """Where the paths back from every open position meet."""
        open_at = {p for p in range(self.done, len(self.best)) if self.back[p] >= 0 or p == 0}
        open_at.add(self.done)
        while len(open_at) > 1:
            furthest = max(open_at)
            open_at.remove(furthest)
            open_at.add(self.back[furthest])
        return open_at.pop()

    def feed(self, text: str) -> list[int]:
        self.text += text
        self._scan(max(self.done, len(self.text) - self.v.longest + 1))  # what ends beyond isn't all there yet
        cut = self._boundary()
        if not cut:
            return []
        out = self._path(cut)
        self.text, self.done = self.text[cut:], self.done - cut
        base = self.best[cut]
        self.best = [b - base for b in self.best[cut:]]
        self.back = [max(-1, b - cut) for b in self.back[cut:]]
        self.ids = self.ids[cut:]
        return out

    def close(self) -> list[int]:
        self._scan(len(self.text))
        out = self._path(len(self.text))
        self.__init__(self.v)
        return out


def viterbi(vocabulary: Vocabulary, text: str, portion: int | None = None) -> list[int]:
    """Ids of marked text (spaces already replaced), streamed in portions of the longest piece's length.

    Nothing can be committed before more than one window is there, so a shorter text is closed at once.
    """
    stream, out, portion = StreamingViterbi(vocabulary), [], portion or vocabulary.longest
    if len(text) <= vocabulary.longest:
        stream.text = text
        return stream.close()
    for at in range(0, len(text), portion):
        out += stream.feed(text[at : at + portion])
    return out + stream.close()


class Codec(PieceMemory):
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        super().__init__()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        if self.v.spans_words:
            return np.zeros(len(data) - 1, bool)
        return (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)  # 81: perhaps a mark's last byte

    def tokenize(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [viterbi(self.v, (MARK if head else "") + raw[s:e].decode().replace(" ", MARK)) for s, e, head in zip(start.tolist(), end.tolist(), heads.tolist(), strict=True)]
        return np.array([len(x) for x in ids], np.int64), np.array([y for x in ids for y in x], np.uint32)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes end to end, without the space that encoding put before the first."""
        raw = self.v.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec of the model file; tasks that share a worker share what it has learned."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, ids array<int>)`` for each row of ``docs``, repeated rows included.

    A null or empty text has no ids. Whole texts are encoded; other columns, whatever their names, aren't
    looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            ids, sizes = codec(model)(*flat(batch.column("t")))
            cuts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32)))], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, model: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(key, text)`` for each row of ``encoded``; null ids give a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else codec(model).decode(x) for x in batch.column("i").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(texts, pa.string())], ["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return batched(encoded).select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def digests(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_crc32, same)``; ``same``: decoding the ids gives the text back.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers. A null text counts as empty. A
    literal U+2581 decodes as a space, as in the library, and so does not come back.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "t"):
            own = codec(model)
            data, offsets = flat(batch.column("t"))
            ids, sizes = own(data, offsets)
            cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
            raw, listed, texts, at = memoryview(ids.astype("<u4").tobytes()), ids.tolist(), data.tobytes(), offsets.tolist()
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            same = [own.decode(listed[s:e]) == texts[a:b].decode() for s, e, a, b in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(sizes), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())], ["k", "n_tokens", "ids_crc32", "same"])

    kind = docs.schema[key].dataType.simpleString()
    return batched(docs).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_crc32 long, same boolean").withColumnRenamed("k", key)


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op6(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
