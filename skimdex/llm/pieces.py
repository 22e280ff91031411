"""Ids of many texts from the ids of their distinct pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import BYTE_VALUE, prefix_hashes, same_bytes, span_hashes

#: Bytes of the arrays in which a Python worker remembers pieces and their ids; beyond it the memory starts anew.
MEMORY = 48 << 20
_HEAD = np.uint64(0x632BE59BD9B4E019)


def _distinct(data: np.ndarray, start: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each of the pieces that ``data`` is cut into at ``start``, and a piece of each number.

    Two have the same number just if their bytes are equal (Arrow compares them) and both or neither are heads.
    """
    edges = pa.py_buffer(np.append(start, len(data)))
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = 2 * every.indices.to_numpy().astype(np.int64) + head
    first = np.full(2 * len(every.dictionary), -1)
    first[which] = np.arange(len(which))
    used = first >= 0
    return (np.cumsum(used) - 1)[which], first[used]


def _spelt(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ``length`` bytes of ``data`` from each ``start`` on, end to end."""
    ends = np.cumsum(length)
    return data[np.arange(int(ends[-1])) + np.repeat(start - (ends - length), length)]


class PieceMemory:
    """Encodes texts by pieces, each distinct one once.

    A block's distinct pieces are looked up by 64-bit hashes, and what is found is compared byte by byte: a piece
    whose hash is that of another one is encoded by itself. A subclass says where a text may be cut so that its pieces' ids, one
    after the other, are its own (``cuts``), and gives ids of pieces (``tokenize``), which learns of each piece
    whether it begins a text.
    """

    def __init__(self) -> None:
        self.clear()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte but the first, whether a piece may begin there."""
        raise NotImplementedError

    def tokenize(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece data[start:end] has, and all the ids; the pieces lie end to end."""
        raise NotImplementedError

    def clear(self) -> None:
        #: In the order of ``keys``: where a piece's ids and its bytes begin, and how many there are.
        self.keys = np.empty(0, np.uint64)
        self.at, self.size, self.spelt, self.length = (np.empty(0, np.int32) for _ in range(4))
        self.pool, self.raw = np.empty(0, np.uint32), np.zeros(8, np.uint8)  # eight zeros follow the bytes

    @property
    def held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.at, self.size, self.spelt, self.length, self.pool, self.raw))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many of them each text has."""
        rows = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(rows, np.int64)
        begins, head = np.zeros(len(data), bool), np.zeros(len(data), bool)
        begins[1:] = self.cuts(data)
        head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        start = np.flatnonzero(begins | head)
        row = np.searchsorted(offsets, start, side="right") - 1
        which, first = _distinct(data, start, head[start])
        head = head[start[first]]
        # From here on the distinct pieces only, their bytes end to end.
        length = np.diff(start, append=len(data))[first]
        end = np.cumsum(length)
        data, start = _spelt(data, start[first], length), end - length
        hashes = span_hashes(prefix_hashes(BYTE_VALUE[data]), start, end)
        hashes[head] ^= _HEAD
        distinct, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        if self.held > MEMORY:
            self.clear()
        spot = np.searchsorted(self.keys, distinct)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == distinct[known]
        if not known.all():
            new = first[~known]
            self._learn(data, distinct[~known], start[new], length[new], head[new])
            spot = np.searchsorted(self.keys, distinct)
        # What was found is held against the bytes; a piece that only shares a hash gets ids of its own.
        spot = spot[same]
        own = self.length[spot] == length
        own[own] = same_bytes(data, start[own], self.raw, self.spelt[spot[own]], length[own])
        at, size, pool = self.at[spot].astype(np.int64), self.size[spot].astype(np.int64), self.pool
        if not own.all():
            odd = np.flatnonzero(~own)
            size[odd], ids = self._tokenized(data, start[odd], length[odd], head[odd])[1:]
            at[odd] = len(self.pool) + np.cumsum(size[odd]) - size[odd]
            pool = np.concatenate((self.pool, ids))
        at, size = at[which], size[which]
        ends = np.cumsum(size)
        ids = pool[np.arange(int(ends[-1])) + np.repeat(at - (ends - size), size)]
        return ids, np.bincount(row, size, rows).astype(np.int64)

    def _tokenized(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, end = _spelt(data, start, length), np.cumsum(length)
        return data, *self.tokenize(data, end - length, end, head)

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, length: np.ndarray, head: np.ndarray) -> None:
        raw, size, ids = self._tokenized(data, start, length, head)
        at = len(self.pool) + np.cumsum(size) - size
        spelt = len(self.raw) - 8 + np.cumsum(length) - length
        self.pool = np.concatenate((self.pool, ids))
        self.raw = np.concatenate((self.raw[:-8], raw, self.raw[-8:]))
        into = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, into, keys)
        for name, new in (("at", at), ("size", size), ("spelt", spelt), ("length", length)):
            setattr(self, name, np.insert(getattr(self, name), into, new.astype(np.int32)))
