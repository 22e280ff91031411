"""Simple-8b coding of token ids in 64-bit words, in numpy, with blocks that decode on their own.

A word's low 4 bits are a selector; the other 60 hold as many ids, at one width, as the selector says. Ids are
packed in blocks of ``BLOCK``; the offset of each block's first word is kept, so that blocks can be found and
decoded apart or all at once. An id of more than 60 bits is an escape: its place holds 0 and the id itself is
in a list of (position, id) behind the offsets.

Layout, little-endian: magic "S8BT", uint32 block size, uint64 ids, uint64 words, uint64 escapes, then uint32
block offsets (one a block, and the number of words), uint64 escape positions, uint64 escaped ids, the words.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
MAGIC = b"S8BT"
_HEAD = struct.Struct("<4sIQQQ")
#: Ids in a word, and bits of each, by selector.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_LIMIT = np.array([1 << w for w in WIDTH[2:-1].tolist()], np.uint64)  # ids from here on need a wider selector
_NARROW = np.searchsorted(_LIMIT, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8) + 2
_NARROW[0] = 0


def _needs(ids: np.ndarray) -> np.ndarray:
    """The highest selector number that each id needs at least."""
    if not len(ids) or ids.max() < 1 << 16:
        return _NARROW[ids.astype(np.int64)]
    small = ids < np.uint64(1 << 16)
    out = _NARROW[np.where(small, ids, np.uint64(0)).astype(np.int64)]
    if not small.all():
        out[~small] = np.searchsorted(_LIMIT, ids[~small], side="right").astype(np.int8) + 2
    return out


def encode(ids: np.ndarray) -> bytes:
    """``ids`` (whole numbers from 0 to 2**64-1) as bytes."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    escape = np.flatnonzero(ids >> np.uint64(60))
    escaped = ids[escape]
    if len(escape):
        ids = ids.copy()
        ids[escape] = 0
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    need = _needs(padded)
    need[n:] = -1
    # best[i]: the selector of most ids that can start at i. Where one fits, so does each that holds fewer.
    best = np.full(len(padded), 15, np.int8)
    most = need  # the highest need of the ids from each place on that a selector holds
    for s in range(14, -1, -1):
        more = int(COUNT[s] - COUNT[s + 1])
        most = np.maximum(most[:-more], most[more:])
        fits = most <= s
        if not fits.any():
            break
        best[: len(fits)] -= fits.view(np.int8)
    starts = np.zeros(len(padded), bool)
    place = np.arange(blocks) * BLOCK
    stop = np.minimum(place + BLOCK, n)
    while len(place):
        starts[place] = True
        place = place + COUNT[best[place]]
        going = place < stop
        if not going.all():
            place, stop = place[going], stop[going]
    first = np.flatnonzero(starts)
    words = best[first].astype(np.uint64)
    if n:
        many, width = np.diff(first, append=n), WIDTH[best[first]].astype(np.uint64)
        shift = np.arange(n, dtype=np.uint64) * np.repeat(width, many) + np.repeat(np.uint64(4) - width * first.astype(np.uint64), many)
        words |= np.bitwise_or.reduceat(padded[:n] << shift, first)
    offsets = np.append(np.searchsorted(first, np.arange(blocks) * BLOCK), len(words)).astype("<u4")
    return _HEAD.pack(MAGIC, BLOCK, n, len(words), len(escape)) + offsets.tobytes() + escape.astype("<u8").tobytes() + escaped.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def _parse(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    magic, block, n, words, escapes = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b stream")
    at, blocks = _HEAD.size, -(-n // block)
    offsets = np.frombuffer(data, "<u4", blocks + 1, at)
    at += offsets.nbytes
    where = np.frombuffer(data, "<u8", escapes, at)
    escaped = np.frombuffer(data, "<u8", escapes, at + 8 * escapes)
    return n, block, offsets, where, escaped, np.frombuffer(data, "<u8", words, at + 16 * escapes)


def decode(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks ``first_block`` up to but not ``last_block`` (all, if not given), as uint64."""
    n, block, offsets, where, escaped, words = _parse(data)
    last_block = len(offsets) - 1 if last_block is None else min(last_block, len(offsets) - 1)
    if first_block >= last_block:
        return np.empty(0, np.uint64)
    low, high = first_block * block, min(n, last_block * block)
    words = words[int(offsets[first_block]) : int(offsets[last_block])]
    offset = offsets[first_block : last_block + 1].astype(np.int64) - int(offsets[first_block])
    selector = (words & np.uint64(15)).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(COUNT[selector])))
    of_block = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    start = before[:-1] - before[offset[:-1]][of_block] + of_block * block
    end = np.minimum((of_block + 1) * block, high - low)
    out = np.zeros(high - low, np.uint64)
    for s in np.unique(selector).tolist():
        if not WIDTH[s]:
            continue
        mine = np.flatnonzero(selector == s)
        word, place, stop = words[mine] >> np.uint64(4), start[mine], end[mine]
        mask, width = np.uint64((1 << int(WIDTH[s])) - 1), np.uint64(WIDTH[s])
        for j in range(int(COUNT[s])):
            inside = place + j < stop
            if inside.all():
                out[place + j] = word & mask
            else:
                out[(place + j)[inside]] = (word & mask)[inside]
            word = word >> width if j + 1 < COUNT[s] else word
    for p, v in zip(where.tolist(), escaped.tolist(), strict=True):
        if low <= p < high:
            out[p - low] = v
    return out
