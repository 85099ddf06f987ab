"""Array kernels over the bytes of many texts at once: words, hashes of words and of word windows.

All of them take the bytes of a batch of texts laid end to end and the offsets of the texts, and
work a slice at a time, so that memory follows the slice and not the longest text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

SLICE = 1 << 17
_U = np.uint64


def _word_table(first_to_last: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in first_to_last:
        table[a : b + 1] = True
    return table


NOT_SPACE = ~_word_table([(0x20, 0x20), (0x09, 0x0D)])
"""Bytes of words in the pattern [^\\x20\\x09-\\x0D]+."""
ALNUM = _word_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
"""Bytes of words in [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, after A-Z have become a-z."""
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


CACHES: dict = {}
"""What a reused Python worker keeps for the next task of the same operator; others drop it."""


class ByteRolling:
    """Polynomial hash over bytes modulo 2^64 with a random value for each byte; it picks anchors by
    sums over a whole slice.  Unequal strings can be built that it takes for equal, so nothing may be
    judged equal by it alone."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
        self.base = int(rng.integers(1 << 40, 1 << 63)) * 8 + 5 & (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = (np.ones(1, _U), np.ones(1, _U))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[0]) <= n:
            size = max(2 * SLICE, n + 1)
            up, down = np.full(size, self.base, _U), np.full(size, self.inverse, _U)
            up[0] = down[0] = 1
            made = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n > 8 * SLICE:
                return made
            self._powers = made
        return self._powers


ROLLING = ByteRolling(11)
LONG_WORD = 256
"""Words of more bytes are hashed one by one."""
_SEEDS = tuple(_U(x) for x in np.random.default_rng(29).integers(1, 1 << 63, 2, dtype=_U) * _U(2) + _U(1))
_ODD = tuple(_U(x) for x in np.random.default_rng(31).integers(1, 1 << 63, 2, dtype=_U) * _U(2) + _U(1))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the offsets of its rows; null is empty."""
    CACHES.clear()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's first word (one more at the end)."""
    member = table[data]
    begins, closes = member.copy(), member.copy()
    begins[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    filled = offs[1:] > offs[:-1]
    first, last = offs[:-1][filled], offs[1:][filled] - 1
    begins[first] = member[first]
    closes[last] = member[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``which`` picks one of two independent ones.

    Eight bytes at a time are mixed into the hash so far, which is mixed again before the next eight
    come, so that no pattern inside a word, such as repeats, cancels out.  Words over LONG_WORD bytes
    go through xxh3."""
    out = np.empty(len(starts), _U)
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    for at in range(0, len(starts), 1 << 15):
        begin = starts[at : at + (1 << 15)]
        left = ends[at : at + (1 << 15)] - begin
        state = left.astype(_U) * _ODD[which] + _SEEDS[which]
        long = np.flatnonzero(left > LONG_WORD)
        for i in long.tolist():
            state[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + left[i]].tobytes(), seed=int(_SEEDS[which]))
        rows = np.flatnonzero(left <= LONG_WORD) if len(long) else None
        done = 0
        while rows is None or len(rows):
            n = (left if rows is None else left[rows]) - done
            chunk = eights[(begin if rows is None else begin[rows]) + done] & _FIRST_BYTES[np.minimum(n, 8)]
            mixed = mix((state if rows is None else state[rows]) ^ chunk * _ODD[which])
            if rows is None:
                state, rows = mixed, np.arange(len(begin))
            else:
                state[rows] = mixed
            more = n > 8
            rows, done = rows[more], done + 8
        out[at : at + len(begin)] = state
    return out


def window_hashes(hashed: np.ndarray, first: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of k words inside one text: its hash, its first word and its text's number.

    Runs of 2, 4, 8, ... words are made of two halves, and a run of k of those in k's binary digits;
    the left part is mixed before the right one is added, so that repeats don't cancel out."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, done, part, size = None, 0, hashed, 1
    while size <= k:
        if k & size:
            piece = part[done : done + n]
            total = piece if total is None else mix(total) * _ODD[which] + piece
            done += size
        if 2 * size <= k:
            part = mix(part[:-size]) * _SEEDS[which] + part[size:]
        size *= 2
    counts = np.diff(first)
    whole = np.arange(n) + k <= np.repeat(first[1:], counts)[:n]
    at = np.flatnonzero(whole)
    return mix(total[at]), at, np.repeat(np.arange(len(counts)), counts)[at]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n places lie in one of the runs of k places that start at ``at``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + k, n), -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as gaps, byte plane by byte plane, compressed."""
    gaps = np.diff(values.astype(_U), prepend=_U(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(_U).ravel(), dtype=_U)


def pack_any(values: np.ndarray) -> bytes:
    """64-bit numbers in any order, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_any(blob: bytes, kind=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def pack_bits(mask: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(mask).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), count=n).astype(bool)


def release() -> None:
    """Gives back to the machine what this process has freed; a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
