"""Words and hashes of spans of many UTF-8 texts at once, as numpy arrays.

A batch of texts is one byte array with a boundary for each text; words and spans are index
pairs into it. ``span_hashes`` takes any spans, eight bytes a step; ``Rolling`` has a hash of every window of a
text from two prefix sums, modulo the prime 2**61 - 1. Neither is fooled by texts made of one pattern, as sums of
powers modulo 2**64 are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
PRIME = (1 << 61) - 1
#: Drawn at random below the prime.
_BASE = 0x0E3779B97F4A7C15 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
#: Spans longer than this are hashed by the library's digest.
LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: 31 random bits for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(33)
#: Odd multipliers of a window's words.
_PLACES = mix(np.arange(7, 7 + 64, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)  # the first n of eight bytes

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTES = ~WHITE
#: Letters, digits and all bytes of non-ASCII characters: words without ASCII punctuation.
PLAIN_BYTES = np.zeros(256, dtype=bool)
PLAIN_BYTES[48:58] = PLAIN_BYTES[65:91] = PLAIN_BYTES[97:123] = PLAIN_BYTES[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 boundaries; null counts as empty."""
    a = pa.compute.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    a = a.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(a) or a.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that cross no text's boundary, and each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = is_word[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans; the length is part of it. Spans of up to eight bytes and one length never collide."""
    length = ends - starts
    out = mix((length + 1).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
    if not len(starts):
        return out
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    todo, at = np.flatnonzero((length > 0) & (length <= LONG)), 0
    while len(todo):
        chunk = words[starts[todo] + at].view("<u8").ravel() & _MASKS[np.minimum(length[todo] - at, 8)]
        out[todo] = mix(out[todo] ^ chunk)
        at += 8
        todo = todo[length[todo] > at]
    long = np.flatnonzero(length > LONG)
    if len(long):
        key = seed.to_bytes(8, "little")
        view = memoryview(np.ascontiguousarray(data))
        digest = [hashlib.blake2b(view[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = np.frombuffer(b"".join(digest), dtype="<u8")
    return out


_P, _LOW31, _LOW30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo the prime."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it: 2**61 is 1 there, so the halves' products are shifted back in."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(U64(2) * a1 * b1 + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + a0 * b0)


#: Values that a hash's many temporary arrays hold at once.
CHUNK = 1 << 16

_powers = np.ones(1, dtype=U64), np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, by doubling."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for b in (_BASE, _INVERSE):
            a = np.ones(1, dtype=U64)
            while len(a) < n:
                a = np.concatenate([a, times(a, U64(pow(b, len(a), PRIME)))])
            out.append(a)
        _powers = tuple(out)
    return _powers


class Rolling:
    """Hashes of any windows of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        high_before = low_before = U64(0)
        for i in range(0, len(data), CHUNK):
            part = data[i : i + CHUNK]
            terms = times(power[i : i + len(part)], BYTE_VALUES[part])
            high, low = np.cumsum(terms >> U64(31)) + high_before, np.cumsum(terms & _LOW31) + low_before  # each below 2**62 for 2**31 bytes
            self.sums[i + 1 : i + 1 + len(part)] = _reduced((high >> U64(30)) + ((high & _LOW30) << U64(31)) + _reduced(low))
            high_before, low_before = high[-1], low[-1]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal bytes; the length is part of it."""
        out = np.empty(len(starts), dtype=U64)
        for i in range(0, len(starts), CHUNK):
            a, b = starts[i : i + CHUNK], ends[i : i + CHUNK]
            between = self.sums[b] + (_P - self.sums[a])
            out[i : i + CHUNK] = mix(times(_reduced(between), self.inverse[a]) + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        return out


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; fewer than k words, but some, make one window of them all."""
    n = len(word_hashes)
    if not n:
        return np.zeros(0, dtype=U64)
    m = min(k, n)
    out = np.full(n - m + 1, U64(m * 0x9E3779B97F4A7C15 % (1 << 64)), dtype=U64)
    for j in range(m):
        out += word_hashes[j : n - m + 1 + j] * _PLACES[j]
    return mix(out)
