"""Array kernels over the bytes of many texts at once: words, hashes, shingles, MinHash.

A slice holds the UTF-8 bytes of consecutive texts of an Arrow batch and the
offsets of each text in it; nothing here crosses the border of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(7_919))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U64)
_BASE, _GRAM = 0x9E3779B97F4A7C1B, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2**64

#: Bytes that part words, as a table of 256: blanks for plain words, all but letters, digits and non-ASCII for the strict ones.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
STRICT = np.ones(256, bool)
STRICT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.array([1] + [x] * (size - 1), U64), dtype=U64) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(_BASE), _Powers(_GRAM)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any substring; see ``cut_hash``."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _BYTES.get(max(1, len(data)))[0][: len(data)], out=sums[1:])
    return sums


def cut_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end): equal content, equal hash, wherever it stands."""
    return mix((sums[end] - sums[start]) * _BYTES.get(len(sums))[1][start])


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words as maximal runs of bytes not in ``gap``; text t has the words bounds[t] to bounds[t + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[offsets < len(data)]
    before[edge] = False
    after[edge - 1] = False  # -1 is the last byte, which is an edge too
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_sums(hashes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _GRAMS.get(max(1, len(hashes)))[0][: len(hashes)], out=sums[1:])
    return sums


def grams(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of a slice; those that cross texts are for the caller to leave out."""
    count = len(sums) - n
    if count <= 0:
        return np.zeros(0, U64)
    return mix((sums[n:] - sums[:count]) * _GRAMS.get(len(sums))[1][:count] + U64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, gap: np.ndarray = BLANK) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles; with fewer words, of the whole sequence; none without words."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, gap)
    sums = gram_sums(cut_hash(byte_sums(data), starts, ends))
    runs = grams(sums, n)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(runs[lo : hi - n + 1])
        elif hi > lo:
            yield mix((sums[hi : hi + 1] - sums[lo : lo + 1]) * _GRAMS.get(len(sums))[1][lo : lo + 1] + U64(hi - lo))
        else:
            yield np.zeros(0, U64)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the least (the first of equal ones) of every ``w`` consecutive values, by windows that double."""
    at, span = np.arange(len(x)), 1
    if len(x) < w:
        return at[:0]
    while span < w:
        step = min(span, w - span)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        span += step
    return at


def multipliers(k: int, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, k, dtype=U64) * U64(2) + U64(1)


def minhash(hashes: np.ndarray, odd: np.ndarray, block: int = 2048) -> np.ndarray:
    """Least value of ``hashes`` under each of the permutations x -> odd * x, spread over 64 bits."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, U64)
    for at in range(0, len(hashes), block):
        np.minimum(least, (odd[:, None] * hashes[None, at : at + block]).min(axis=1), out=least)
    return mix(least)
