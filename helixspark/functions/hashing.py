"""64-bit hashes of packed sequences, in numpy's wrapping uint64. Spark's own hash functions differ from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.functions.arrays import joined
from helixspark.functions.sequence import CODES

SEED = 313

# Fixed values of MurmurHash3 x64 128.
_C1 = np.uint64(0x87C37B91114253D5)
_C2 = np.uint64(0x4CF5AD432745937F)
_F1 = np.uint64(0xFF51AFD7ED558CCD)
_F2 = np.uint64(0xC4CEB9FE1A85EC53)
_N1 = np.uint64(0x52DCE729)
_N2 = np.uint64(0x38495AB5)


def rotl64(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def rotl32(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _finish(k: np.ndarray) -> np.ndarray:
    for factor in (_F1, _F2):
        k = (k ^ (k >> np.uint64(33))) * factor
    return k ^ (k >> np.uint64(33))


def murmur128(words: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of MurmurHash3 x64 128 for rows of little-endian 8-byte words."""
    words = np.atleast_2d(np.asarray(words, np.uint64))
    n = words.shape[1]
    one = np.full(len(words), seed, np.uint64)
    two = one.copy()
    first = lambda k: rotl64(k * _C1, 31) * _C2
    second = lambda k: rotl64(k * _C2, 33) * _C1
    for i in range(0, n - 1, 2):
        one = (rotl64(one ^ first(words[:, i]), 27) + two) * np.uint64(5) + _N1
        two = (rotl64(two ^ second(words[:, i + 1]), 31) + one) * np.uint64(5) + _N2
    if n % 2:
        one = one ^ first(words[:, -1])
    one, two = one ^ np.uint64(8 * n), two ^ np.uint64(8 * n)
    one = one + two
    two = two + one
    one, two = _finish(one), _finish(two)
    one = one + two
    return one, two + one


def murmur64(words: np.ndarray, seed: int = SEED) -> np.ndarray:
    return murmur128(words, seed)[0]


def murmur32(words: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The low 32 bits of the first half."""
    return (murmur64(words, seed) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def wang64(x: np.ndarray) -> np.ndarray:
    """Thomas Wang's invertible 64-bit mix."""
    x = np.asarray(x, np.uint64)
    x = ~x + (x << np.uint64(21))
    x = x ^ (x >> np.uint64(24))
    x = x * np.uint64(265)
    x = x ^ (x >> np.uint64(14))
    x = x * np.uint64(21)
    x = x ^ (x >> np.uint64(28))
    return x + (x << np.uint64(31))


def _undo_shift(x: np.ndarray, by: int) -> np.ndarray:
    """Inverse of x ^ (x >> by)."""
    out = x
    for _ in range(64 // by):
        out = x ^ (out >> np.uint64(by))
    return out


def wang64_inverse(x: np.ndarray) -> np.ndarray:
    """Each step of wang64 undone: products by inverse factors modulo 2 ** 64, shifts by repetition."""
    inverse = lambda factor: np.uint64(pow(factor, -1, 1 << 64))
    x = np.asarray(x, np.uint64) * inverse((1 << 31) + 1)
    x = _undo_shift(x, 28) * inverse(21)
    x = _undo_shift(x, 14) * inverse(265)
    x = _undo_shift(x, 24)
    return (x + np.uint64(1)) * inverse((1 << 21) - 1)


def superfast32(column: pa.Array) -> np.ndarray:
    """Paul Hsieh's SuperFastHash of byte strings, all rows at once; 0 for empty ones. Bytes that stand alone are signed."""
    data, offsets = joined(column)
    return superfast32_at(data, offsets[:-1], np.diff(offsets))


def superfast32_at(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """As superfast32, of data[start[i] : start[i] + length[i]], which may overlap, four bytes at a time."""
    wide = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    shorts, signed = wide[:-1] | wide[1:] << np.uint32(8), wide.astype(np.uint8).view(np.int8).astype(np.int32).view(np.uint32)
    h = length.astype(np.uint32)
    by_length = np.argsort(-length, kind="stable")
    left, right = (lambda x, n: x << np.uint32(n)), (lambda x, n: x >> np.uint32(n))
    blocks = length[by_length] // 4
    for i in range(int(blocks.max(initial=0))):
        rows = by_length[: np.searchsorted(-blocks, -i, "left")]  # those with a block i
        at, x = start[rows] + 4 * i, h[rows]
        x = x + shorts[at]
        x = left(x, 16) ^ (left(shorts[at + 2], 11) ^ x)
        h[rows] = x + right(x, 11)
    for rest, shift, back in ((3, 16, 11), (2, 11, 17), (1, 10, 1)):
        rows = np.flatnonzero(length % 4 == rest)
        at, x = start[rows] + length[rows] // 4 * 4, h[rows]
        x = x + (signed[at] if rest == 1 else shorts[at])
        x = x ^ left(x, shift)
        if rest == 3:
            x = x ^ left(signed[at + 2], 18)
        h[rows] = x + right(x, back)
    for shift, back in ((3, 5), (4, 17), (25, 6)):
        h = h ^ left(h, shift)
        h = h + right(h, back)
    return np.where(length == 0, np.uint32(0), h)


def left_aligned(codes: np.ndarray) -> np.ndarray:
    """Rows of base codes as rows of 64-bit words, 32 bases a word from the high bits."""
    n, k = codes.shape
    padded = np.zeros((n, -(-k // 32) * 32), np.uint64)
    padded[:, :k] = codes
    shifts = np.uint64(62) - np.arange(32, dtype=np.uint64) * np.uint64(2)
    return (padded.reshape(n, -1, 32) << shifts).sum(axis=2, dtype=np.uint64)


@F.pandas_udf(T.LongType())
def murmur64_of(kmer: pd.Series) -> pd.Series:
    """The hash of a sequence's packed words, as the LONG with the same bits."""
    out = np.zeros(len(kmer), np.int64)
    for length, rows in kmer.groupby(kmer.str.len()).groups.items():
        text = kmer.loc[rows]
        codes = CODES[np.frombuffer("".join(text).encode(), np.uint8)].reshape(len(text), int(length))
        out[kmer.index.get_indexer(rows)] = murmur64(left_aligned(codes)).view(np.int64)
    return pd.Series(out)


@F.pandas_udf(T.LongType())
def wang64_of(value: pd.Series) -> pd.Series:
    return pd.Series(wang64(value.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(T.LongType())
def wang64_inverse_of(value: pd.Series) -> pd.Series:
    return pd.Series(wang64_inverse(value.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.arrow_udf(T.LongType())
def superfast32_of(data: pa.Array) -> pa.Array:
    """The unsigned 32-bit hash of a string's or binary's bytes; null is empty."""
    return pa.array(superfast32(data).astype(np.int64))
