"""CRC-32 of words and of runs of words over arrays, by the algebra of GF(2).

A CRC is affine in the bytes: what a byte adds depends on itself and on how many bytes follow, so all words of a
block are summed (by exclusive or) at once. Joining texts shifts the first one's CRC by the second one's length:
crc(ab) = M^|b| crc(a) + crc(b), with M the matrix that appends a zero byte. M's powers of two are kept, each
as four tables for the bytes of its argument, and a length's shift is the product of those in its binary digits.
"""

from __future__ import annotations

import zlib

import numpy as np

U32 = np.uint32
POLYNOMIAL = U32(0xEDB88320)  # CRC-32 as in zlib (fixed value)
LONG = 128  # bytes; longer words are taken one by one
SPACE = U32(zlib.crc32(b" "))


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=U32)
    for _ in range(8):
        x = np.where(x & U32(1), (x >> U32(1)) ^ POLYNOMIAL, x >> U32(1))
    return x


TABLE = _byte_table()


def _zero_byte(x: np.ndarray) -> np.ndarray:
    """M x: a zero byte is appended."""
    return (x >> U32(8)) ^ TABLE[x & U32(255)]


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    return matrix[0][x & U32(255)] ^ matrix[1][(x >> U32(8)) & U32(255)] ^ matrix[2][(x >> U32(16)) & U32(255)] ^ matrix[3][x >> U32(24)]


def _powers(n: int) -> list[np.ndarray]:
    """M^(2^i) for i < n."""
    out = [np.stack([_zero_byte(np.arange(256, dtype=U32) << U32(8 * k)) for k in range(4)])]
    while len(out) < n:
        out.append(np.stack([_apply(out[-1], column) for column in out[-1]]))
    return out


POWERS = _powers(40)


def _of_place() -> np.ndarray:
    """What a byte adds with so many after it."""
    rows = [TABLE]
    while len(rows) < LONG:
        rows.append(_zero_byte(rows[-1]))
    return np.stack(rows)


def _starts() -> np.ndarray:
    """The register's start, all ones, after so many bytes."""
    rows = [np.array([0xFFFFFFFF], U32)]
    while len(rows) <= LONG:
        rows.append(_zero_byte(rows[-1]))
    return np.concatenate(rows)


OF_PLACE, START = _of_place(), _starts()


def shift(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """M^length x for each."""
    x = x.copy()
    for i in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> i & 1)
        x[at] = _apply(POWERS[i], x[at])
    return x


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of data[start : start + length] for each; lengths are 1 at least."""
    out = np.empty(len(starts), U32)
    short = np.flatnonzero(lengths <= LONG)
    n = lengths[short]
    if len(short):
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        values = OF_PLACE[np.repeat(n, n) - 1 - place, data[np.repeat(starts[short], n) + place]]
        out[short] = np.bitwise_xor.reduceat(values, at) ^ START[n] ^ U32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > LONG):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out


def run_crcs(words: np.ndarray, lengths: np.ndarray, n: int) -> list[np.ndarray]:
    """CRCs of all runs of 1 to n neighbours joined by a space: at i of the k-th, that of the k words from i on."""
    out = [words]
    for k in range(2, n + 1):
        before, last = out[-1][: max(len(words) - k + 1, 0)], slice(k - 1, None)
        spaced = _apply(POWERS[0], before) ^ SPACE
        out.append(shift(spaced, lengths[last]) ^ words[last])
    return out
