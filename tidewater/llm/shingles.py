"""Words and word shingles of a text as 64-bit numbers, computed over arrays.

A word's number is a multilinear hash of its bytes (a number for each byte value times
one for its place, summed), a shingle's one of its words' numbers; both are scrambled
at the end. All tables follow from the rule ``scramble(i)``.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 1 << 20


def scramble(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
OF_BYTE = numbers(1, 256)
OF_WORD = numbers(3, 64) | U64(1)
_of_place = numbers(2, 256) | U64(1)


def of_place(n: int) -> np.ndarray:
    global _of_place
    if n > len(_of_place):
        _of_place = numbers(2, 2 * n) | U64(1)
    return _of_place


def _block_words(a: np.ndarray) -> np.ndarray:
    black = ~SPACE[a]
    edge = np.flatnonzero(np.diff(black, prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, U64)
    values = OF_BYTE[a[black]]
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(at, lengths)
    values *= of_place(int(lengths.max()))[place]
    return scramble(np.add.reduceat(values, at) + lengths.astype(U64))


def word_numbers(data: bytes) -> np.ndarray:
    """A number for each word of ``data`` in order; words are runs of other bytes than ASCII white space."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= 2 * BLOCK:
        return _block_words(a)
    out, start = [], 0
    while start < len(a):  # long texts in blocks that end at white space
        end = start + BLOCK
        while end < len(a):
            space = np.flatnonzero(SPACE[a[end : end + BLOCK]])
            if len(space):
                end += int(space[0])
                break
            end += BLOCK
        out.append(_block_words(a[start:end]))
        start = end
    return np.concatenate(out)


def text_words(text: str | None) -> np.ndarray:
    """A-Z lower-cased."""
    return word_numbers((text or "").encode("utf-8", "surrogatepass").lower())


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted numbers of the distinct k-word shingles; of fewer words, one of the whole sequence; of none, nothing."""
    w = text_words(text)
    if not len(w):
        return w
    m = min(k, len(w))
    total = np.full(len(w) - m + 1, m, U64)
    for j in range(m):
        total += w[j : len(w) - m + 1 + j] * OF_WORD[j]
    return np.unique(scramble(total))
