"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes that are no ASCII white space; A-Z count as a-z. A
shingle is five words in a row; a text of one to four words has one shingle of
all its words.
"""

from __future__ import annotations

import functools

import numpy as np

SHINGLE = 5
#: Bytes hashed in one go.
PART = 1_000_000
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[U(1)], np.full(n - 1, base, U).cumprod(dtype=U)])


INVERSE = pow(BASE, -1, 1 << 64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(Hash of each word, words a text, where each word starts and ends in its text)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = SPACE[raw]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    if len(starts):
        n = 1 << max(21, int(len(raw) - 1).bit_length())
        value = FOLD[raw] + U(1)
        value[blank] = 0
        value *= powers(BASE, n)[: len(raw)]
        hashes = mix(np.add.reduceat(value, starts) * powers(INVERSE, n)[starts] + (ends - starts).astype(U))
    else:
        hashes = np.zeros(0, U)
    upto = np.searchsorted(starts, offsets)
    counts = np.diff(upto)
    shift = np.repeat(offsets[:-1], counts)
    return hashes, counts, starts - shift, ends - shift


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Hash of each shingle in text order, shingles a text)."""
    out_counts = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    ends = np.cumsum(counts)
    starts = ends - counts
    at = np.repeat(starts - (np.cumsum(out_counts) - out_counts), out_counts) + np.arange(out_counts.sum())
    padded = np.concatenate([words, np.zeros(SHINGLE, U)])
    total = np.zeros(len(at), U)
    for k in range(SHINGLE):
        part = padded[at + k]
        if k:
            part = np.where(at + k < np.repeat(ends, out_counts), part, U(0))
        total += part * U(pow(BASE, k + 1, 1 << 64) | 1)
    return mix(total), out_counts


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Distinct shingles text by text, how often each occurs, distinct shingles a text)."""
    words, counts, _, _ = word_hashes(texts)
    s, n = shingle_hashes(words, counts)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    if not len(s):
        return s, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.bincount(owner[at], minlength=len(texts))


def parted(texts: list[bytes], most: int = PART):
    """Runs of texts of about ``most`` bytes: (first, one past the last)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
