"""Hashes of words and word shingles of many texts at once, with array operations.

A word is a run of anything but ASCII white space, so UTF-8 bytes can be cut
without decoding. Word hashes are differences of one running polynomial sum
over the bytes, scaled back to the word's start, then mixed (64 bits).
"""

from __future__ import annotations

import re

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
PIECE = 1 << 18  # bytes hashed at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE * 2)
        up = np.full(n, BASE, np.uint64)
        down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def _words(buffer: bytes, lower: bool, letters: bool, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a buffer that ends with white space."""
    a = np.frombuffer(buffer, np.uint8)
    space = (_NO_LETTER if letters else _IS_SPACE)[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if first:
        ends = np.minimum(ends, starts + first)
    if lower:
        a = _LOWER[a]
    up, down = _power(len(a))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])])
    return mixed((upto[ends] - upto[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), starts


def word_hashes(texts: list[bytes], lower: bool = True, letters: bool = False, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's begin: one more entry than texts).
    ``letters``: words are runs of ASCII letters and non-ASCII characters instead.
    ``first``: only that many bytes of each word are hashed."""
    parts: list[bytes] = []  # texts cut at white space
    of: list[int] = []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE:
            cut = _SPACE.search(t, at + PIECE)
            if not cut:
                break
            parts.append(t[at : cut.start()])
            of.append(i)
            at = cut.start()
        parts.append(t[at:] if at else t)
        of.append(i)
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    begin = 0
    while begin < len(parts):
        last, size = begin, 0
        while last < len(parts) and (last == begin or size + len(parts[last]) < PIECE):
            size += len(parts[last]) + 1
            last += 1
        h, starts = _words(b"\n".join(parts[begin:last]) + b"\n", lower, letters, first)
        hashes.append(h)
        ends = np.cumsum([len(p) + 1 for p in parts[begin:last]])
        np.add.at(counts, np.array(of[begin:last]) + 1, np.diff(np.searchsorted(starts, ends), prepend=0))
        begin = last
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_hashes(texts: list[bytes], k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of k words, where each text's begin). A text with
    fewer words has its whole sequence as one; one without words has none."""
    words, at = word_hashes(texts, lower)
    n = np.diff(at)
    step = np.uint64(0xD6E8FEB86659FD93)
    runs = words.copy()
    for j in range(1, min(k, len(words))):
        runs[:-j] = mixed(runs[:-j] * step + words[j:])
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((n > 0) & (n < k))
    keep = np.repeat(at[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    out = runs[keep]
    for i in short.tolist():  # whole sequences, marked by their length
        x = words[at[i] : at[i] + 1].copy()
        for w in words[at[i] + 1 : at[i + 1]]:
            x = mixed(x * step + w)
        out[begin[i]] = mixed(x + np.uint64(n[i]))[0]
    return out, begin
