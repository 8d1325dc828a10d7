"""Word shingles of whole texts as 64-bit hashes, made block by block in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tokenloom.llm._common import utf8

_RNG = np.random.default_rng(90210)
#: A random value for each byte, an odd multiplier and its inverse modulo 2**64, and odd multipliers for the places in a shingle.
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: ASCII upper to lower case; the white space of the contract to a space.
_TABLE = bytes(32 if i == 32 or 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: Bytes of texts that are hashed at once; powers are kept for so many, and made anew for longer texts.
BLOCK = 1 << 18
_powers = [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_P, _INVERSE):
        x = np.full(max(n, BLOCK + 2), base, dtype=np.uint64)
        x[0] = 1
        made.append(np.cumprod(x))
    if n <= BLOCK + 2:
        _powers[:] = made
    return made


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes: sum of BYTES[b] P**i over a word, from running sums; then mixed with its length."""
    space = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(data) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])))
    return start, mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _whole(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for a text of fewer than n words; their number is part of it, so it equals no full shingle's but by chance."""
    return mix((words * _PLACES[: len(words)]).sum(keepdims=True) + _PLACES[n : n + 1] * np.uint64(0xABCD + len(words)))


def sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its distinct shingles of n words, sorted; with fewer words the whole as one; without any, none."""
    raw = [utf8(t).translate(_TABLE) for t in texts]
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) < BLOCK):
            size += len(raw[to]) + 1
            to += 1
        data = np.frombuffer(b" ".join(raw[at:to]), dtype=np.uint8)
        start, words = _words(data)
        ends = np.cumsum([len(r) + 1 for r in raw[at:to]])
        edges = np.concatenate(([0], np.searchsorted(start, ends)))
        if len(words) >= n:
            h = words[: len(words) - n + 1] * _PLACES[0]
            for k in range(1, n):
                h = h + words[k : len(words) - n + 1 + k] * _PLACES[k]
            h = mix(h)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a >= n:
                yield np.unique(h[a : b - n + 1])
            elif b > a:
                yield _whole(words[a:b], n)
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = to
