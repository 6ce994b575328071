"""Word shingle sets as 64-bit hashes, computed for a whole batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_PIECE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64, 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of bytes other than white space; a polynomial over the bytes, by prefix sums."""
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's begin (one more entry for the end).

    Long input goes in pieces that end at white space, so working memory follows the piece, not the text.
    """
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    places, hashes, at = [], [], 0
    while at < len(data):
        stop = min(at + _PIECE, len(data))
        if stop < len(data) and not SPACE[data[stop]]:
            near = np.flatnonzero(SPACE[data[at:stop]])
            if len(near):
                stop = at + int(near[-1])
            else:
                while stop < len(data):
                    near = np.flatnonzero(SPACE[data[stop : stop + _PIECE]])
                    stop = stop + int(near[0]) if len(near) else min(stop + _PIECE, len(data))
                    if len(near):
                        break
        place, found = _hash_words(data[at:stop])
        places.append(place + at)
        hashes.append(found)
        at = max(stop, at + 1)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return found, np.searchsorted(place, offsets)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; with fewer words the whole sequence is one; none without words."""
    word, first = words(texts)
    rolled = word
    for j in range(1, n):
        rolled = mix(rolled[: len(word) - j] * _ODD) + word[j:] if len(word) > j else word[:0]
    rolled = mix(rolled)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            acc = word[a : a + 1]
            for i in range(a + 1, b):
                acc = mix(acc * _ODD) + word[i : i + 1]
            yield mix(acc + np.full(1, b - a, np.uint64))
        else:
            yield np.zeros(0, np.uint64)
