"""Vectorised words, word hashes and shingle hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Bytes handled at once: bounds memory (about 60 bytes of arrays a byte of text).
PIECE = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit keys."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, _U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of data."""
    a = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_SPACE[a], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, _U)
    up, down = _pow(len(a))
    total = np.zeros(len(a) + 1, _U)
    np.cumsum((a.astype(_U) + _U(1)) * up, out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _cuts(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE bytes that end at white space."""
    at = 0
    while len(data) - at > 2 * PIECE:
        stop = max(data.rfind(c, at, at + PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop <= at:  # one word that long: up to its end
            ends = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := data.find(c, at + PIECE)) >= 0]
            stop = min(ends, default=len(data))
        yield data[at:stop]
        at = stop
    yield data[at:]


def word_hashes(texts: Sequence[str | None], lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes in order) of each text; A-Z in lower case if asked. Null is empty."""
    def flush(first: int, raws: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        data = b" ".join(raws)
        start, h = _piece_hashes(data)
        at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        cut = np.searchsorted(start, at)
        for i in range(len(raws)):
            yield first + i, h[cut[i] : cut[i + 1]]

    waiting: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        raw = raw.lower() if lower else raw
        if waiting and held + len(raw) > PIECE:
            yield from flush(i - len(waiting), waiting)
            waiting, held = [], 0
        if len(raw) > PIECE:
            yield i, np.concatenate([_piece_hashes(p)[1] for p in _cuts(raw)])
        else:
            waiting.append(raw)
            held += len(raw)
    if waiting:
        yield from flush(len(texts) - len(waiting), waiting)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle; none make none."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    h = np.full(n - size + 1, size, _U)
    for j in range(size):
        h = h * _U(0x9FB21C651E98DF25) + words[j : n - size + 1 + j]
        h ^= h >> _U(29)
    return np.unique(mix(h))
