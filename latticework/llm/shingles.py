"""Word shingles of whole texts, hashed in numpy.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z became a-z; a document's set
holds the 64-bit hashes of its distinct five-word runs.  A text with one to four
words has one shingle, the whole sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PIECE = 1 << 18


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _POSITION = _odd(20240601, 256), _odd(20240602, WORDS)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _PIECE + 2)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The byte offset and a 64-bit hash of each word of ``data``, in order."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gap = np.ones(len(raw) + 2, np.int8)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return begin, mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _M1)


def _set_of(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    width = min(n, WORDS)
    sums = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        sums += words[i : n - width + 1 + i] * _POSITION[i]
    found = mix(sums)
    found.sort()
    return found if len(found) < 2 else found[np.concatenate(([True], found[1:] != found[:-1]))]


def shingle_sets(texts: Iterable[bytes | str | None]) -> Iterable[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; null counts as empty.

    Neighbouring short texts share one buffer, so the cost of a numpy call is
    spread over them; a long text has a buffer of its own.
    """
    group: list[bytes] = []
    size = 0

    def flush() -> Iterable[np.ndarray]:
        at = np.cumsum([0, *(len(g) + 1 for g in group)])
        begin, words = word_hashes(b"\n".join(group))  # the line feed ends a text's last word
        cut = np.searchsorted(begin, at)
        return [_set_of(words[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    for text in texts:
        raw = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if group and size + len(raw) >= _PIECE:
            yield from flush()
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from flush()
