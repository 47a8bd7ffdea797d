"""Word shingles of whole texts as sorted 64-bit hashes, in numpy, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Odd base of the rolling byte hash, its inverse modulo 2**64, and the seed of the byte values (fixed: stored signatures depend on them).
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240607
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MULT = np.random.default_rng(_SEED + 1).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 19), base, np.uint64)
        steps[0] = 1
        _powers[base] = held = np.multiply.accumulate(steps)
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased), in order, and the index of each text's first word, with the end."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data | np.uint8(32), data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    rolling = np.empty(len(data) + 1, np.uint64)
    rolling[0] = 0
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=rolling[1:])
    hashes = mix64((rolling[ends] - rolling[starts]) * _power(_BACK, len(data))[starts])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], n: int, block: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes; fewer words: the whole sequence as one; none: empty."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= block:
            yield from _sets(part, n)
            part, size = [], 0
    if part:
        yield from _sets(part, n)


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    words, at = word_hashes(texts)
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        full += words[k : k + len(full)] * _MULT[k]
    full = mix64(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            yield np.unique(full[a : b - n + 1])
        elif b > a:
            yield mix64((words[a:b] * _MULT[: b - a]).sum(keepdims=True, dtype=np.uint64) + _MULT[n + b - a])
        else:
            yield np.empty(0, np.uint64)
