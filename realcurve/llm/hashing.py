"""Hashes of words and shingles as numpy arrays, for tasks that work on whole texts."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 2 * len(_POWERS["up"]), 1 << 14)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return (text or "").encode("utf-8", "replace").lower()


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each word ``[^\\x20\\x09-\\x0D]+``, in order: a polynomial in the word's bytes by differences of prefix sums."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    solid = ~_BLANK[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; with fewer words the whole sequence is the one shingle, without words none."""
    w = word_hashes(data)
    size = min(n, len(w))
    if not size:
        return w
    h = np.full(len(w) - size + 1, np.uint64(size))
    for k in range(size):
        h = mixed(h + w[k : len(w) - size + 1 + k])
    return np.unique(h)
