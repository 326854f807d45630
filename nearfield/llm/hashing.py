"""Hashes of words and of runs of words, for whole batches of texts."""

from __future__ import annotations

import numpy as np

from nearfield.functions.random import SplitMix64

_U = np.uint64
_BASE = SplitMix64.GAMMA


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(SplitMix64.MIX1)
    x = (x ^ (x >> _U(27))) * _U(SplitMix64.MIX2)
    return x ^ (x >> _U(31))


def odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U(seed)) | _U(1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 18)
        inverse = pow(_BASE, -1, 1 << 64)
        ones = np.full(n, _BASE, _U), np.full(n, inverse, _U)
        _POWERS[:] = [np.cumprod(o) for o in ones]
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[first:last], which depend on the values alone."""
    up, down = _powers(len(values) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)])))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U) * _U(_BASE))


def word_hashes(texts: list[str | None], blanks: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has.

    Words are runs of bytes other than ``blanks`` in UTF-8; with ``lower``, A-Z count as a-z.
    """
    pieces = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum(np.array([len(p) + 1 for p in pieces], np.int64))
    raw = b"\n".join([*pieces, b""])
    b = np.frombuffer(raw.lower() if lower else raw, np.uint8)  # of bytes, lower() changes A-Z only
    word = np.ones(256, bool)
    word[list(blanks)] = False
    inside = np.concatenate(([False], word[b], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    return span_hashes(b, first, last), np.diff(np.concatenate(([0], np.searchsorted(first, ends))))


def kmers(texts: list[str | None], k: int, blanks: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all texts in order, and how many each text has.

    A text of fewer than k words, but not none, has one: all its words.
    """
    words, n = word_hashes(texts, blanks, lower)
    pad = np.where((n > 0) & (n < k), k - n, 0)
    if pad.any():
        at = np.repeat(np.cumsum(n), pad)
        words = np.insert(words, at, _U(0))
        n = n + pad
    total = np.zeros(max(0, len(words) - k + 1), _U)
    for j, c in enumerate(odd(k, 7)):
        total += mix(words[j : j + len(total)] + c) * c
    total = mix(total)
    count = np.maximum(n - k + 1, 0)
    start = np.cumsum(n) - n
    keep = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return total[keep], count
