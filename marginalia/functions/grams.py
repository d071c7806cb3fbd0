"""Grams of texts that any text which holds them shares.

Of every ``w`` grams of ``q`` characters in a row the least hash is kept (winnowing): a text of at
least ``q + w - 1`` characters keeps some, and a text that contains it keeps them too.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0xFF51AFD7ED558CCD)


def hashes(text: str, q: int) -> np.ndarray:
    """The hashes of all grams of a text, by place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def winnowed(text: str, q: int, w: int) -> np.ndarray:
    """The distinct hashes kept of a text, as signed longs."""
    h = hashes(text, q)
    if len(h) < w:
        return np.zeros(0, np.int64)
    if w > 1:
        h = np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)
    return np.unique(h).view(np.int64)


class Index:
    """The places of all grams of a text, for finding many others in it."""

    Q = 8

    def __init__(self, text: str):
        h = hashes(text, self.Q)
        self.text, self.at = text, np.argsort(h, kind="stable")
        self.grams = h[self.at]

    def find(self, other: str, start: int) -> int:
        """As ``str.find``, by the rarest gram of the other text."""
        h = hashes(other, self.Q)
        if not len(h):
            return self.text.find(other, start)
        first, end = (np.searchsorted(self.grams, h, side) for side in ("left", "right"))
        k = int(np.argmin(end - first))
        places = self.at[first[k] : end[k]] - k
        return next((at for at in places[np.searchsorted(places, start) :].tolist() if self.text.startswith(other, at)), -1)
