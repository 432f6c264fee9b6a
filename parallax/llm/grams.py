"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAD = 8
_STEP, _GOLD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, white space as one kind of blank, texts parted by zeros; and where each text begins.

    A blank goes before and after each text, so that n-grams can tell the edges of words.
    """
    gap = "\0" * PAD
    parts = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer((gap.join(parts) + gap).encode("utf-32-le", "replace"), np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 32
    return points, np.concatenate(([0], np.cumsum(lengths + PAD)))


def hashed(points: np.ndarray, orders: range, bits: int) -> Iterator[np.ndarray]:
    """For each order n, the ``bits``-bit hash of the n-gram that begins at each place; the last n - 1 places lack one."""
    h = np.full(len(points), 2166136261, np.uint32)
    for n in range(1, orders.stop):
        h = h[: len(points) - n + 1] * _STEP
        h ^= points[n - 1 :]
        if n in orders:
            yield ((h ^ np.uint32(n * 0x51ED27)) * _GOLD) >> np.uint32(32 - bits)
