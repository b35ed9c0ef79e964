"""Small helpers for models that are fitted in numpy on a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Adam:
    """Stochastic gradient steps with momentum and per-weight scale, in place."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.turn += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for w, g, m, s in zip(self.weights, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= (scale * m / (np.sqrt(s) + 1e-7)).astype(w.dtype)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
