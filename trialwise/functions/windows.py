"""Symmetric signal windows as array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def raised_cosine_window(n: int, alpha: float) -> Column:
    """alpha - (1 - alpha) cos(2 pi i / (n - 1)) for i from 0 to n - 1; a window of one sample is at phase 0."""
    if n < 1:
        raise ValueError("a window has at least one sample")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(alpha) - F.lit(1 - alpha) * F.cos(F.lit(2 * math.pi) * i / F.lit(float(max(n - 1, 1)))))


def hann_window(n: int) -> Column:
    return raised_cosine_window(n, 0.5)


def hamming_window(n: int) -> Column:
    return raised_cosine_window(n, 25 / 46)
