"""Size, prefix and overlap bounds of the Jaccard, Dice and cosine similarities, as Column builders.

slack: what is taken off before rounding up, so that a filter never asks for more than the exact bound does.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-9


def ceil(x: Column, slack: float = 0.0) -> Column:
    return F.ceil(x - F.lit(slack)).cast("long")


class Similarity(Protocol):
    """What a join needs of a similarity; all sizes are Columns."""

    def size_ratio(self, t: float) -> float:
        """The smallest ratio of two sizes that may reach t."""

    def minsize(self, n: Column, t: float, slack: float = 0.0) -> Column: ...
    def maxsize(self, n: Column, t: float, slack: float = 0.0) -> Column: ...
    def minoverlap(self, a: Column, b: Column, t: float, slack: float = 0.0) -> Column: ...
    def maxprefix(self, n: Column, t: float, slack: float = 0.0) -> Column: ...
    def midprefix(self, n: Column, t: float, slack: float = 0.0) -> Column: ...
    def value(self, overlap: Column, a: Column, b: Column) -> Column: ...


class Prefixes:
    """The prefixes that follow from the other bounds."""

    def maxprefix(self, n: Column, t: float, slack: float = 0.0) -> Column:
        """Elements of the probing side to look up."""
        return F.least(n.cast("long"), n - self.minsize(n, t, slack) + 1)

    def midprefix(self, n: Column, t: float, slack: float = 0.0) -> Column:
        """Elements of the indexed side to look up, where it is the smaller set."""
        return F.least(n.cast("long"), n - self.minoverlap(n, n, t, slack) + 1)


class Jaccard(Prefixes):
    def size_ratio(self, t: float) -> float:
        return t

    def minsize(self, n: Column, t: float, slack: float = 0.0) -> Column:
        """Smallest size of a partner of a set of n."""
        return ceil(F.lit(float(t)) * n, slack)

    def maxsize(self, n: Column, t: float, slack: float = 0.0) -> Column:
        """Largest size of a partner."""
        return F.floor(n / F.lit(float(t)) + F.lit(slack)).cast("long")

    def maxsize_at(self, n: Column, pos: Column, t: float) -> Column:
        """Largest size of a partner whose first common element is at pos."""
        return F.floor((n - F.lit(1 - 1e-10 + t) * pos) / F.lit(float(t))).cast("long")

    def loose_maxsize(self, n: Column, t: float) -> Column:
        """The size filter's cheap upper bound, rounded up."""
        return F.ceil(n / F.lit(float(t))).cast("long")

    def minoverlap(self, a: Column, b: Column, t: float, slack: float = 0.0) -> Column:
        """Smallest overlap that reaches t, but never more than the smaller set has."""
        return F.least(a.cast("long"), b.cast("long"), ceil((a + b) * F.lit(float(t)) / F.lit(1 + float(t)), slack))

    def needed(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """minoverlap with slack, of numbers."""
        return np.minimum(np.minimum(a, b), np.ceil((a + b) * t / (1 + t) - SLACK))

    def value(self, overlap: Column, a: Column, b: Column) -> Column:
        return F.try_divide(overlap.cast("double"), (a + b - overlap).cast("double"))


class Dice(Prefixes):
    """2 o / (a + b)."""

    def size_ratio(self, t: float) -> float:
        return t / (2 - t)

    def minsize(self, n: Column, t: float, slack: float = 0.0) -> Column:
        return ceil(F.lit(t / (2 - t)) * n, slack)

    def maxsize(self, n: Column, t: float, slack: float = 0.0) -> Column:
        return F.floor(n * F.lit((2 - t) / t) + F.lit(slack)).cast("long")

    def minoverlap(self, a: Column, b: Column, t: float, slack: float = 0.0) -> Column:
        return F.least(a.cast("long"), b.cast("long"), ceil((a + b) * F.lit(t / 2), slack))

    def needed(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        return np.minimum(np.minimum(a, b), np.ceil((a + b) * (t / 2) - SLACK))

    def value(self, overlap: Column, a: Column, b: Column) -> Column:
        return F.try_divide(2 * overlap.cast("double"), (a + b).cast("double"))


class Cosine(Prefixes):
    """o / sqrt(a b)."""

    def size_ratio(self, t: float) -> float:
        return t * t

    def minsize(self, n: Column, t: float, slack: float = 0.0) -> Column:
        return ceil(F.lit(t * t) * n, slack)

    def maxsize(self, n: Column, t: float, slack: float = 0.0) -> Column:
        return F.floor(n / F.lit(t * t) + F.lit(slack)).cast("long")

    def minoverlap(self, a: Column, b: Column, t: float, slack: float = 0.0) -> Column:
        return F.least(a.cast("long"), b.cast("long"), ceil(F.sqrt((a * b).cast("double")) * F.lit(float(t)), slack))

    def needed(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        return np.minimum(np.minimum(a, b), np.ceil(np.sqrt((a * b).astype(float)) * t - SLACK))

    def value(self, overlap: Column, a: Column, b: Column) -> Column:
        return F.try_divide(overlap.cast("double"), F.sqrt((a * b).cast("double")))


JACCARD, DICE, COSINE = Jaccard(), Dice(), Cosine()
SIMILARITIES = {"jaccard": JACCARD, "dice": DICE, "cosine": COSINE}


def passes(overlap: Column, a: Column, b: Column, t: float, boundary: str = "ge", float32: bool = False, sim: Similarity = JACCARD) -> Column:
    """The final predicate. ge and gt compare the similarity; overlap asks for the bound in double and for both sizes."""
    if boundary == "overlap":
        sizes = (F.least(a, b) >= sim.minsize(F.greatest(a, b), t)) & (F.greatest(a, b) <= sim.maxsize(F.least(a, b), t, SLACK))
        return (overlap >= sim.minoverlap(a, b, t)) & sizes
    value, least = sim.value(overlap, a, b), F.lit(float(t))
    if float32:
        value, least = value.cast("float"), least.cast("float")
    if boundary not in ("ge", "gt"):
        raise ValueError(f"unknown boundary {boundary!r}")
    return value >= least if boundary == "ge" else value > least
