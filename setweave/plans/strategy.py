"""Choosing a strategy from the terms' frequencies, and timing the phases of a join."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of postings up to which the plain inverted-index join is the cheapest.
NAIVE_PAIRS = 2_000_000


def posting_pairs(left: DataFrame, right: DataFrame | None = None) -> int:
    """Pairs of entries with a common term, within left or between the two sides."""
    df = left.groupBy("term_id").agg(F.count("*").alias("df"))
    if right is None:
        pairs = F.col("df") * (F.col("df") - 1) / 2
    else:
        df = df.join(right.groupBy("term_id").agg(F.count("*").alias("df_right")), "term_id")
        pairs = F.col("df") * F.col("df_right")
    return int(df.agg(F.sum(pairs.cast("double"))).first()[0] or 0)


def choose(left: DataFrame, right: DataFrame | None = None) -> str:
    return "naive" if posting_pairs(left, right) <= NAIVE_PAIRS else "prefix"


class Timings:
    """Wall seconds by phase, and the number of candidates."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.candidates = 0

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
