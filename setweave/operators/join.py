"""Exact set-similarity joins: self and binary, by four strategies that give the same answer.

All take sets (set_id, n, terms) with distinct terms in one order for all sets; empty sets match nothing. Set ids must name
the sets (encoding sees to it: rows of one id are one set); null ids are left out there. Empty tables give empty results, sets
that repeat under several ids link with each other, and pairs exactly at the threshold belong to `ge` and `overlap`.
"""

from __future__ import annotations

import math
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setweave.functions.bounds import JACCARD, SLACK, Similarity, passes
from setweave.functions.signature import hamming, overlap_bound, signatures
from setweave.operators import blocks, dense
from setweave.operators.prepare import entries
from setweave.plans.stage import materialised
from setweave.plans.strategy import Timings, choose

STRATEGIES = ("naive", "size", "prefix", "bitmap")
#: Rows of one key that meet in one task; more are dealt to several.
BLOCK = 2000
#: Elements that sets have on average, from which on a self-join goes block against block.
LARGE = 32
#: Pairs of postings for each pair of sets, from which on overlaps go block against block.
DENSE = 1 / 16


def _sides(left: DataFrame, right: DataFrame, binary: bool) -> tuple[DataFrame, DataFrame]:
    name = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    return name(left, "x"), name(right, "y")


def _oriented(binary: bool) -> Column:
    """Each unordered pair once, the smaller set (then id) on the left; all pairs of a binary join."""
    x, y = F.struct("n_x", "set_id_x"), F.struct("n_y", "set_id_y")
    return F.lit(True) if binary else x < y


def met(x: DataFrame, y: DataFrame, key: str, on: Column, block: int = BLOCK) -> DataFrame:
    """x (key, set_id_x, ...) and y (key, set_id_y, ...) joined on key and the condition.

    The rows of a key with over `block` of them are dealt to parts, and each pair of parts is a key of its own, so that the pairs
    of a hot key are spread. Every pair of rows still meets once.
    """
    many = lambda df, name: df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > block).select(key, F.ceil(F.col("n") / block).cast("int").alias(name))
    hot = materialised(many(x, "parts_x").join(many(y, "parts_y"), key, "full"))
    if hot.isEmpty():
        return x.join(y, key).filter(on).drop(key)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(hot, key, "left")
        df = df.withColumn(own, F.coalesce(F.pmod(F.xxhash64(f"set_id_{own}"), F.col(f"parts_{own}")).cast("int"), F.lit(0)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"parts_{other}", F.lit(1)) - 1))).drop("parts_x", "parts_y")

    return dealt(x, "x", "y").join(dealt(y, "y", "x"), [key, "x", "y"]).filter(on).drop(key, "x", "y")


def _size_ok(t: float, sim: Similarity) -> Column:
    small, large = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
    return (small >= sim.minsize(large, t, SLACK)) & (large <= sim.maxsize(small, t, SLACK))


def _meet_anyway(sets: DataFrame) -> bool:
    """Whether pairs of postings are about as many as pairs of sets, so that most sets meet."""
    pairs = entries(sets).groupBy("term_id").agg(F.count("*").cast("double").alias("df")).agg(F.sum(F.col("df") * (F.col("df") - 1))).first()[0] or 0
    n = sets.count()
    return pairs >= DENSE * n * (n - 1) > 0


def overlaps(left: DataFrame, right: DataFrame | None = None, t: float | None = None, sim: Similarity = JACCARD) -> DataFrame:
    """(set_id_x, set_id_y, n_x, n_y, overlap) of sets with a common term; t: only of sizes that may reach it."""
    binary = right is not None
    if not binary and t is None and _meet_anyway(left):
        return dense.overlaps(left)
    keep = ["set_id", "n", "term_id"]
    x, y = _sides(entries(left).select(keep), entries(right if binary else left).select(keep), binary)
    on = F.lit(True) if binary else F.col("set_id_x") < F.col("set_id_y")
    if t is not None:
        on &= _size_ok(t, sim)
    pairs = met(x.withColumnRenamed("term_id_x", "term"), y.withColumnRenamed("term_id_y", "term"), "term", on)
    return pairs.groupBy("set_id_x", "set_id_y", "n_x", "n_y").agg(F.count("*").alias("overlap"))


def prefix_candidates(left: DataFrame, right: DataFrame | None, t: float, sim: Similarity = JACCARD) -> DataFrame:
    """(set_id_x, set_id_y, n_x, n_y): pairs with a common term in both prefixes that position and size still allow.

    Common terms come in one order in both sets, so all before the last one found in the prefixes are counted; what
    may follow it is bounded by what is left of the shorter rest.
    """
    binary = right is not None
    jac = sim
    probe = lambda s: entries(s).filter(F.col("pos") < jac.maxprefix(F.col("n"), t, SLACK))
    a = probe(left)
    index = a if binary else a.filter(F.col("pos") < jac.midprefix(F.col("n"), t, SLACK))
    x, y = _sides(index, probe(right) if binary else a, binary)
    met = x.join(y, (F.col("term_id_x") == F.col("term_id_y")) & _oriented(binary) & _size_ok(t, sim))
    met = met.groupBy("set_id_x", "set_id_y", "n_x", "n_y").agg(F.count("*").alias("c"), F.max("pos_x").alias("px"), F.max("pos_y").alias("py"))
    most = F.col("c") + F.least(F.col("n_x") - 1 - F.col("px"), F.col("n_y") - 1 - F.col("py"))
    return met.filter(most >= sim.minoverlap(F.col("n_x"), F.col("n_y"), t, SLACK)).select("set_id_x", "set_id_y", "n_x", "n_y")


def with_band(sets: DataFrame, t: float, sim: Similarity = JACCARD) -> DataFrame:
    """band: sizes whose ratio may reach t lie in the same or in neighbouring bands."""
    ratio = sim.size_ratio(t)
    band = F.col("n").cast("int") if ratio >= 1 else F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / ratio)) + F.lit(1e-9)).cast("int")
    return sets.withColumn("band", band)


def bitmap_candidates(left: DataFrame, right: DataFrame | None, t: float, bits: int = 64, sim: Similarity = JACCARD) -> DataFrame:
    """(set_id_x, set_id_y, n_x, n_y): all pairs of neighbouring size bands whose parity bitmaps allow the overlap."""
    binary = right is not None
    if not binary and hasattr(sim, "needed"):
        return dense.bitmap_pairs(signatures(entries(left), bits), t, bits, sim)
    signed = lambda s: with_band(signatures(entries(s), bits), t, sim)
    x, y = _sides(signed(left), signed(right if binary else left), binary)
    near = [-1, 0, 1] if sim.size_ratio(t) < 1 else [0]
    x = x.withColumnRenamed("band_x", "band")
    y = y.withColumn("band", F.explode(F.array(*[F.col("band_y") + k for k in near]))).drop("band_y")
    bound = overlap_bound(F.col("n_x"), F.col("n_y"), hamming(F.col("sig_x"), F.col("sig_y"), bits))
    on = _oriented(binary) & _size_ok(t, sim) & (bound >= sim.minoverlap(F.col("n_x"), F.col("n_y"), t, SLACK))
    return met(x, y, "band", on).select("set_id_x", "set_id_y", "n_x", "n_y")


def bitmap_filtered(pairs: DataFrame, left: DataFrame, right: DataFrame | None, t: float, bits: int = 64, sim: Similarity = JACCARD) -> DataFrame:
    """Those of the pairs whose parity bitmaps allow the overlap; only bitmaps travel, not the sets."""
    signed = [signatures(entries(s), bits).select("set_id", "sig") for s in (left, left if right is None else right)]
    for s, side in zip(signed, "xy", strict=True):
        pairs = pairs.join(s.select(F.col("set_id").alias(f"set_id_{side}"), F.col("sig").alias(f"sig_{side}")), f"set_id_{side}")
    bound = overlap_bound(F.col("n_x"), F.col("n_y"), hamming(F.col("sig_x"), F.col("sig_y"), bits))
    return pairs.filter(bound >= sim.minoverlap(F.col("n_x"), F.col("n_y"), t, SLACK)).select("set_id_x", "set_id_y", "n_x", "n_y")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """pairs with their overlap: the terms are joined to the candidates, so nothing else is intersected."""
    right = left if right is None else right
    a = left.select(F.col("set_id").alias("set_id_x"), F.col("terms").alias("terms_x"))
    b = right.select(F.col("set_id").alias("set_id_y"), F.col("terms").alias("terms_y"))
    both = pairs.join(a, "set_id_x").join(b, "set_id_y")
    return both.withColumn("overlap", F.size(F.array_intersect("terms_x", "terms_y")).cast("long")).drop("terms_x", "terms_y")


def _large(sets: DataFrame, sim: Similarity) -> int:
    """The elements of sets, if their self-join goes block against block."""
    many, elements = sets.agg(F.count("*"), F.sum("n")).first() if hasattr(sim, "needed") else (0, 0)
    return elements if many and elements >= LARGE * many else 0


def candidates_of(left: DataFrame, right: DataFrame | None, t: float, strategy: str, bits: int = 64, sim: Similarity = JACCARD) -> DataFrame:
    """Pairs that may reach t; with their overlap already, where the strategy counts it."""
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if strategy == "auto":
        strategy = choose(entries(left), None if right is None else entries(right))
    if right is None and strategy in STRATEGIES and (elements := _large(left, sim)):
        return blocks.found(left, elements, t, sim)
    if strategy in ("naive", "size"):
        return overlaps(left, right, t if strategy == "size" else None, sim)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    pairs = prefix_candidates(left, right, t, sim)
    return pairs if strategy == "prefix" else bitmap_filtered(pairs, left, right, t, bits, sim)


def _join(left, right, t, boundary, strategy, bits, float32, sim, timings=None):
    phase = timings.phase if timings else lambda name: nullcontext()
    with phase("candidates"):
        found = candidates_of(left, right, t, strategy, bits, sim)
        if timings:
            found = materialised(found)
            timings.candidates = found.count()
    if "overlap" not in found.columns:
        found = verified(found, left, right)
    o, a, b = F.col("overlap"), F.col("n_x"), F.col("n_y")
    return found.filter(passes(o, a, b, t, boundary, float32, sim)).withColumn("sim", sim.value(o, a, b))


def self_join(sets: DataFrame, t: float, boundary: str = "ge", strategy: str = "auto", bits: int = 64, float32: bool = False, sim: Similarity = JACCARD, timings: Timings | None = None) -> DataFrame:
    """(x, y, overlap, sim) with x < y, each unordered pair once.

    With timings, candidates are written and counted first, so that their time is told from verification.
    """
    out = _join(sets, None, t, boundary, strategy, bits, float32, sim, timings)
    return out.select(F.least("set_id_x", "set_id_y").alias("x"), F.greatest("set_id_x", "set_id_y").alias("y"), "overlap", "sim")


def binary_join(r: DataFrame, s: DataFrame, t: float, boundary: str = "ge", strategy: str = "auto", bits: int = 64, float32: bool = False, sim: Similarity = JACCARD, timings: Timings | None = None) -> DataFrame:
    """(r_id, s_id, overlap, sim); both sides must be encoded with one dictionary."""
    out = _join(r, s, t, boundary, strategy, bits, float32, sim, timings)
    return out.select(F.col("set_id_x").alias("r_id"), F.col("set_id_y").alias("s_id"), "overlap", "sim")


def count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"))


def partners(sets: DataFrame, t: float, boundary: str = "ge", strategy: str = "auto", bits: int = 64, float32: bool = False, sim: Similarity = JACCARD) -> DataFrame:
    """(set_id) of the sets in a self-join's pairs, once each; of large sets the pairs aren't listed for it."""
    if 0 < t <= 1 and strategy in ("auto", *STRATEGIES) and (elements := _large(sets, sim)):
        found = blocks.found(sets, elements, t, sim, pairs=False)
        found = found.filter(passes(F.col("overlap"), F.col("n_x"), F.col("n_y"), t, boundary, float32, sim))
        return found.select("set_id").distinct()
    pairs = self_join(sets, t, boundary, strategy, bits, float32, sim)
    return pairs.select(F.explode(F.array("x", "y")).alias("set_id")).distinct()


def matched(sets: DataFrame, partnered: DataFrame, anti: bool = False) -> DataFrame:
    """The sets (set_id, ...) that are among the partnered, or the others. Both are shuffled: the ids are as many as sets, so none are sent to the driver."""
    return sets.join(partnered.hint("merge"), "set_id", "left_anti" if anti else "left_semi")
