"""python -m setweave INPUT [--foreign-input FILE] [--threshold T] [--strategy S] [--output DIR | --count | --csv]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from setweave.functions.bounds import SIMILARITIES
from setweave.operators import join, prepare
from setweave.plans.stage import materialised, released
from setweave.plans.strategy import Timings
from setweave.sources import text


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="setweave")
    p.add_argument("input")
    p.add_argument("--foreign-input")
    p.add_argument("--threshold", type=float, default=0.95)
    p.add_argument("--similarity", default="jaccard", choices=list(SIMILARITIES))
    p.add_argument("--strategy", default="auto", choices=["auto", *join.STRATEGIES])
    p.add_argument("--boundary", default="ge", choices=["ge", "gt", "overlap"])
    p.add_argument("--bitmap", type=int, default=64)
    p.add_argument("--dialect", default="whitespace", choices=["whitespace", "single_space"])
    p.add_argument("--layout", default="scored", choices=["scored", "plain", "parquet"])
    p.add_argument("--output", help="a folder for the pairs")
    p.add_argument("--count", action="store_true", help="only count the pairs")
    p.add_argument("--csv", action="store_true", help="print nothing but count,seconds")
    return p.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Joins the files and returns the lines to print: result, candidates, seconds by phase (reading apart) and in all."""
    timings = Timings()
    with released():
        with timings.phase("read"):
            raw = [materialised(text.exploded(text.read_sets(spark, f, a.dialect))) for f in (a.input, a.foreign_input) if f]
        with timings.phase("prepare"):
            sets = prepare.hashed(*raw)
        kw = {"boundary": a.boundary, "strategy": a.strategy, "bits": a.bitmap, "sim": SIMILARITIES[a.similarity], "timings": timings}
        pairs = join.self_join(sets[0], a.threshold, **kw) if len(sets) == 1 else join.binary_join(*sets, a.threshold, **kw)
        with timings.phase("verify"):
            pairs = materialised(pairs)
            n = pairs.count()
        if a.output and not a.count:
            with timings.phase("write"):
                text.write_pairs(pairs if len(sets) == 1 else pairs.withColumnsRenamed({"r_id": "x", "s_id": "y"}), a.output, a.layout)
    spent = sum(s for name, s in timings.seconds.items() if name not in ("read", "write"))
    if a.csv:
        return [f"{n},{spent:.3f}"]
    return [f"Result: {n}", f"Candidates: {timings.candidates}", *(f"{name}: {s:.3f} secs" for name, s in timings.seconds.items()), f"Runtime: {spent:.3f} secs"]


def main(argv: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("setweave").getOrCreate()
    print("\n".join(run(spark, arguments(argv))))


if __name__ == "__main__":
    main()
