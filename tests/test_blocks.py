import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from setweave.functions.bounds import COSINE, DICE, JACCARD
from setweave.operators import blocks, join, prepare


def lists_of(seed, words=300):
    """Sets of 0 to 90 elements, near copies, and copies under many ids."""
    rng, lists = random.Random(seed), []
    for _ in range(25):
        base = [min(int(rng.paretovariate(0.5)), words) for _ in range(rng.randrange(0, 120))] + rng.sample(range(1000, 9000), rng.randrange(40))
        lists += [base, [v for v in base if rng.random() < 0.9], [v for v in base if rng.random() < 0.75]]
    return lists + [lists[0], lists[3], lists[3], []]


VALUES = [(JACCARD, 1, lambda o, a, b: Fraction(o, a + b - o)), (DICE, 1, lambda o, a, b: Fraction(2 * o, a + b)), (COSINE, 2, lambda o, a, b: Fraction(o * o, a * b))]


@pytest.mark.parametrize(("sim", "power", "value"), VALUES)
@pytest.mark.parametrize("elements", [1, 1 << 30])
def test_blocks_against_brute_force(spark, monkeypatch, sim, power, value, elements):
    monkeypatch.setattr(blocks, "BLOCK", 1 << 20)
    distinct = [set(v) for v in lists_of(7)]
    rows = spark.createDataFrame([(i, [str(t) for t in v]) for i, v in enumerate(distinct)], "set_id long, tokens array<string>")
    sets = prepare.hashed_rows(rows).cache()
    for t in (0.5, 0.8, 1.0):
        want = {(i, j): len(a & b) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and a and b and value(len(a & b), len(a), len(b)) >= Fraction(str(t)) ** power}
        found = blocks.found(sets, min(elements, 9 << 20), t, sim)
        got = [((min(r.set_id_x, r.set_id_y), max(r.set_id_x, r.set_id_y)), r.overlap) for r in found.collect()]
        assert len(got) == len({k for k, _ in got})
        assert {k: o for k, o in got if value(o, len(distinct[k[0]]), len(distinct[k[1]])) >= Fraction(str(t)) ** power} == want


@pytest.mark.parametrize("strategy", join.STRATEGIES)
def test_joins_of_large_sets_shuffle_no_postings_or_candidates(spark, strategy):
    rows = spark.createDataFrame([(i, [f"w{k}" for k in range(i, i + 50)]) for i in range(40)], "set_id long, tokens array<string>")
    pairs = join.self_join(prepare.hashed_rows(rows), 0.8, strategy=strategy)
    assert "Exchange" not in pairs._jdf.queryExecution().toString()
    assert {(r.x, r.y) for r in pairs.collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40) if (50 - j + i) / (50 + j - i) >= 0.8}


def test_rows_of_one_id_are_one_set_and_shared_hashes_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a a b"), (3, "b c"), (4, " ")], "id long, t string")
    assert [(r.set_id, r.n) for r in prepare.hashed_rows(prepare.text_rows(docs, "id", "t")).collect()] == [(3, 3)]
    real = F.xxhash64

    def weak(*columns):
        return real(F.pmod(real(*columns), F.lit(7))) if len(columns) == 1 else real(*columns)

    monkeypatch.setattr(prepare.F, "xxhash64", weak)
    rows = spark.createDataFrame([(i, [f"w{j}" for j in range(i + 1)]) for i in range(12)], "set_id long, tokens array<string>")
    sets = {r.set_id: r.terms for r in prepare.hashed_rows(rows).collect()}
    assert {k: len(set(t)) for k, t in sets.items()} == {i: i + 1 for i in range(12)}
    assert all(set(sets[i]) < set(sets[i + 1]) for i in range(11))


@pytest.mark.parametrize(("sim", "bits"), [(JACCARD, 64), (JACCARD, 130), (DICE, 64), (COSINE, 64)])
def test_bitmap_candidates_go_block_against_block(spark, sim, bits):
    """Every pair that the sizes and bitmaps allow and no other, without sending a row once for each part of the other side."""
    lists = {k: sorted(set(v)) for k, v in enumerate(lists_of(3, 200)) if v}
    sets = spark.createDataFrame([(k, len(v), v) for k, v in lists.items()], "set_id long, n long, terms array<long>")
    width, t = -(-bits // 64) * 64, 0.6

    def bitmap(terms):
        out = 0
        for v in terms:
            out ^= 1 << v % width
        return out

    order = sorted(lists, key=lambda k: (len(lists[k]), k))
    reach = {r.n: r.hi for r in sets.select("n", sim.maxsize(F.col("n"), t, 1e-9).cast("long").alias("hi")).distinct().collect()}
    want = set()
    for i, x in enumerate(order):
        for y in order[i + 1 :]:
            a, b = len(lists[x]), len(lists[y])
            most = (a + b - (bitmap(lists[x]) ^ bitmap(lists[y])).bit_count()) / 2
            if b <= reach[a] and most >= sim.needed(np.int64(a), np.int64(b), t):
                want.add((x, y, a, b))
    found = join.bitmap_candidates(sets, None, t, bits, sim)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("words", [8, 3000])
def test_overlaps_of_most_pairs_go_block_against_block(spark, words):
    """By products of few terms and by postings of many; sparse sets still meet by their terms."""
    rng = random.Random(words)
    lists = {k * 7 % 211: {rng.randrange(words) for _ in range(rng.randrange(1, 2 + words // 8))} | ({0} if k % 5 else set()) for k in range(200)}
    sets = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in lists.items()], "set_id long, n long, terms array<long>")
    found = join.overlaps(sets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "HashAggregate" not in plan
    want = {(x, y, len(lists[x]), len(lists[y]), len(lists[x] & lists[y])) for x in lists for y in lists if x < y and lists[x] & lists[y]}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    alone = spark.createDataFrame([(k, 1, [k // 2]) for k in range(100)], "set_id long, n long, terms array<long>")
    pairs = join.overlaps(alone)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.count() == 50


def test_many_blocks_share_few_files_and_are_not_read_for_each_other_one(spark, monkeypatch):
    """each block was a file of its own, read and decoded for every other one."""
    tasks, real = [], blocks.materialised
    monkeypatch.setattr(blocks, "materialised", lambda df, *a, **k: tasks.append(df.rdd.getNumPartitions()) or real(df, *a, **k))
    monkeypatch.setattr(blocks, "BLOCK", 64)
    distinct = [set(v) for v in lists_of(5) if v]
    rows = spark.createDataFrame([(i, [str(t) for t in v]) for i, v in enumerate(distinct)], "set_id long, tokens array<string>")
    found = blocks.found(prepare.hashed_rows(rows).cache(), 30 * 64, 0.5, JACCARD)
    assert tasks[-1] <= blocks.FILES**2
    got = {(min(r.set_id_x, r.set_id_y), max(r.set_id_x, r.set_id_y)) for r in found.collect() if 2 * r.overlap >= r.n_x + r.n_y - r.overlap}
    assert got == {(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and 2 * len(a & b) >= len(a | b)}


@pytest.mark.parametrize("anti", [False, True])
@pytest.mark.parametrize("each", [40, 4])
def test_matched_sets_send_no_ids_to_the_driver_and_list_no_pairs_of_copies(spark, monkeypatch, anti, each):
    """the ids of all pairs were broadcast, twice for each pair."""
    written, real = [], blocks.materialised
    monkeypatch.setattr(blocks, "materialised", lambda df, *a, **k: written.append(real(df, *a, **k)) or written[-1])
    sizes = [i % 7 if i < 60 else i for i in range(90)]  # 60 copies of 7 sets, and near and far ones
    lists = {i: {f"w{k}" for k in range(3 * s, 3 * s + each + s % 3)} for i, s in enumerate(sizes)}
    rows = spark.createDataFrame([(i, list(v)) for i, v in lists.items()], "set_id long, tokens array<string>")
    sets = prepare.hashed_rows(rows)
    out = join.matched(sets.select("set_id", "n"), join.partners(sets, 0.8, strategy="prefix"), anti)
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftAnti" in line or "LeftSemi" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    with_partner = {i for i, a in lists.items() if any(j != i and 5 * len(a & b) >= 4 * len(a | b) for j, b in lists.items())}
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, len(v)) for i, v in lists.items() if (i in with_partner) != anti)
    if each == 40:
        assert written[-1].columns[0] == "set_id" and written[-1].count() < 10 * len(lists)
