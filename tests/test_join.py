import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from setweave import __main__ as cli
from setweave.functions.bounds import COSINE, DICE, JACCARD
from setweave.operators import join, prepare
from setweave.plans import strategy as plans
from setweave.sources import text

FIXTURE = [
    [1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 5], [9], list(range(9, 19)), [], [],
    list(range(101, 120)), list(range(102, 121)), [7, 7, 8], [7, 8], [200, 264], [328, 392], [500, 501, 502],
]
EXPECTED = {
    (0.8, "ge"): {(0, 1), (0, 2), (1, 2), (2, 3), (8, 9), (10, 11)},
    (0.8, "gt"): {(0, 1), (8, 9), (10, 11)},
    (0.9, "ge"): {(0, 1), (8, 9), (10, 11)},
    (0.9, "gt"): {(0, 1), (10, 11)},
    (0.9, "overlap"): {(0, 1), (10, 11)},
    (0.6, "ge"): {(0, 1), (0, 2), (1, 2), (2, 3), (8, 9), (10, 11), (0, 3), (1, 3)},
}


def sets_of(spark, lists):
    rows = [(i, t) for i, ts in enumerate(lists) for t in set(ts)]
    raw = spark.createDataFrame(rows, "set_id long, token int")
    return prepare.encoded(raw).cache()


@pytest.mark.parametrize("strategy", join.STRATEGIES)
def test_fixture(spark, strategy):
    sets = sets_of(spark, FIXTURE)
    for (t, boundary), want in EXPECTED.items():
        got = join.self_join(sets, t, boundary, strategy).collect()
        assert {(r.x, r.y) for r in got} == want, (t, boundary)


def test_random_sets_all_strategies(spark):
    rng = random.Random(5)
    lists = []
    for _ in range(80):
        base = [int(rng.paretovariate(0.7)) % 60 for _ in range(rng.randrange(0, 25))]
        lists += [base, [v for v in base if rng.random() < 0.85]]
    sets, distinct = sets_of(spark, lists), [set(v) for v in lists]
    for t in (0.3, 0.55, 0.8, 1.0):
        want = {(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and a and b and Fraction(len(a & b), len(a | b)) >= Fraction(str(t))}
        for strategy in join.STRATEGIES:
            got = [(r.x, r.y) for r in join.self_join(sets, t, "ge", strategy).collect()]
            assert len(got) == len(set(got))
            assert set(got) == want, (t, strategy)


def test_binary_checks_both_sizes(spark):
    raw = spark.createDataFrame([(0, 1), *((1, k) for k in range(1, 11))], "set_id long, token int")
    terms = prepare.dictionary(raw)
    r, s = (prepare.encoded(raw.filter(F.col("set_id") == k), terms) for k in (0, 1))
    for strategy in join.STRATEGIES:
        assert join.binary_join(r, s, 0.8, "overlap", strategy).count() == 0
        assert join.binary_join(r, s, 0.1, "ge", strategy).count() == 1


def test_dictionary_is_dense_and_rarest_first(spark):
    raw = spark.createDataFrame([(i, f"w{j}") for i in range(20) for j in range(i + 1)], "set_id long, token string")
    rows = prepare.dictionary(raw).orderBy("term_id").collect()
    assert [r.term_id for r in rows] == list(range(20))
    assert [(r.df, r.token) for r in rows] == sorted((r.df, r.token) for r in rows)


def test_bad_arguments(spark):
    sets = sets_of(spark, FIXTURE)
    for kw in ({"t": 0}, {"t": 1.5}, {"t": 0.5, "strategy": "no"}, {"t": 0.5, "boundary": "no", "strategy": "naive"}, {"t": 0.5, "strategy": "bitmap", "bits": 0}):
        with pytest.raises(ValueError):
            join.self_join(sets, **kw)


def test_bounds_against_fractions(spark):
    n = F.col("id")
    for t in (0.5, 0.75, 0.8, 0.9):
        exact = Fraction(str(t))
        rows = spark.range(1, 300).select(n, JACCARD.minsize(n, t, 1e-9).alias("lo"), JACCARD.maxsize(n, t, 1e-9).alias("hi"), JACCARD.minoverlap(n, n, t, 1e-9).alias("o")).collect()
        for r in rows:
            assert r.lo == -(-exact * r.id // 1) and r.hi == r.id / exact // 1
            assert r.o == min(r.id, -(-(2 * r.id * exact / (1 + exact)) // 1))


def test_text_lines(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("1 2 2\n\n 3\t4x\n5  6 \n")
    got = {r.set_id: r.tokens for r in text.read_sets(spark, str(path)).collect()}
    assert got == {0: [1, 2], 1: [], 2: [3, 4], 3: [5, 6]}
    got = {r.set_id: r.tokens for r in text.read_sets(spark, str(path), "single_space").collect()}
    assert got == {0: [1, 2], 1: [0, 3], 2: [5, 0, 6]}
    pairs = spark.createDataFrame([(1, 2, 3, 0.75)], "x long, y long, overlap long, sim double")
    text.write_pairs(pairs, str(tmp_path / "out"), "plain")
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "2 1"
    assert text.pair_lines(pairs).first()[0] == "(1, 2): 0.75"


def test_hashed_sets_are_in_one_order_for_all(spark, monkeypatch):
    raw = spark.createDataFrame([(i, f"w{j}") for i in range(20) for j in range(i + 1)] + [(3, "w0")], "set_id long, token string")
    other = spark.createDataFrame([(k, f"w{k % 7}") for k in range(30)], "set_id long, token string")
    one, two = prepare.hashed(raw, other)
    df = {f"w{j}": sum(j <= i for i in range(20)) + (j == 0) + sum(k % 7 == j for k in range(30)) for j in range(20)}
    names = {r.h: r.token for r in raw.select("token", F.xxhash64("token").alias("h")).distinct().collect()}
    for r in [*one.collect(), *two.collect()]:
        words = [names[h] for h in r.terms]
        assert r.n == len(set(words)) == len(words) and [df[w] for w in words] == sorted(df[w] for w in words)
    assert {r.set_id: r.n for r in one.collect()} == {i: i + 1 for i in range(20)}


def test_tokens_that_share_a_hash_are_told_apart(spark, monkeypatch):
    real = F.xxhash64

    def weak(*columns):
        """7 hashes of a token, which stay shared whatever follows the token, and 5 from the first other seed."""
        if isinstance(columns[0], str):
            return real(F.pmod(real(columns[0]), F.lit(7)), *columns[1:])
        return F.pmod(real(*columns), F.lit(5)) if str(columns[0]) == str(F.lit(1)) else real(*columns)

    monkeypatch.setattr(prepare.F, "xxhash64", weak)
    raw = spark.createDataFrame([(i, f"w{j}") for i in range(12) for j in range(i + 1)], "set_id long, token string")
    sets = {r.set_id: r.terms for r in prepare.hashed(raw)[0].collect()}
    assert {k: len(set(t)) for k, t in sets.items()} == {i: i + 1 for i in range(12)}
    assert all(set(sets[i]) < set(sets[i + 1]) for i in range(11))


@pytest.mark.parametrize(("sim", "value"), [(DICE, lambda o, a, b: Fraction(2 * o, a + b)), (COSINE, lambda o, a, b: (Fraction(o * o, a * b)))])
def test_other_similarities_all_strategies(spark, sim, value):
    rng = random.Random(8)
    lists = []
    for _ in range(60):
        base = [int(rng.paretovariate(0.7)) % 60 for _ in range(rng.randrange(0, 25))]
        lists += [base, [v for v in base if rng.random() < 0.85]]
    sets, distinct = sets_of(spark, lists), [set(v) for v in lists]
    for t in (0.55, 0.8):
        least = Fraction(str(t)) ** (2 if sim is COSINE else 1)
        want = {(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and a and b and value(len(a & b), len(a), len(b)) >= least}
        for strategy in join.STRATEGIES:
            assert {(r.x, r.y) for r in join.self_join(sets, t, "ge", strategy, sim=sim).collect()} == want, (t, strategy)


def test_a_similarity_of_ones_own(spark):
    class Overlap:
        """o / larger size, with nothing but what the protocol asks for."""

        size_ratio = staticmethod(lambda t: t)
        minsize = staticmethod(lambda n, t, slack=0.0: JACCARD.minsize(n, t, slack))
        maxsize = staticmethod(lambda n, t, slack=0.0: JACCARD.maxsize(n, t, slack))
        minoverlap = staticmethod(lambda a, b, t, slack=0.0: F.ceil(F.greatest(a, b) * F.lit(t) - F.lit(slack)).cast("long"))
        maxprefix = staticmethod(lambda n, t, slack=0.0: JACCARD.maxprefix(n, t, slack))
        midprefix = staticmethod(lambda n, t, slack=0.0: JACCARD.maxprefix(n, t, slack))
        value = staticmethod(lambda o, a, b: o / F.greatest(a, b))

    sets, distinct = sets_of(spark, FIXTURE), [set(v) for v in FIXTURE]
    want = {(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct) if i < j and a and b and Fraction(len(a & b), max(len(a), len(b))) >= Fraction(3, 4)}
    for strategy in join.STRATEGIES:
        assert {(r.x, r.y) for r in join.self_join(sets, 0.75, "ge", strategy, sim=Overlap()).collect()} == want, strategy


def test_hot_keys_are_dealt_to_parts_and_every_pair_meets_once(spark):
    rows = [(i, 0 if i % 3 else i % 5 + 1) for i in range(90)]
    table = spark.createDataFrame(rows, "set_id long, key int")
    x, y = (table.withColumnRenamed("set_id", f"set_id_{s}") for s in "xy")
    for block in (7, 1000):
        got = [(r.set_id_x, r.set_id_y) for r in join.met(x, y, "key", F.col("set_id_x") < F.col("set_id_y"), block).collect()]
        assert sorted(got) == [(i, j) for i, a in rows for j, b in rows if i < j and a == b]


def test_auto_counts_both_sides(spark):
    raw = spark.createDataFrame([(i, t) for i in range(50) for t in (1, 2)], "set_id long, token int")
    few = spark.createDataFrame([(0, 1)], "set_id long, token int")
    (left, right), alone = prepare.hashed(few, raw), prepare.hashed(raw)[0]
    assert plans.posting_pairs(prepare.entries(left), prepare.entries(right)) == 50
    assert plans.posting_pairs(prepare.entries(alone)) == 50 * 49
    assert join.binary_join(left, right, 0.5).count() == 50


def test_bitmap_candidates_against_the_bound(spark):
    sets = prepare.hashed(spark.createDataFrame([(i, t) for i, ts in enumerate(FIXTURE) for t in set(ts)], "set_id long, token int"))[0]
    linked = {(r.x, r.y) for r in join.self_join(sets, 0.6, strategy="naive").collect()}
    found = {(min(r.set_id_x, r.set_id_y), max(r.set_id_x, r.set_id_y)) for r in join.bitmap_candidates(sets, None, 0.6).collect()}
    assert linked <= found and (12, 13) in found


def test_long_tokens_are_cut_and_empty_tables_stay_empty(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("a" * 9000 + " b\n")
    assert [len(t) for t in text.read_sets(spark, str(path), numeric=False).first().tokens] == [text.MAX_TOKEN, 1]
    raw = spark.createDataFrame([], "set_id long, token string")
    sets = prepare.hashed(raw)[0]
    for strategy in (*join.STRATEGIES, "auto"):
        assert join.self_join(sets, 0.8, strategy=strategy).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a a b"), (3, "b c")], "id long, t string")
    assert [(r.set_id, r.n) for r in prepare.hashed(prepare.text_sets(docs, "id", "t"))[0].collect()] == [(3, 3)]


def test_command_line(spark, tmp_path, capsys):
    path, other = tmp_path / "in.txt", tmp_path / "other.txt"
    path.write_text("\n".join(" ".join(map(str, ts)) for ts in FIXTURE) + "\n")
    other.write_text("1 2 3 4\n9\n")
    out = lambda *more: cli.run(spark, cli.arguments([str(path), "--threshold", "0.8", *more]))
    for strategy in ("auto", *join.STRATEGIES):
        lines = out("--strategy", strategy)
        assert lines[0] == "Result: 6" and lines[1].startswith("Candidates: ") and lines[-1].startswith("Runtime: ")
        assert [x.split(":")[0] for x in lines[2:-1]] == ["read", "prepare", "candidates", "verify"]
    count, seconds = out("--csv")[0].split(",")
    assert count == "6" and float(seconds) > 0
    assert out("--count", "--similarity", "cosine", "--threshold", "0.7")[0] == "Result: 8"
    for layout, want in (("plain", "1 0"), ("scored", "(0, 1): 1.0")):
        out("--output", str(tmp_path / layout), "--layout", layout)
        assert want in [r.value for r in spark.read.text(str(tmp_path / layout)).collect()]
    out("--output", str(tmp_path / "plain"), "--layout", "parquet")  # what was there is replaced
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 6
    assert out("--foreign-input", str(other), "--output", str(tmp_path / "two"))[0] == "Result: 4"
    cli.main([str(path), "--csv"])
    assert capsys.readouterr().out.startswith("2,")


def test_tables_written_on_the_way_are_removed(spark):
    import os

    from setweave.plans import stage

    with stage.released():
        sets = prepare.hashed(spark.createDataFrame([(1, "a")], "set_id long, token string"))[0]
        path = sets.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
