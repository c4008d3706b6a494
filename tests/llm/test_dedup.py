import hashlib
import random
import re
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from setweave.llm import near_dup, suffixes, tiles
from setweave.llm.common import Scratch, connected_components, prefix_hashes

RNG = random.Random(11)
VOCABULARY = [f"w{k}é" if k % 9 == 0 else f"W{k}" for k in range(400)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def varied(source, share):
    return " ".join(w if RNG.random() > share else RNG.choice(VOCABULARY) for w in source.split())


def corpus():
    base = text(120)
    out = [base, base, *(varied(base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(6))]
    passage = text(30)
    out += [f"{text(40)} {passage} {text(40)}" for _ in range(12)]
    out += [None, "", " \t\n", "one", "ONE", "one two three", "one two three", "a b c d e", text(6000), "x" * 500, "x" * 700]
    RNG.shuffle(out)
    return list(enumerate(out))


def smallest(ids, linked):
    up = {i: i for i in ids}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, j in linked:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def frame(spark, rows, column="text"):
    return spark.createDataFrame(rows, f"doc_id long, {column} string").withColumns({"id": F.lit(1), "n_shingles": F.lit("clash"), "component": F.lit(0)})


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 5)  # so that buckets are split into tiles
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = smallest(list(sets), linked)
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {r.id: (r.n_shingles, r.component) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert len(got) == len(rows)


def test_the_exact_setting_against_brute_force(spark):
    rows = corpus()
    want = {r.id: (r.n_shingles, r.component) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert {r.id: (r.n_shingles, r.component) for r in near_dup.near_duplicates(frame(spark, rows), exact=True).collect()} == want


def test_recall_of_links_at_the_threshold(spark):
    """Pairs just above it, each a group of its own: none is lost."""
    rows, k = [], 0
    for n in range(60, 260):
        w = [f"v{k + i}" for i in range(n)]
        k += n
        cut = (n - 4) // 4  # shared shingles over all: (n - 4 - cut) / (n - 4)
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w[: n - cut]))]
    got = {r.id: r.component for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert all(got[2 * n] == got[2 * n + 1] == 2 * n for n in range(60, 260))


def test_rows_with_null_and_repeated_ids(spark):
    one, two = text(60), text(60)
    rows = [(None, one), (7, one), (7, one), (5, two), (5, text(60)), (None, two + " w"), (None, text(60)), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component) for r in near_dup.near_duplicates(table).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (5, 5), (5, 5), (None, 5), (None, None), (None, None)], key=str)
    x, y = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    table = spark.createDataFrame([(None, x), (4, x), (4, x), (4, y), (None, y), (9, [1.0, 0.01, 0.1]), (None, None), (None, [5.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.id, r.n_links, r.component) for r in tiles.near_vectors(table).collect()), key=str)
    assert got == sorted([(None, 3, 4), (4, 3, 4), (4, 3, 4), (4, 1, 4), (None, 1, 4), (9, 3, 4), (None, 0, None), (None, 0, None)], key=str)
    line = "a passage that stands in several documents, of over fifty bytes"
    rows = [(None, line), (None, line + "!"), (3, "x" + line), (3, line), (8, line)]
    got = sorted(((r.doc_id, r.n_removed) for r in suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 63), (None, 63), (3, 0), (3, 0), (8, 63)], key=str)


def test_bound_holds_for_long_vectors():
    rng = np.random.default_rng(1)
    for d in (64, 1040, 4096):
        x = tiles.unit(np.concatenate([np.full((2, d), 1.0) + rng.normal(size=(2, d)) * 1e-3, np.sign(rng.normal(size=(6, d))), rng.normal(size=(6, d))]).tolist())
        q, step, error = tiles.quantised(x)
        exact = q.astype(np.int64) @ q.T.astype(np.int64)
        parts = sum(q[:, k : k + tiles.EXACT] @ q[:, k : k + tiles.EXACT].T.astype(np.float32) if k == 0 else (q[:, k : k + tiles.EXACT] @ q[:, k : k + tiles.EXACT].T).astype(np.float64) for k in range(0, d, tiles.EXACT))
        assert (parts == exact).all()
        off = np.abs(exact * step[:, None] * step - x @ x.T)
        assert (off <= error[:, None] + error + error[:, None] * error + tiles.slack(d)).all()
        got = {(int(a), int(b)) for i, j in tiles.tile_links(x, None, 0.9) for a, b in zip(i, j)}
        assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] >= 0.9}


def test_hot_anchors_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 900)
    rows = [*corpus(), *((1000 + k, f"{text(4)} the very same line stands here, in all of these documents {text(4)}") for k in range(60))]
    want = removed(rows)
    for hot in (2, 20):
        got = suffixes.repeated(frame(spark, rows), hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == want


def test_sketch_fills_every_bin_and_estimates():
    one = near_dup.sketches(np.array([5], np.uint64), np.array([0, 1]))
    assert (one < np.iinfo(np.uint64).max).all()
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    two = near_dup.sketches(np.concatenate([values[:900], values[100:]]), np.array([0, 900, 1800]))
    assert abs((two[0] == two[1]).mean() - 0.8) < 0.15


def removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [700, 1 << 22])
def test_repeats_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rows = corpus()
    got = suffixes.repeated(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == removed(rows)


def test_a_line_of_over_65535_equal_runs_in_one_document(spark):
    line = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=39)) + "\n"
    rows = [(1, f"{text(20)} {line}{line[:15]} {text(20)}"), (2, text(10) + line * 66_000), (3, text(30))]
    got = suffixes.repeated(frame(spark, rows)).collect()
    want = removed(rows)
    assert want[2][1] > 65_535 * 40
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == want


def test_suffix_order_is_that_of_the_bytes():
    rng = np.random.default_rng(7)
    buf = np.concatenate([rng.integers(97, 99, 400), np.full(200, 97), rng.integers(97, 99, 400)]).astype(np.uint8)
    at = rng.permutation(len(buf) - 50)
    order = suffixes.suffix_order(buf, prefix_hashes(buf), at)
    raw = buf.tobytes()
    assert [raw[i : i + 50] for i in at[order]] == sorted(raw[i : i + 50] for i in at)
    kind = suffixes.equal_classes(buf, prefix_hashes(buf), at)
    assert len(set(kind)) == len({raw[i : i + 50] for i in at})


@pytest.mark.parametrize("block", [4, 16])  # with pivots and without
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(k, [float(v) for v in base[k % 12] + rng.normal(size=16) * 0.2 * (k % 5)]) for k in range(70)]
    rows += [(70, None), (71, []), (72, [0.0] * 16), (73, [float("nan")] * 16), (74, [None] * 16), (75, rows[0][1]), (76, [3 * v for v in rows[1][1]]), (77, [1.0, 2.0]), (78, [2.0, 4.0]), (79, [float("inf")] * 16)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component int")
    good = {i: np.array(v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    close = [(i, j) for i in good for j in good if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9]
    want = smallest([i for i, _ in rows], close)
    got = {r.id: (r.n_links, r.component) for r in tiles.near_vectors(table).collect()}
    assert got == {i: (sum(i in p for p in close), want[i]) for i, _ in rows}


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert near_dup.near_duplicates(docs).count() == 0
    assert suffixes.repeated(docs).count() == 0
    assert tiles.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (60, 50)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges, Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 50: 50, 60: 50}


def test_messages_cost_no_calls_of_their_own():
    """Chunks times parts grow with the square of the input, so what Python does for a chunk must not grow with the parts."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(40)]
    texts += texts[:10] + ["ab" * 4000]  # an anchor with over 255 occurrences

    def told(tell, messages):
        out, names = {}, sorted(set(messages["part"].to_pylist()))
        for part in names:
            for r in tell(messages.filter(pa.compute.equal(messages["part"], part))).to_pylist():
                out.setdefault(r["chunk"], []).append(r["payload"])
        return out

    def counted(f):
        n = 0

        def see(frame, event, arg):
            nonlocal n
            n += event in ("call", "c_call")

        sys.setprofile(see)
        try:
            out = f()
        finally:
            sys.setprofile(None)
        return n, out

    def run(parts):
        docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
        (chunk,) = suffixes._pack([docs])
        n, asked = counted(lambda: pa.Table.from_batches(suffixes._ask_anchors(parts)([chunk])))
        row = chunk.to_pylist()[0] | {"anchors": told(suffixes._tell_anchors(50_000), asked)[0]}
        (state,) = suffixes._share([pa.RecordBatch.from_pylist([row])])
        row = state.to_pylist()[0] | {"windows": None}
        m, asked = counted(lambda: pa.Table.from_batches(suffixes._ask_texts(parts)([pa.RecordBatch.from_pylist([row])])))
        row["texts"] = told(suffixes._tell_texts, asked).get(0)
        (out,) = suffixes._remove(parts)([pa.RecordBatch.from_pylist([row])])
        return n, m, asked.num_rows, out.to_pydict()

    few, many = run(2), run(2000)
    assert few[3] == many[3] and sum(few[3]["n_removed"]) >= sum(map(len, texts[:10]))
    assert few[2] <= 2 and many[2] > 500
    assert many[0] < few[0] + 50 and many[1] < few[1] + 50


def test_bounds_are_only_computed_for_pairs_that_may_reach_them():
    rng = np.random.default_rng(5)
    x = tiles.unit(rng.normal(size=(4096, 64)))
    x[1000:1400] = tiles.unit(x[:400] + 0.06 * rng.normal(size=(400, 64)))
    cosines = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(cosines >= 0.9), strict=True) if i < j}
    del cosines
    tracemalloc.start()
    got = {(int(a), int(b)) for i, j in tiles.tile_links(x, None, 0.9) for a, b in zip(i, j, strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and len(want) > 100
    assert peak < 2.5 * 4 * tiles.STRIP * 4096  # one strip's products and marks, no table of bounds in double precision
