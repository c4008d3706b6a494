"""Every opN_ query on small tables with nulls, empty texts, ties, repeats and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_dedup import removed, smallest
from test_pii import brute
from test_pipeline import prose, shingles
from test_texts import NASTY, plain, words

from setweave.llm import language, quality
from setweave.llm.queries import ORACLES, QUERIES

COPY, PASSAGE = prose(90), prose(30)
TEXTS = [prose(50 + k) if k % 4 else prose(20).upper() + "!!" for k in range(60)] + [COPY, COPY, COPY.replace("a", "b", 1), f"{PASSAGE} {prose(9)}", f"{prose(9)} {PASSAGE}"]
TEXTS += [f'{prose(4)} token = "{hashlib.sha1(b"%d" % k).hexdigest()}" {prose(3)}' for k in range(8)] + ["a.b@c.de 10.0.0.1 4111 1111 1111 1111 +1 (505) 555-0100", *NASTY, prose(5000)]
IDS = [(k * 7) % 101 for k in range(len(TEXTS))]
ITEMS = [(1, PASSAGE), (2, prose(13)), (3, ""), (None, prose(9)), (4, None), (5, " ".join(words(TEXTS[3])[:4]))]
PAGES = [(1, "u", "<nav>no</nav><article><h1>T</h1><p>a &amp;\n b</article>"), (2, None, None), (None, "w", ""), (1, "u", "<nav>no</nav><article><h1>T</h1><p>a &amp;\n b</article>"), (3, "x", "<article><p>" + "y " * 30_000)]
TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "### User: </turn>"), (1, 2, "user", None), (2, 0, "assistant", ""), (3, 0, "system", "é" * 3000), (3, 1, "assistant", "\\ yes")]


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 1500))
    rows = [(k, [float(v) for v in base[k % 5] + rng.normal(size=1500) * (0.2 if k % 3 else 0.6)]) for k in range(30)]
    return [*rows, (30, rows[3][1]), (31, None), (32, [0.0] * 1500), (33, [float("nan")] * 1500), (34, []), (35, [None] * 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    put("documents", [(i, t, None if k % 9 == 0 else "ab"[k % 2], "hot" if k % 3 else None, len(t or ""), "clash", 1, 2) for k, (i, t) in enumerate(zip(IDS, TEXTS))], "doc_id long, text string, lang string, source string, n_chars long, spans string, score int, id long")
    put("labels", [(IDS[k], int(k % 4 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int")
    put("benchmark", [(*r, "clash") for r in ITEMS], "item_id long, text string, id string")
    put("pages", [(*r, "clash") for r in PAGES], "page_id long, url string, html string, text string")
    put("conversations", TURNS, "conv_id long, turn int, role string, text string")
    put("embeddings", [(*r, 1) for r in vectors()], "vec_id long, embedding array<double>, component int")
    return top


def rows(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def test_op1_chat(spark, folder):
    odd = "\\### Assistant: </turn> ok"
    by = defaultdict(list)
    for c, t, r, x in [*TURNS, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        by[c].append((t, r, x or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for c, turns in by.items():
        loss = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))), len(loss), sha(loss))
    got = rows(spark, folder, "op1_chat")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)
    assert all(r.formatted_chars >= r.loss_chars for r in got)


def test_op2_quality(spark, folder):
    got = {r.doc_id: r for r in rows(spark, folder, "op2_quality")}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    x = quality.statistics(TEXTS)
    for i, v in zip(IDS, x):  # table entries looked up and added one at a time
        bins = [sum(e <= a for e in edges) for a, edges in zip(v, model.edges)]
        raw = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[f] * quality.COARSE // quality.BINS][bins[g] * quality.COARSE // quality.BINS] for f, g, t in model.pairs)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5)
    held = [(IDS[k], int(k % 4 > 0)) for k in range(60) if zlib.crc32(str(IDS[k]).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == y for i, y in held]) >= 0.9 and len(got) == len(TEXTS)


def test_boosting_steps_against_all_cuts():
    rng = np.random.default_rng(4)
    gain = lambda parts: sum(g.sum() ** 2 / (h.sum() + 1) for g, h in parts)
    for _ in range(30):
        g, h = rng.normal(size=8), rng.random(8)
        best, at = quality._split(g, h)
        each = [gain([(g[:c], h[:c]), (g[c:], h[c:])]) - gain([(g, h)]) for c in range(1, 8)]
        assert best == pytest.approx(max(each)) and each[at - 1] == pytest.approx(best)
        step = quality._step(g, h)
        assert len(set(step.tolist())) <= 3 and gain([(g, h)]) <= (step**2 * (h + 0)).sum() + sum(step[i] ** 2 for i in {int(np.flatnonzero(step == v)[0]) for v in step}) + 1e-9
        g, h = rng.normal(size=(4, 4)), rng.random((4, 4))
        found, table = quality._grid(g, h)
        halves = lambda a, b: max(gain([(a[:c], b[:c]), (a[c:], b[c:])]) for c in range(1, 4))
        each = [halves(g[:r].sum(0), h[:r].sum(0)) + halves(g[r:].sum(0), h[r:].sum(0)) for r in range(1, 4)]
        assert found == pytest.approx(max(each)) and table.shape == g.shape


def test_op3_tiles(spark, folder):
    known = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors() if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    close = [(i, j) for i in known for j in known if i < j and known[i] @ known[j] >= 0.9]
    name = smallest([i for i, _ in vectors()], close)
    got = rows(spark, folder, "op3_tiles")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (sum(i in p for p in close), c, c == i) for i, c in name.items()}
    assert len(close) > 30 and len(got) == len(vectors())


def test_op4_near_dup(spark, folder):
    sets = {i: shingles(t) for i, t in zip(IDS, TEXTS)}
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    name = smallest(list(sets), near)
    got = rows(spark, folder, "op4_near_dup")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in name.items()} and len(near) >= 3


def test_op5_suffixes(spark, folder):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, folder, "op5_suffixes")}
    assert got == removed(list(zip(IDS, TEXTS)))


def test_op6_pii(spark, folder):
    want = brute(TEXTS)
    got = {r.doc_id: r for r in rows(spark, folder, "op6_pii")}
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    for i, t, spans in zip(IDS, TEXTS, want):
        base = plain(t or "")
        assert got[i].spans == join(spans) and got[i].base_sha256 == hashlib.sha256(join(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[2] == k for b in base) for k in ("email", "ip", "card", "phone")]
    assert sum(r.spans.count("other") for r in got.values()) == 8


def test_op7_html(spark, folder):
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in rows(spark, folder, "op7_html")), key=str)
    text = {1: "T\na & b", 3: ("y " * 30_000).strip()}
    assert got == sorted([(i, u, text.get(i, ""), len(text.get(i, ""))) for i, u, _ in PAGES], key=str)


def test_op8_language(spark, folder):
    got = {r.doc_id: r for r in rows(spark, folder, "op8_language")}
    for i, t in zip(IDS, TEXTS):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.lang_pred in ("a", "b", "und")


def test_viterbi_against_plain_dynamic_programming():
    rng = np.random.default_rng(9)
    model = language.Model(["a", "b", "c"], np.ones((3, language.SLOTS)), np.ones((3, language.SCRIPTS)))
    scores, bound = rng.normal(size=(40, 3)) * 8, np.array([0, 0, 1, 9, 40])
    path = model.paths(scores, bound)
    for s, e in zip(bound, bound[1:]):
        best = scores[s].copy() if e > s else []
        for t in range(s + 1, e):
            best = np.array([max(best[q] - language.PENALTY * (q != k) for q in range(3)) + scores[t, k] for k in range(3)])
        if e > s:
            own = path[s:e]
            assert scores[np.arange(s, e), own].sum() - language.PENALTY * (own[1:] != own[:-1]).sum() == pytest.approx(max(best))


def test_every_language_is_learned_however_rare(spark):
    table = spark.createDataFrame([(k, f"{'abc' if k else 'xyz'} word{k}", "often" if k else "rare") for k in range(400)], "doc_id long, text string, lang string")
    assert language.learn(table, 20).names == ["often", "rare"]
    assert language.learn(table.limit(0)).names == []


def test_op9_contamination(spark, folder):
    got = {r.doc_id: r for r in rows(spark, folder, "op9_contamination")}
    for i, t in zip(IDS, TEXTS):
        w, hit, named = words(t), set(), set()
        for k, x in ITEMS:
            v = words(x)
            n = min(13, len(v))
            for at in range(len(w) - n + 1) if n and k is not None else ():
                if any(w[at : at + n] == v[b : b + n] for b in range(len(v) - n + 1)):
                    hit |= set(range(at, at + n))
                    named.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_op10_packing(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    places, got = defaultdict(list), {}
    for r in rows(spark, folder, "op10_packing"):
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        places[r.sequence_id].append((r.offset, r.length))
    want = {}
    for i, t in zip(IDS, TEXTS):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))
    assert got == want
    for held in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(held)]).tolist()]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 4096
    total = sum(n for _, n, _ in want.values())
    assert len(places) == -(-total // 4096)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    place = [c[0] for c in want.description]
    want = sorted((tuple(r[place.index(c)] for c in columns) for r in want.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in rows(spark, folder, name)), key=str) == want
