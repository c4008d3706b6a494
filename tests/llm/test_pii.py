import random
import re

import pytest
from test_texts import NASTY, docs, plain

from setweave.llm import pii

RNG = random.Random(31)


def hexes(n):
    return "".join(RNG.choices("0123456789abcdef", k=n))


def corpus():
    filler = ["then", "some", "words", "of", "no", "meaning", "stand", "here"]
    say = lambda n: " ".join(RNG.choice(filler) for _ in range(n))
    texts = [f'{say(5)} token = "{hexes(40)}" {say(5)}' for _ in range(14)]
    # the token's words announce identifiers whose shape says nothing, and those have other words after them
    texts += [f'{say(5)} token = "{RNG.choice(["userAlice", "b7q-x2", "kate@home"])}{k} is barred {say(3)}' for k in range(9)]
    texts += [f"{say(4)} member b7q-x2{k} is barred {say(2)}" for k in range(7)]
    # far blanks, a long word before, and a common word beside one identifier
    texts += [f"{say(3)} token  =\n{' ' * 300}\t\"lonely77\" {say(2)}", 'token = "lonelyOne" lonelyOne', f"{'x' * 5000}{k} seen1{k} {say(2)}" if (k := 3) else "", f"words {hexes(40)} words", "words 12345x words"]
    return [*NASTY, *texts, *(say(60) for _ in range(20))]


def brute(texts):
    """Patterns as tuples of tokens, scored by plain loops over all occurrences."""
    grams, places, spans = {}, [], []
    for t in texts:
        tokens = [(m.start(), re.sub("[A-Z]", lambda c: c.group().lower(), m.group())) for m in re.finditer(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+|[!-/:-@\[-^`{-~]", t or "")]
        own = []
        for n in (1, 2, 3):
            for i in range(len(tokens) - n + 1):
                g = tuple(w for _, w in tokens[i : i + n])
                grams[g] = grams.get(g, 0) + 1
        for s, e, base, seed in pii.instances(t, plain(t), pii.SHAPE) if t else ():
            left = [w for at, w in tokens if at < s]
            right = [w for at, w in tokens if at >= e]
            pats = [("l", tuple(left[-n:])) for n in (1, 2, 3) if len(left) >= n] + [("r", tuple(right[:n])) for n in (1, 2, 3) if len(right) >= n]
            own.append((s, e, base, seed, t[s:e].lower() if re.search("[0-9@]", t[s:e]) else None, pats))
        places.append(own)
    known, before = {x[4] for own in places for x in own if x[3]}, None
    while before != (sure := _sure(places, known, grams)):
        before = sure
        known |= {x[4] for own in places for x in own if set(x[5]) & sure}
    for t, own in zip(texts, places):
        more = [(s, e, "other") for s, e, base, _, _, pats in own if not base and set(pats) & sure]
        spans.append(sorted([*plain(t or ""), *more], key=lambda x: (x[0], (*pii.KINDS, "other").index(x[2]))))
    return spans


def _sure(places, known, grams):
    mass, beside = {}, {}
    for own in places:
        for x in own:
            if x[4] is not None and x[4] in known:
                for p in x[5]:
                    mass[p] = mass.get(p, 0) + 1
                    beside.setdefault(p, set()).add(x[4])
    return {p for p in mass if mass[p] / grams[p[1]] > pii.LEAST_SCORE and len(beside[p]) >= pii.LEAST_SEEDS}


@pytest.mark.parametrize("sent", [pii.SENT, 0])
def test_bootstrapping_against_brute_force(spark, sent):
    texts = corpus()
    want = brute(texts)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs(spark, texts), sent=sent).collect()}
    assert [got[d] for d in range(len(texts))] == want
    other = [texts[d][s:e] for d, own in got.items() for s, e, k in own if k == "other"]
    assert sum(len(v) == 40 for v in other) == 14 and "lonely77" in other and "lonelyOne" in other and "12345x" not in other
    assert any(texts[d][:e].count("member") for d, own in got.items() for _, e, k in own if k == "other")  # a hop further
    text = {r.doc_id: r.text for r in pii.redacted(docs(spark, texts), sent=sent).collect()}
    assert text == {d: pii.cut_out(t, want[d]) for d, t in enumerate(texts)}


def test_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "a@b.cd"), (None, "x"), (3, "10.0.0.1 b"), (3, "10.0.0.1 b"), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for sent in (pii.SENT, 0):
        got = pii.redacted(table, sent=sent).collect()
        assert sorted(got, key=str) == sorted([(None, "[email]"), (None, "x"), (3, "[ip] b"), (3, "[ip] b"), (3, None)], key=str)
    assert pii.personal_data(table).count() == 5


def test_runs_are_counted_exactly(spark):
    texts = ["ÉTÉ b été B, b", None, "", "B", "b, b , B"]
    raw = ["b", "b , b", ",", "never"]
    runs = [pii.grams([t.encode()])[2][min(2, len(t.split()) - 1)].max() | (1 << 63) for t in raw]
    runs = [int(pii.np.uint64(r).astype(pii.np.int64)) for r in runs]
    got = {r.run: r.n_run for r in pii.run_counts(docs(spark, texts), spark.createDataFrame([(r,) for r in runs], "run long")).collect()}
    assert [got.get(r) for r in runs] == [7, 3, 3, None]
