import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setweave.llm import contamination, html, language, packing, pii, quality

NASTY = [None, "", " \n\t ", "x" * 30_000, "\x00\x1f", "é ß 漢字", "1 2 3", "a b" * 4000]


def docs(spark, texts, **more):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score int")


# --- contamination ---


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


@pytest.mark.parametrize("group_bytes", [1 << 20, 40])
def test_contamination_against_brute_force(spark, group_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "Ab", "c1", "é"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 5, 12, 13, 14, 20, 30])] + [(50, None), (51, "--"), (52, "same words here"), (53, "same words here")]
    texts = [*NASTY, *(" ".join(word() for _ in range(200)) for _ in range(5)), "x, y " + items[7][1] + "; z", "Same WORDS-here"]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {r.id: r for r in contamination.judged(contamination.contamination(docs(spark, texts), bench, group_bytes=group_bytes)).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        w, hit, named = words(t), set(), set()
        for k, x in items:
            v = words(x)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named.add(str(k))
        assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (len(w), len(hit), sorted(named))
        assert got[d].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("group_bytes", [1 << 20, 10])
def test_contamination_keeps_rows_whose_ids_are_null_or_repeat(spark, group_bytes):
    bench = spark.createDataFrame([(k, f"first{k} second{k} third{k}") for k in range(6)], "item_id long, text string")
    rows = [(None, "first1 second1 third1 x"), (None, "clean"), (7, "a first2 second2 third2 first3 second3 third3"), (7, "b c"), (7, None), (8, "first5 second5 third5")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = contamination.judged(contamination.contamination(table, bench, group_bytes=group_bytes)).collect()
    want = [(None, 4, 3, ["1"]), (None, 1, 0, []), (7, 7, 6, ["2", "3"]), (7, 2, 0, []), (7, 0, 0, []), (8, 3, 3, ["5"])]
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(want, key=str)


# --- packing ---


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=1))
def test_plan_places_every_piece_once_and_without_gaps(counts):
    held = defaultdict(list)
    ranks = defaultdict(list)
    for n, first, last, k, sequence, offset in packing.plan(dict(counts), 60):
        for r in range(first, last):
            held[sequence + (r - first) // k].append((offset + (r - first) % k * n, n))
            ranks[n].append(r)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 60
        assert sum(3 * n > 60 for _, n in pieces) <= 2


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    known = Tokenizer.from_file(path)
    texts = [*NASTY, "It's 12½ ªº <|endoftext|> Don'T\x85'sx", "İstanbul ΣΣ é", "word " * 9000, "word", "word"]
    got = packing.pack(docs(spark, texts)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, t in enumerate(texts):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, s, min(4096, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 4096))]
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts]
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack(docs(spark, [])).count() == 0


def test_pieces_that_share_an_id_get_places_of_their_own_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 10)
    table = spark.createDataFrame([(None, None)] * 60 + [(None, "word")] * 30 + [(3, "one two")] * 30, "doc_id long, text string")
    got = [(r.doc_id, r.length, r.sequence_id, r.offset) for r in packing.pack(table).collect()]
    assert Counter((d, n) for d, n, _, _ in got) == {(None, 1): 60, (None, 2): 30, (3, 3): 30}
    assert len({s for _, _, s, _ in got}) == 1
    at = 0
    for offset, n in sorted((o, n) for _, n, _, o in got):
        assert offset == at
        at += n


def test_added_tokens_are_encoded_as_the_plain_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["one <|endoftext|> two <|startoftext|>", "a<|EndOfText|>b", "<|endoftext|>é 漢", "<| endoftext |>", "one two"]
    assert known.encode(texts[0], add_special_tokens=False).ids == [637, 49407, 1237, 49406]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs(spark, texts)).collect()}
    ids = [[*known.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert got == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in enumerate(ids)}


# --- personal data ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}
            if ok.get(kind, lambda: True)():
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a1259.@-+ (é\n"), max_size=70))
def test_base_spans(t):
    assert pii.base_spans(t) == plain(t)


def test_contexts_are_learned_from_seeds(spark):
    seeds = [f"Reach him, phone: +1 (505) 555-{1000 + k} today" for k in range(8)]
    texts = [*NASTY, *seeds, "my phone: 5055550199 ext", "the number 5055550198 is a count", "4111 1111 1111 1111 at é 10.0.0.1"]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        assert [(s.start, s.end, s.kind) for s in got[d].base] == plain(t or "")
        assert set(got[d].base) <= set(got[d].spans)
    new = {d: [texts[d][s.start : s.end] for s in r.spans if s.kind == "other"] for d, r in got.items()}
    assert {d: v for d, v in new.items() if v} == {16: ["5055550199"]}
    text = {r.doc_id: r.text for r in pii.redacted(docs(spark, texts)).collect()}
    assert text[16] == "my phone: [other] ext" and text[18] == "[card] at é [ip]" and text[0] is None
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_contexts_are_counted_exactly_however_many_words_there_are(spark):
    texts = [f"Phone: +1 (505) 555-{1000 + k} today" for k in range(8)] + ["phone: 5055550199 ext"]
    many = spark.range(100, 500).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 25000), x -> translate(hex(xxhash64(id, x)), '0123456789', 'ghijklmnop')), ' ') AS text")
    found = pii.personal_data(docs(spark, texts).select("doc_id", "text").union(many)).filter("doc_id = 8").first()
    assert [(s.start, s.end, s.kind) for s in found.spans] == [(7, 17, "other")]


# --- pages ---


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p><b>One<br><p>Two &amp; \n three &eacute;</article><footer>end</footer>", "T\nOne\nTwo & three é"),
        ("<body><script>var a='<p>no</p>'</script><style>p{}</style><main><p>Yes<!-- <p>no</p> --></p></main>", "Yes"),
        ("<article><p>a</p><aside>no</aside><form>no</form><div class='ad'>no</div><section id=comments><p>no</p></section><p>b</p><p", "a\nb"),
        ("<div class=cookie-notice>We use cookies, friend.</div><div><p>" + "Long text, really. " * 9 + "</p><p>ok</p></div>", ("Long text, really. " * 9).strip() + "\nok"),
        ("<article><p>1 < 2 and <3</p><p a='>'>q</p></article>", "1 < 2 and <3\nq"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 9)
        source, sink, edge = [rng.random() * 4 for _ in range(n)], [rng.random() * 4 for _ in range(n)], [rng.random() * 3 for _ in range(n - 1)]
        cost = lambda keep: sum(sink[i] if k else source[i] for i, k in enumerate(keep)) + sum(edge[i] for i in range(n - 1) if keep[i] != keep[i + 1])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.content_side(source, sink, edge)) == pytest.approx(best)


def test_pages_table(spark):
    rows = [(1, None, None, "c"), (None, "u", "<p>x" * 3000, "c"), (1, "u", "<article>a</article>", "c")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(len(r.text) for r in got) == [0, 1, 5999]


# --- quality and language ---


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choices("ABCDEFGH", k=4)) + "!!" for _ in range(60))
    texts = [good() if k % 3 else bad() for k in range(150)] + NASTY
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs(spark, texts), labels)
    got = {r.doc_id: r.score for r in quality.scored(docs(spark, texts).drop("score"), model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(150) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.5) == (k % 3 > 0) for k in held]) > 0.95
    empty = quality.learn(docs(spark, texts), labels.limit(0))
    assert {r.score for r in quality.scored(docs(spark, texts).drop("score"), empty).collect()} == {0.5}
    assert quality.scored(docs(spark, []).drop("score"), model).count() == 0


def test_language_spans_and_scripts(spark):
    rng = random.Random(8)
    kinds = {"aa": "abcde", "bb": "vwxyzé", "ru": "абвгд"}
    made = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(n))
    rows = [(i, made(k, 40), k) for i, k in enumerate(list(kinds) * 20)]
    mixed = made("aa", 20) + " " + made("bb", 30)
    rows += [(100, None, "aa"), (101, "12 - 3", "aa"), (102, "", None), (103, mixed, None), (104, "« »", None), (105, made("ru", 3), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identified(table, language.learn(table)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60])
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104, 105)] == ["und", "und", "und", "bb", "und", "ru"]
    assert [(s.start, s.end, s.lang) for s in got[103].spans] == [(0, 20, "aa"), (20, 50, "bb")]
    nothing = language.learn(table.filter("lang is null"))
    assert {r.lang_pred for r in language.identified(table, nothing).collect()} == {"und"}
