"""The pipeline against plain versions of its stages; the classifier's scores and the tokenizer are taken as they are."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
from test_dedup import smallest
from test_texts import NASTY, plain, words

import corpus_pipeline
from setweave.llm import packing, quality

RNG = random.Random(21)


def prose(n):
    return " ".join("".join(RNG.choices("abcdefgh", k=RNG.randrange(2, 9))) for _ in range(n)) + "."


def junk(n):
    return " ".join("".join(RNG.choices("ABCDEFGH", k=4)) + "!!" for _ in range(n))


def tables():
    items = [(k, prose(30)) for k in range(5)]
    base = prose(80)
    texts = [prose(60) if k % 3 else junk(60) for k in range(120)]
    texts += [base, base, base.replace(".", " end."), *(f"{prose(20)} {t} {prose(20)}" for _, t in items)]
    texts += [f"{prose(300)} {items[0][1]} {prose(400)}", f"write to a.b@c.de or +1 (505) 555-0100, {prose(50)}", prose(6000), *NASTY, prose(60)]
    texts[-1] = texts[1]
    rows = [(i, t, None if i % 7 == 0 else "aa", "hot" if i % 3 else None, len(t) if t else None, i) for i, t in enumerate(texts)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(120)] + [(120, None, 0), (None, 1, 0), (9999, 0, 0)]
    return rows, labels, items


def put(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"{folder}"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def without_copies(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    first = smallest(list(sets), near)
    return {d: t for d, t in texts.items() if first[d] == d}


def contaminated(t, items):
    w, hit = words(t), set()
    for _, x in items:
        v = words(x)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def without_data(t):
    out, at = [], 0
    for s, e, kind in sorted(plain(t or ""), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [t[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + t[at:] if out else t


def test_stages_against_plain_versions(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, labels, items = tables()
    folder = put(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    model = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.scored(docs.drop("score"), model).collect()}
    want = [{d: t for d, t in texts.items() if scores[d] >= 0.5}]
    assert 80 < len(want[0]) < len(texts) and all(d % 3 for d in want[0] if d < 120)
    want.append(without_copies(want[0]))
    assert 120 in want[1] and 121 not in want[1] and 122 not in want[1]
    want.append({d: t for d, t in want[1].items() if not contaminated(t, items)})
    assert not any(123 <= d < 128 for d in want[2]) and 128 in want[2]
    want.append({d: without_data(t) for d, t in want[2].items()})

    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == kept and len(got) == len(kept), name
        assert all((r.lang, r.source) == rows[r.doc_id][2:4] for r in got), name
        docs = spark.createDataFrame(got, docs.schema)
    assert all(r.n_chars == (len(r.text) if r.text is not None else rows[r.doc_id][4]) for r in got)

    known = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces, places = {}, defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        places[r.sequence_id].append((r.offset, r.length))
    plainly = {}
    for d, t in want[3].items():
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            plainly[d, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert pieces == plainly and len({d for d, k in pieces if k}) >= 1
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 4096


def test_rows_with_null_and_repeated_ids_are_documents_of_their_own(spark, tmp_path):
    item, one, two, three = prose(30), prose(60), prose(60), prose(60)
    dirty = f"{prose(20)} {item} {prose(20)}"
    folder = put(spark, tmp_path, [], [], [(1, item)])
    mail = "write to a.b@c.de today"
    rows = [(9, one), (3, one), (None, one), (None, two), (4, three), (4, three), (4, mail), (4, f"or {mail}, {prose(9)}"), (None, f"{mail} {prose(9)}"), (None, dirty), (6, dirty + "!"), (6, prose(40))]
    table = spark.createDataFrame([(d, t, "aa", "x", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda rows: sorted(rows, key=str)
    pairs = lambda df: order((r.doc_id, r.text) for r in df.collect())
    assert pairs(corpus_pipeline.near_duplicates(spark, table, folder)) == order([rows[1], *rows[3:5], *rows[6:9], *rows[10:]])
    assert pairs(corpus_pipeline.decontaminate(spark, table, folder)) == order([*rows[:9], rows[11]])
    assert pairs(corpus_pipeline.redact(spark, table, folder)) == order((d, without_data(t)) for d, t in rows)


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    folder = put(spark, tmp_path, [], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
