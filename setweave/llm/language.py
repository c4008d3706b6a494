"""Language identification (operator 8): script ranges, word scores and a Viterbi path.

Words are runs of letters (ASCII letters and all bytes of other characters, folded to lower case). Every language has
log-probabilities of hashed byte trigrams within words, and the shares of its words by script range. A word's candidates
are the languages that use its script; its score for each is the sum over its trigrams. A Viterbi path over the words of
a text, which pays PENALTY to change language, labels spans; the text's language is that of most letters' bytes.

Learned from text and lang of documents whose crc32(doc_id as text) mod 4 is not 2, of these about MAX_TRAIN of each
language, chosen by a hash of the id (documented bound; all of a language that has no more), so that no language is too rare
to be learned. Null doc_ids count as the empty text, and rows that repeat all count. Null texts and texts without a letter are
`und` with score 0, as are all when there is nothing to learn from. Ties go to the language that sorts first. Only
doc_id, text and, for learning, lang are read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import crc_mod

#: Labelled documents of a language learned from, about; slots of the trigram table; bytes labelled together.
MAX_TRAIN, SLOTS, SLICE = 5_000, 1 << 16, 8 << 20
#: Tasks that count the trigrams of the documents learned from.
COUNTERS = 16
#: What a change of language costs, in nats; a script is a language's own if this share of its words has it.
PENALTY, OWN_SCRIPT = 12.0, 0.01
#: Script ranges by the first byte of a word: ASCII and Latin, Greek, Cyrillic, Hebrew and Arabic, Indic and other E0-E2, CJK, Hangul, the rest.
_FROM = [0, 0xCE, 0xD0, 0xD4, 0xE0, 0xE3, 0xEA, 0xEE]
SCRIPTS = len(_FROM)
_SCRIPT = np.searchsorted(_FROM, np.arange(256), "right") - 1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def parts(texts):
    """(index of the first, texts) in slices of about SLICE bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if held and size + len(b) > SLICE:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def trigrams(texts: list[bytes]):
    """(slot of each letter byte, first letter of each word and the total, script of each word, first word of each text and the total)."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    letter = _LETTER[raw]
    buf = _FOLD[raw]
    latin = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    buf[latin] += 32
    buf[~letter] = 0
    at = np.flatnonzero(letter)
    code = (buf[at - 1].astype(np.uint32) << 16) | (buf[at].astype(np.uint32) << 8) | buf[at + 1]
    slot = (code * np.uint32(2654435761)) >> np.uint32(16)
    start = np.flatnonzero(~letter[at - 1])
    offset = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])])
    return slot, np.append(start, len(at)), _SCRIPT[buf[at[start]]], np.searchsorted(at[start], offset)


class Model:
    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        smooth = counts + 0.5
        self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32)) if names else np.zeros((SLOTS, 0), np.float32)
        own = scripts >= OWN_SCRIPT * np.maximum(scripts.sum(1, keepdims=True), 1)
        own[:, ~own.any(0)] = True
        self.allowed = own.T

    def word_scores(self, slot, start, script) -> np.ndarray:
        out = np.empty((len(script), len(self.names)), np.float32)
        for k in range(len(self.names)):
            sums = np.concatenate([[0.0], np.cumsum(self.logs[slot, k], dtype=np.float64)])
            out[:, k] = sums[start[1:]] - sums[start[:-1]]
        out[~self.allowed[script]] = -1e6
        return out

    def paths(self, scores: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The language of each word; all texts advance together, a word at a time."""
        count = np.diff(bound)
        order = np.argsort(-count, kind="stable")
        begin, alive = bound[:-1][order], np.searchsorted(-count[order], -np.arange(1, count.max(initial=0) + 1), "right")
        best = np.zeros((len(count), len(self.names)))
        came = np.zeros(scores.shape, np.int16)
        own = np.arange(len(self.names), dtype=np.int16)
        for t, n in enumerate(alive.tolist()):
            at, now = begin[:n] + t, best[:n]
            if t:
                top = now.argmax(1)
                jump = now[np.arange(n), top] - PENALTY
                change = jump[:, None] > now
                came[at] = np.where(change, top[:, None], own)
                now = np.where(change, jump[:, None], now)
            best[:n] = now + scores[at]
        out = np.zeros(len(scores), np.int16)
        state = best.argmax(1)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            at = begin[:n] + t
            out[at] = state[:n]
            state[:n] = came[at, state[:n]]
        return out


def _counts(names: list[str]):
    place = {n: k for k, n in enumerate(names)}

    def counts(batches):
        grams, scripts = np.zeros((len(names), SLOTS)), np.zeros((len(names), SCRIPTS))
        for batch in batches:
            lang = np.array([place[v] for v in batch["lang"].to_pylist()], int)
            for first, held in parts(batch["text"].to_pylist()):
                slot, start, script, bound = trigrams(held)
                own = lang[first : first + len(held)]
                for k in np.unique(own):
                    word = np.repeat(own == k, np.diff(bound))
                    grams[k] += np.bincount(slot[np.repeat(word, np.diff(start))], minlength=SLOTS)
                    scripts[k] += np.bincount(script[word], minlength=SCRIPTS)
        rows = [k for k in range(len(names)) if scripts[k].any()]
        blobs = [np.concatenate([grams[k], scripts[k]]).tobytes() for k in rows]
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in rows], pa.string()), pa.array(blobs, pa.binary())], names=["lang", "counts"])

    return counts


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.float64) for b in group["counts"].to_pylist())
    return pa.table({"lang": pa.array([group["lang"][0].as_py()]), "counts": pa.array([total.tobytes()], pa.binary())})


def learn(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    each = rows.groupBy("lang").agg(F.count("*").alias("n"))
    names = sorted(r.lang for r in each.select("lang").collect())
    steps = 1 << 40
    share = F.pmod(F.xxhash64("doc_id"), F.lit(steps)).cast("double") / steps
    # each has a row for each language, of which the model holds a table each
    rows = rows.join(F.broadcast(each), "lang").filter(share * F.col("n") < max_train).repartition(COUNTERS)
    schema = "lang string, counts binary"
    got = rows.select("lang", "text").mapInArrow(_counts(names), schema).groupBy("lang").applyInArrow(_summed, schema).collect()
    got = sorted(got, key=lambda r: r.lang)
    table = np.array([np.frombuffer(r["counts"], np.float64) for r in got]).reshape(len(got), SLOTS + SCRIPTS)
    return Model([r.lang for r in got], table[:, :SLOTS], table[:, SLOTS:])


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _label(model: Model):
    def label(batches):
        for batch in batches:
            for first, held in parts(batch["text"].to_pylist()):
                slot, start, script, bound = trigrams(held)
                n, names = len(held), model.names
                if names and len(script):
                    path = model.paths(model.word_scores(slot, start, script), bound)
                else:
                    path = np.zeros(len(script), np.int16)
                owner, weight = np.repeat(np.arange(n), np.diff(bound)), np.diff(start)
                votes = np.bincount(owner * max(len(names), 1) + path, weight, n * max(len(names), 1)).reshape(n, -1)
                top, total = votes.argmax(1), votes.sum(1)
                known = total > 0
                for k in np.flatnonzero(known):
                    lead = held[k][:64]
                    if not any(65 <= c < 91 or 97 <= c < 123 for c in lead):
                        known[k] = has_letter(held[k])
                known &= bool(names)
                head = np.ones(len(path), bool)
                head[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(head)
                spans: list[list[dict]] = [[] for _ in held]
                if names:
                    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(path)], strict=True):
                        k = int(owner[s])
                        spans[k].append({"start": s - int(bound[k]), "end": e - int(bound[k]), "lang": names[path[s]]})
                score = np.where(known, votes[np.arange(n), top] / np.maximum(total, 1), 0.0)
                lang = [names[t] if ok else "und" for t, ok in zip(top, known, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), pa.array(lang, pa.string()), pa.array(score), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return label


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are ranges of words [start, end) with their language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_label(model), "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identified(docs, learn(docs))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
