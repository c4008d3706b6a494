"""PII (operator 6): base patterns, then bootstrapped contextual extraction.

The base kinds (email, ip, card, phone) are found by their patterns. They are seeds, as are tokens whose shape no word has:
long hexadecimal or mixed strings. Instances are the seeds and all other tokens with a digit or an @. A
lexical pattern is the run of one to GRAMS tokens, words or punctuation marks, before an instance or after it, so an instance
has up to 2 * GRAMS patterns. In the pattern-instance graph, a pattern's score is the share of all its occurrences in the
corpus that stand beside known instances; a pattern that scores over LEAST_SCORE with LEAST_SEEDS different known instances
is sure, and makes the instances beside it known. Spark repeats this until no more patterns become sure. Instances beside sure
patterns, and tokens of letters in both cases there, are added as spans of kind `other`; base spans always stay.

Occurrences of patterns are counted exactly, over all documents; a filter of fixed size only leaves out runs of tokens
that no pattern has. Tokens are compared by 64-bit hashes, with A-Z folded; words of any length and blanks of any length count.

Null and empty texts have no spans. Rows are told apart by their place, not by doc_id, so null and repeated doc_ids are
documents of their own. Only doc_id and text are read. An empty table gives an empty result. Offsets are code points, ends
exclusive; spans that share a start are ordered by kind.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import KEY, LOWER, U64, Scratch, keyed, mix, prefix_hashes, sliced, substring_hash

KINDS = ("email", "ip", "card", "phone")
GRAMS, LEAST_SCORE, LEAST_SEEDS = 3, 0.5, 5
#: 64-bit words of the filter of patterns (2 MB); sure patterns (8 bytes each) up to which tasks are sent them.
FILTER, SENT = 1 << 18, 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit can't precede a leftmost match, as it would begin with it; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MAY = re.compile(r"[0-9@]")
#: Tokens are runs of at least 6 of these characters; those with a digit or an @ are instances, those of SHAPE may be found.
_RUN = re.compile(r"[A-Za-z0-9@._%+\-]{6,}+")
SHAPE = re.compile(r"[0-9@]|[a-z][A-Z]")
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True
_WORD[95] = True
_MARK = ~_WORD
_MARK[:33] = _MARK[127] = False


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: a local part reaches back from its @ as far as its characters go, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then in the order of KINDS."""
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def is_seed(token: str) -> bool:
    """Whether its shape alone says that it is no word: 32 hexadecimal digits or more, or 20 of both cases with digits."""
    bare = token.replace("-", "")
    digits = sum(c.isdigit() for c in bare)
    if digits < 4 or len(bare) - digits < 4 or not bare.isalnum():
        return False
    if len(bare) >= 32 and not bare.lower().strip("0123456789abcdef"):
        return True
    return len(bare) >= 20 and any(c.isupper() for c in bare) and any(c.islower() for c in bare)


def instances(text: str, base: list[tuple[int, int, str]], shape: re.Pattern = _MAY) -> list[tuple[int, int, bool, bool]]:
    """(start, end, of a base kind, seed) of base spans that don't overlap and of the other tokens of the shape."""
    out, spans, end = [], sorted((s, e) for s, e, _ in base), 0
    for s, e in spans:
        if s >= end:
            out.append((s, e, True, True))
        end = max(end, e)
    if not shape.search(text):
        return out
    k = reach = 0
    for m in _RUN.finditer(text):
        token = m.group().rstrip("._%+-")
        s = m.start() + len(token) - len(token.lstrip("._%-"))
        e = m.start() + len(token)
        while k < len(spans) and spans[k][0] < e:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= s and e - s >= 6 and shape.search(text, s, e):
            out.append((s, e, False, is_seed(text[s:e])))
    return out


def grams(texts: list[bytes]):
    """(starts of the tokens, first token of each text and the total, GRAMS rows: hash of the n tokens up to each, 0 where there aren't as many)."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    word = np.zeros(len(buf) + 1, np.int8)
    word[1:] = _WORD[buf]
    step = np.diff(word)
    marks = np.flatnonzero(_MARK[buf])
    start = np.concatenate([np.flatnonzero(step == 1), marks])
    end = np.concatenate([np.flatnonzero(step == -1), marks + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    h = mix(substring_hash(prefix_hashes(buf), start, end) + (end - start).astype(U64))
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    bound = np.searchsorted(start, offset)
    nth = np.arange(len(h)) - np.repeat(bound[:-1], np.diff(bound))
    out, run = np.zeros((GRAMS, len(h)), U64), np.zeros(len(h), U64)
    for n in range(GRAMS):
        before = np.zeros(len(h), U64)
        before[n:] = h[: len(h) - n]
        run = mix(run * U64(0x9E3779B97F4A7C15) + before + U64(n + 1))
        out[n] = np.where(nth >= n, run | U64(1), U64(0))
    return start, bound, out, offset


def char_starts(raw: bytes) -> np.ndarray | None:
    """Byte offsets of the characters and the end; None if they are the same."""
    b = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((b & 0xC0) != 0x80)
    return None if len(at) == len(b) else np.append(at, len(b))


def located(texts: list[str | None], base: list[list], shape: re.Pattern = _MAY):
    """Slices of the texts' instances: (their texts' numbers, instances, a row of up to 2 * GRAMS patterns for each, 0 where there is none)."""
    own = [instances(t, b, shape) if t else [] for t, b in zip(texts, base, strict=True)]
    some = [i for i, x in enumerate(own) if x]
    for first, held in sliced(texts[i] for i in some):
        start, bound, run, offset = grams(held)
        numbers, found, rows = [], [], []
        for k, raw in enumerate(held):
            i = some[first + k]
            at = char_starts(raw)
            x = np.array([(s, e) for s, e, *_ in own[i]])
            x = (at[x] if at is not None else x) + offset[k]
            left = np.searchsorted(start, x[:, 0]) - 1  # the last token that begins before the instance
            right = np.searchsorted(start, x[:, 1])  # the first that begins after it
            beside = np.zeros((len(x), 2 * GRAMS), U64)
            ok = left >= bound[k]
            for n in range(GRAMS):
                beside[ok, n] = run[n, left[ok]]
                fits = right + n < bound[k + 1]
                beside[fits, GRAMS + n] = run[n, right[fits] + n] ^ U64(1 << 63)
            numbers += [i] * len(x)
            found += own[i]
            rows.append(beside)
        yield numbers, found, np.concatenate(rows).view(np.int64)


def bases(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    return [base_spans(t) if t and _MAY.search(t) else [] for t in texts]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
SPANS = "array<struct<start:long,end:long,kind:string>>"


def _as_spans(spans: list[list]) -> pa.Array:
    return pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans], _SPAN)


def _edges(batches):
    """(pattern, value, seed, n), summed within each slice; values are hashes of the folded token."""
    for batch in batches:
        texts = batch["text"].to_pylist()
        for numbers, found, patterns in located(texts, bases(texts)):
            value = np.array([int.from_bytes(blake2b(texts[i][s:e].lower().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for i, (s, e, *_) in zip(numbers, found, strict=True)], np.int64)
            seed = np.array([x[3] for x in found])
            row, column = np.nonzero(patterns)
            pattern, value, seed = patterns[row, column], value[row], seed[row]
            order = np.lexsort((value, pattern))
            pattern, value, seed = pattern[order], value[order], seed[order]
            begin = np.flatnonzero(np.append(True, (pattern[1:] != pattern[:-1]) | (value[1:] != value[:-1]))[: len(order)])
            seed = np.logical_or.reduceat(seed, begin) if len(begin) else seed
            yield pa.RecordBatch.from_arrays([pa.array(pattern[begin]), pa.array(value[begin]), pa.array(seed), pa.array(np.diff(np.append(begin, len(order))))], names=["pattern", "value", "seed", "n"])


#: The run of tokens that a pattern is, whichever side it stands on.
_RUN_OF = lambda c: F.col(c).bitwiseOR(F.lit(-(1 << 63)))


def run_counts(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, n_run): how often each of the runs (distinct hashes, top bit set) stands in the texts."""
    spot = F.pmod("run", F.lit(FILTER))
    bit = F.call_function("shiftleft", F.expr("1L"), F.pmod(F.shiftright("run", 18), F.lit(64)).cast("int"))
    words = runs.groupBy(spot.alias("at")).agg(F.bit_or(bit).alias("bits")).collect()  # FILTER rows at most
    table = np.zeros(FILTER, np.int64)
    for r in words:
        table[r["at"]] = r["bits"]
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def count(batches):
        known = sent.value.view(U64)
        for batch in batches:
            for _, held in sliced(batch["text"].to_pylist()):
                run = grams(held)[2].reshape(-1)
                run = run[run != 0] | U64(1 << 63)
                run = run[(known[(run & U64(FILTER - 1)).astype(np.int64)] >> ((run >> U64(18)) & U64(63))) & U64(1) == 1]
                names, n = np.unique(run, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n, pa.int64())], names=["run", "n"])

    counted = texts.select("text").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n_run"))
    return counted.join(runs, "run")


def sure_patterns(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, score) of those that are sure once no more become so."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    edges = texts.mapInArrow(_edges, "pattern long, value long, seed boolean, n long")
    edges = scratch.save(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")))
    # a pattern with fewer different instances can't become sure
    may = scratch.save(edges.groupBy("pattern").agg(F.count("*").alias("support")).filter(F.col("support") >= LEAST_SEEDS).select("pattern", _RUN_OF("pattern").alias("run")))
    counted = scratch.save(run_counts(texts, may.select("run").distinct()))
    patterns = scratch.save(may.join(counted, "run").select("pattern", "n_run"))
    edges = scratch.save(edges.join(patterns, "pattern").select("pattern", "value", "seed", "n"))
    known = scratch.save(edges.filter("seed").select("value").distinct())
    sure, before = None, -1
    while True:
        beside = edges.join(known, "value", "left_semi").groupBy("pattern").agg(F.sum("n").alias("mass"), F.count("*").alias("support"))
        scored = beside.join(patterns, "pattern").select("pattern", "support", (F.col("mass") / F.col("n_run")).alias("score"))
        sure = scratch.save(scored.filter((F.col("score") > LEAST_SCORE) & (F.col("support") >= LEAST_SEEDS)).select("pattern", "score"))
        n = sure.count()  # known instances only become more, and so do sure patterns
        if n == before:
            return sure
        before = n
        known = scratch.save(known.union(edges.join(sure, "pattern", "left_semi").select("value")).distinct())


def _sent(sure: DataFrame, limit: int) -> np.ndarray | None:
    """The sure patterns if there are at most limit of them."""
    if sure.count() > limit:
        return None
    return np.array([r.pattern for r in sure.collect()], np.int64)


def _more(texts: list[str | None], base: list[list], sure: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """Of each text: the spans beside sure patterns."""
    out: list[list] = [[] for _ in texts]
    if len(sure):
        for numbers, found, patterns in located(texts, base, SHAPE):
            hit = np.isin(patterns, sure).any(1)
            for k in np.flatnonzero(hit).tolist():
                s, e, is_base, _ = found[k]
                if not is_base:
                    out[numbers[k]].append((s, e, "other"))
    return out


def _ordered(base: list[tuple], more: list[tuple]) -> list[tuple]:
    return sorted([*base, *more], key=lambda x: (x[0], _PLACE[x[2]], x[1]))


_PLACE = {k: i for i, k in enumerate((*KINDS, "other"))}


def _joined_spans(held: DataFrame, sure: DataFrame) -> DataFrame:
    """(_row, spans): all spans of the rows of held, without sending patterns to the tasks."""

    def beside(batches):
        for batch in batches:
            rows, texts = np.asarray(batch[KEY]), batch["text"].to_pylist()
            for numbers, found, patterns in located(texts, bases(texts), SHAPE):
                row, column = np.nonzero(patterns)
                some = ~np.array([x[2] for x in found])[row]
                row, column = row[some], column[some]
                s, e = (np.array([x[k] for x in found], np.int64)[row] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(rows[np.array(numbers)[row]]), pa.array(s), pa.array(e), pa.array(patterns[row, column])], names=[KEY, "start", "end", "pattern"])

    def both(batches):
        for batch in batches:
            more = [[(x["start"], x["end"], "other") for x in m or []] for m in batch["more"].to_pylist()]
            spans = [_ordered(b, m) for b, m in zip(bases(batch["text"].to_pylist()), more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch[KEY], _as_spans(spans)], names=[KEY, "spans"])

    texts = held.select(KEY, F.col("text").cast("string").alias("text"))
    near = texts.mapInArrow(beside, f"{KEY} long, start long, end long, pattern long").join(sure, "pattern", "left_semi")
    near = near.select(KEY, "start", "end").distinct().groupBy(KEY).agg(F.collect_list(F.struct("start", "end")).alias("more"))
    return texts.join(near, KEY, "left").mapInArrow(both, f"{KEY} long, spans {SPANS}")


def personal_data(docs: DataFrame, scratch: Scratch | None = None, sent: int = SENT) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans as array<struct<start, end, kind>>, one row for each row of docs.

    More sure patterns than sent are joined to the instances instead of being sent to the tasks; the result is the same.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sure = sure_patterns(docs, scratch)
    patterns = _sent(sure, sent)
    if patterns is None:
        held = keyed(docs, scratch)
        docs = held.select(KEY, "doc_id", "text").join(_joined_spans(held, sure), KEY).select("doc_id", "text", "spans")

    def label(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            base = bases(texts)
            spans = batch["spans"] if patterns is None else _as_spans([_ordered(b, m) for b, m in zip(base, _more(texts, base, patterns), strict=True)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _as_spans(base), spans], names=["doc_id", "base", "spans"])

    return docs.mapInArrow(label, f"doc_id long, base {SPANS}, spans {SPANS}")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, scratch: Scratch | None = None, sent: int = SENT) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; doc_ids may be null or repeat.

    Where the sure patterns can be sent to the tasks, the texts are read again and not shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sure = sure_patterns(docs, scratch)
    patterns = _sent(sure, sent)
    if patterns is None:
        held = keyed(docs, scratch)
        docs = held.join(_joined_spans(held, sure).withColumnRenamed("spans", "_spans"), KEY).select(*names, "_spans")

    def rewrite(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            if patterns is None:
                spans = [[(x["start"], x["end"], x["kind"]) for x in s] for s in batch["_spans"].to_pylist()]
            else:
                base = bases(texts)
                spans = [[*b, *m] for b, m in zip(base, _more(texts, base, patterns), strict=True)]
            new = [cut_out(t, x) for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch[c] for c in names], names=names)

    return docs.mapInArrow(rewrite, schema)


def cut_out(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
