"""Quality classifier (operator 2): a generalised additive model with pairwise interactions.

Each text becomes a short vector of statistics. Cyclic boosting goes over the features in turn, each time fitting a tree
of at most three leaves to one feature's bins and adding a small step to that feature's lookup table; then the pairs of
features whose coarse grid explains most of what is left are boosted in the same way with trees of four leaves. A score
is the sum of one table entry per feature and pair, added for all rows at once.

The labels used are those of rows whose crc32(doc_id as text) mod 3 is not 1, and of these at most MAX_TRAIN, in the order
of a hash of the id: the model is fitted on the driver on that bounded sample. All documents are scored on their whole
texts. Null and empty texts have the statistics of no words. Without labels of both kinds the score is the share of label
1 (one half without any), the same for all rows. Repeated labels all count; rows with a null label or id are left out of
learning. Only doc_id and text are read of documents. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import NOT_BLANK, U64, crc_mod, mix, sliced, words_of

#: Labelled rows the model is fitted on, at most.
MAX_TRAIN = 20_000
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 8, 150, 8, 60, 0.15


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[c if isinstance(c, int) else ord(c) for c in chars]] = True
    return out


_CLASSES = {
    "upper": _class(range(65, 91)),
    "lower": _class(range(97, 123)),
    "digit": _class(range(48, 58)),
    "high": _class(range(128, 256)),
    "stop": _class(".,"),
    "loud": _class("!?"),
    "bar": _class("|\t"),
    "symbol": _class("#$%&*+/<=>@[\\]^_`{}~"),
    "quote": _class("\"'():;-"),
    "line": _class("\n"),
    "control": _class([*range(9), *range(14, 32), 127]),
}
NAMES = [*_CLASSES, "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "common_word", "distinct_pairs", "distinct_lines", "line_length", "last_symbol"]


def _shares(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: distinct values and the largest number of equal ones, both over their number (0 without any)."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    head = np.ones(len(owner), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(owner)))
    most = np.zeros(n)
    np.maximum.at(most, owner[at], size)
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    return np.bincount(owner[at], minlength=n) / total, most / total


def statistics(texts) -> np.ndarray:
    """One row of NAMES for each text."""
    out = []
    for _, held in sliced(texts):
        n = len(held)
        raw = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        size = np.array([len(t) for t in held])
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        columns = {}
        for name, chars in _CLASSES.items():
            sums = np.concatenate([[0], np.cumsum(chars[raw], dtype=np.int64)])
            columns[name] = (sums[begin[1:] - 1] - sums[begin[:-1]]) / np.maximum(size, 1)
        _, start, end, h, bound = words_of(held, NOT_BLANK)
        count = np.diff(bound)
        owner = np.repeat(np.arange(n), count)
        length = end - start
        some = np.maximum(count, 1)
        columns["log_bytes"], columns["log_words"] = np.log1p(size), np.log1p(count)
        columns["word_length"] = np.bincount(owner, length, n) / some
        columns["long_words"] = np.bincount(owner, length > 20, n) / some
        columns["distinct_words"], columns["common_word"] = _shares(owner, h, n)
        pair = np.zeros(len(h), U64)
        pair[1:] = mix(h[1:] + h[:-1] * U64(3))
        first = np.zeros(len(h), bool)
        first[bound[:-1][count > 0]] = True
        columns["distinct_pairs"], _ = _shares(owner[~first], pair[~first], n)
        odd = _CLASSES["symbol"] | _CLASSES["loud"]
        columns["last_symbol"] = np.bincount(owner, odd[raw[end - 1]], n) / some
        is_line = np.ones(256, bool)
        is_line[10] = False
        _, _, _, lines, line_bound = words_of(held, is_line)
        n_lines = np.diff(line_bound)
        columns["distinct_lines"], _ = _shares(np.repeat(np.arange(n), n_lines), lines, n)
        columns["line_length"] = np.log1p(size / np.maximum(n_lines, 1))
        out.append(np.column_stack([columns[k] for k in NAMES]))
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


class Additive:
    """Lookup tables by feature and by pair of features; score() adds their entries."""

    def __init__(self, prior: float = 0.5):
        self.base = float(np.log(prior / (1 - prior)))
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for f, t in enumerate(self.tables):
            out += t[bins[:, f]]
        for f, g, t in self.pairs:
            out += t[bins[:, f] * COARSE // BINS, bins[:, g] * COARSE // BINS]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best cut of a row of bins by sums of gradients and curvatures."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    _, first = _split(g, h)
    options = [(_split(g[a:b], h[a:b]), a) for a, b in ((0, first), (first, len(g))) if b - a > 1]
    cuts = [0, first, len(g)]
    if options:
        (gain, at), a = max(options)
        if gain > 1e-9:
            cuts = sorted([*cuts, a + at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature and then each side by the second."""
    best, out = -1.0, np.zeros(g.shape)
    for at in range(1, len(g)):
        parts = [(slice(0, at), g[:at].sum(0), h[:at].sum(0)), (slice(at, len(g)), g[at:].sum(0), h[at:].sum(0))]
        cuts = [_split(pg, ph)[1] for _, pg, ph in parts]
        cells = [(rows, cols, pg[cols].sum(), ph[cols].sum()) for (rows, pg, ph), c in zip(parts, cuts, strict=True) for cols in (slice(0, c), slice(c, None))]
        gain = sum(cg**2 / (ch + 1) for *_, cg, ch in cells)
        if gain > best:
            best, out = gain, np.zeros(g.shape)
            for rows, cols, cg, ch in cells:
                out[rows, cols] = cg / (ch + 1)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Additive(share)
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    bins = model.bins(x)
    out = model.raw(bins)
    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            p = 1 / (1 + np.exp(-out))
            step = RATE * _step(np.bincount(bins[:, f], y - p, BINS), np.bincount(bins[:, f], p * (1 - p), BINS))
            model.tables[f] += step
            out += step[bins[:, f]]
    coarse = bins * COARSE // BINS

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, p = coarse[:, f] * COARSE + coarse[:, g], 1 / (1 + np.exp(-out))
        return cell, *(np.bincount(cell, v, COARSE**2).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p)))

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda fg: -_grid(*sums(*fg)[1:])[0])[:PAIRS]
    model.pairs = [(f, g, np.zeros((COARSE, COARSE))) for f, g in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, g, table in model.pairs:
            cell, grad, curve = sums(f, g)
            step = RATE * _grid(grad, curve)[1]
            table += step
            out += step.reshape(-1)[cell]
    return model


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Additive:
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    some = some.filter(crc_mod("doc_id", 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").select("y", "text")  # at most max_train short rows

    def measure(batches):
        for batch in batches:
            x = statistics(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "x"])

    got = rows.mapInArrow(measure, "y int, x binary").collect()
    got.sort(key=lambda r: (bytes(r.x), r.y))  # the model doesn't depend on the order of arrival
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float64).reshape(-1, len(NAMES))
    return fit(x, np.array([r.y for r in got], np.float64))


def scored(docs: DataFrame, model: Additive, *keep: str) -> DataFrame:
    """doc_id, score and the columns of keep (all as they are), a row for each row of docs."""
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    out = ["doc_id", *[c for c in keep if c != "doc_id"]]
    rows = docs.select(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(out).schema) + ", score double"

    def score(batches):
        for batch in batches:
            s = model.score(statistics(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in out], pa.array(s, pa.float64())], names=[*out, "score"])

    return rows.mapInArrow(score, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
