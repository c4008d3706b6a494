"""Best-fit packing (operator 10): large-item matching on the histogram of lengths.

Each text is cut into pieces of at most CAPACITY tokens. The number of pieces of each length, at most CAPACITY numbers
however many documents there are, is all that is gathered on the driver. There, pieces above a third of the capacity
go into sequences at most two at a time: from the largest on, each takes the largest partner that still fits. Shorter
pieces then go, from the largest on, into the smallest gap that holds them. All sequences with one history are handled as
one range of numbers, so the plan's size depends on the number of lengths and not of pieces. Each piece gets its rank
among the pieces of its length (counted in parts of bounded size, whose offsets are running sums), and the plan gives
the rank's sequence and offset. Parts are dealt by a written number of the piece, so that ids that are null or repeat are spread.

Null texts count as empty: they are one piece holding the end id alone. Equal lengths are ordered by part, doc_id, piece,
start and checksum; rows that are repeated get places of their own. An empty table gives an empty result. Only doc_id and text
are read.

Words are looked up in a table of the words met so far in the task, of at most CACHE entries; texts with characters
outside Latin-1, for which normalisation could matter, and those with the name of an added token go through the
tokenizer whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.llm.common import KEY, Scratch, keyed

CAPACITY, END_ID, CACHE, PART = 4096, 1, 300_000, 200_000
TOKENIZER = "word_bpe_49k.json"
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^ \t-\r\x85\xa0{_LETTERS}{_DIGITS}]+")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def markers(path: str) -> tuple[str, ...]:
    """What the tokenizer reads as one token wherever it stands, in lower case."""
    return tuple(t.content.lower() for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """By id: whether the token ends a word."""
    vocabulary = tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
    return out


def ids_of(texts: list[str], path: str, cache: dict[str, bytes]) -> list[bytes]:
    """The ids of each text, little-endian unsigned 32-bit."""
    known, split, whole = tokenizer(path), [], []
    for i, t in enumerate(texts):
        try:
            t.encode("latin-1")
            low = t.lower()
            split.append(None if any(m in low for m in markers(path)) else _PIECES.findall(low))
        except UnicodeEncodeError:
            split.append(None)
        if split[-1] is None:
            whole.append(i)
    new = [w for w in set().union(*(s for s in split if s)) if w not in cache]
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list(set().union(*(s for s in split if s)))
    pack = lambda e: np.array(e.ids, "<u4").tobytes()
    ends = word_ends(path)
    lines = [" ".join(new[k : k + 256]) for k in range(0, len(new), 256)]
    ids = np.array([i for e in known.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
    cut = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
    if len(cut) != len(new):
        raise ValueError("the tokenizer's words differ from those looked up")
    raw = ids.tobytes()
    cache.update((w, raw[a:b]) for w, a, b in zip(new, [0, *cut], cut))
    out = [b"".join([cache[w] for w in s]) if s is not None else b"" for s in split]
    for i, e in zip(whole, known.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
        out[i] = pack(e)
    return out


def _cut(path: str):
    def cut(batches):
        cache: dict[str, bytes] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                    size += len(texts[end])
                    end += 1
                for d, raw in zip(ids[at:end], ids_of(texts[at:end], path, cache), strict=True):
                    raw += END_ID.to_bytes(4, "little")
                    for k in range(0, len(raw), 4 * CAPACITY):
                        part = raw[k : k + 4 * CAPACITY]
                        rows.append((d, k // (4 * CAPACITY), k // 4, len(part) // 4, zlib.crc32(part)))
                at = end
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, pieces a sequence, first sequence, offset), for ranks of each length.

    Rank r of a row is piece (r - first rank) % k of the row's sequence (r - first rank) // k.
    """
    left, rank, rows, sequences = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges (first sequence, number)

    def put(length: int, pieces: int, k: int, first: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + pieces, k, first, offset))
        rank[length] += pieces
        left[length] -= pieces

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= capacity - n and left[m] and (m != n or left[n] > 1)), 0)
            if partner == n:
                number, k = left[n] // 2, 2
                put(n, 2 * number, 2, sequences, 0)
                gap = capacity - 2 * n
            else:
                number = min(left[n], left[partner]) if partner else left[n]
                put(n, number, 1, sequences, 0)
                if partner:
                    put(partner, number, 1, sequences, n)
                gap = capacity - n - partner
            gaps[gap].append((sequences, number))
            sequences += number
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = next((g for g in range(n, capacity) if gaps.get(g)), capacity)
            if gap == capacity:
                first, number = sequences, -(-left[n] // (capacity // n))
                sequences += number
            else:
                first, number = gaps[gap].pop()
            k = gap // n
            full = min(number, left[n] // k)
            if full:
                put(n, full * k, k, first, capacity - gap)
                gaps[gap - k * n].append((first, full))
            elif left[n]:
                some, full = left[n], 1
                put(n, some, some, first, capacity - gap)
                gaps[gap - some * n].append((first, 1))
            if number > full:
                if gap == capacity:
                    sequences = first + full
                else:
                    gaps[gap].append((first + full, number - full))
    return rows


def _placed(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    begin = np.searchsorted(table[:, 0], np.arange(CAPACITY + 2))

    def placed(batches):
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            names, first = np.unique(length[order], return_index=True)
            for n, at, end in zip(names, first, [*first[1:], len(length)], strict=True):
                own, part = order[at:end], table[begin[n] : begin[n + 1]]
                row = part[np.searchsorted(part[:, 1], rank[own], "right") - 1]
                within = rank[own] - row[:, 1]
                sequence[own] = row[:, 4] + within // row[:, 3]
                offset[own] = row[:, 5] + within % row[:, 3] * n
            out = [*[batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, path: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece; path: the tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = keyed(texts.mapInArrow(_cut(path), "doc_id long, piece int, start long, length long, ids_crc32 long"), scratch)
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    parts = 1 + max(counts.values(), default=0) // PART
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(KEY), F.lit(parts)))
    before = pieces.groupBy("length", "part").count()
    running = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = before.select("length", "part", (F.sum("count").over(running) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order) - 1).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan(counts)), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
