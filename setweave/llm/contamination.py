"""Benchmark decontamination (operator 9): Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of each item, or all words of a shorter one. For each length of
pattern there is a table of shifts by block (the last two words looked at): a block that no pattern has lets the search
skip length - 1 words, and one that ends a pattern selects the bucket of its patterns, whose words are then compared
one by one with the text's. Hashes only choose; bytes decide.

Patterns are sent to the tasks in groups of about GROUP_BYTES of item text, whatever the number of items, as arrays of
some 50 bytes a window. The hits of several groups are merged by row. Null or empty texts have no words; items without
words, and those with a null id, can't occur; an empty benchmark leaves all documents clean. Repeated items count
separately when their ids differ. Only ids and texts are read. Repeated or null doc_ids are kept as rows of their own.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import ALNUM_OR_HIGH, KEY, U64, Scratch, keyed, mix, sliced, words_of

WINDOW, GROUP_BYTES = 13, 16 << 20


def spaced(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words one blank apart, and where each begins; no word holds a blank, so runs of words are equal as their bytes are."""
    step = np.zeros(len(buf), np.int8)
    step[start], step[end] = 1, -1
    word = np.cumsum(step, dtype=np.int8).astype(bool)
    keep = word.copy()
    keep[end] = True
    out = np.where(word, buf, np.uint8(32))[keep].tobytes()
    size = end - start + 1
    return out, np.append(0, np.cumsum(size))


class WuManber:
    """All windows of one length over the items' words, as arrays: their hashes h and they themselves, spaced, with their starts.

    at: the first words of the windows, item: the numbers of their items. Equal windows (told by hash, confirmed by their bytes)
    are one pattern. Windows that share a slot of the shift table get the smaller shift, so none is skipped.
    """

    def __init__(self, length: int, words: tuple, at: np.ndarray, item: np.ndarray, names: list[str]):
        self.length, self.block, self.names = length, min(2, length), names
        self.text, self.start, h = words
        blocks = block_hashes(h, self.block)
        whole = np.zeros(len(at), U64)
        for k in range(length):
            whole = mix(whole * U64(0x9E3779B97F4A7C15) + h[at + k])
        suffix = blocks[at + length - 1]
        order = np.lexsort((item, whole, suffix))
        at, item, whole, suffix = at[order], item[order], whole[order], suffix[order]
        same = np.zeros(len(at), bool)
        same[1:] = (whole[1:] == whole[:-1]) & (suffix[1:] == suffix[:-1])
        for k in np.flatnonzero(same).tolist():
            same[k] = self.window(at[k]) == self.window(at[k - 1])
        head = np.flatnonzero(~same)
        self.at, self.key, self.item, self.bound = at[head], suffix[head], item.astype(np.int32), np.append(head, len(at))
        self.mask = U64((1 << max(10, int(4 * len(head)).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, length - self.block + 1, np.uint8)
        for last in range(self.block - 1, length):  # shifts get smaller, so the smallest stays
            self.shift[blocks[self.at + last] & self.mask] = length - 1 - last

    def window(self, k: int) -> bytes:
        return self.text[self.start[k] : self.start[k + self.length]]

    def occurrences(self, blocks: np.ndarray, text: bytes, start: list[int]):
        """(first word, word after the last, names of the items) in a text of these blocks whose words begin there."""
        n = len(blocks)
        if n < self.length:
            return
        steps = self.shift[blocks & self.mask]
        stops = np.flatnonzero(steps == 0)
        low, high = (np.searchsorted(self.key, blocks[stops], side).tolist() for side in ("left", "right"))
        place, steps, at = dict(zip(stops.tolist(), zip(low, high, strict=True), strict=True)), steps.tolist(), self.length - 1
        while at < n:
            if steps[at]:
                at += steps[at]
                continue
            begin = at - self.length + 1
            said = text[start[begin] : start[at + 1]]
            for k in range(*place[at]):
                if said == self.window(self.at[k]):
                    yield begin, at + 1, {self.names[i] for i in self.item[self.bound[k] : self.bound[k + 1]]}
            at += 1


def block_hashes(h: np.ndarray, block: int) -> np.ndarray:
    """The hash of the block that ends at each word; the first has none before it."""
    if block == 1:
        return h
    before = np.zeros(len(h), U64)
    before[1:] = h[:-1]
    return mix(before * U64(0x9E3779B97F4A7C15) + h)


def searchers(items: list[tuple[str, str | None]]) -> list[WuManber]:
    names, parts, n, size = [i for i, _ in items], [], [np.zeros(0, np.int64)], 0
    for _, held in sliced([t for _, t in items]):
        buf, start, end, h, bound = words_of(held, ALNUM_OR_HIGH)
        own, start = spaced(buf, start, end)
        parts.append((own, start[:-1] + size, h))
        n.append(np.diff(bound))
        size += len(own)
    if not parts:
        return []
    text = b"".join(x[0] for x in parts)
    start, h = np.append(np.concatenate([x[1] for x in parts]), size), np.concatenate([x[2] for x in parts])
    n = np.concatenate(n)
    bound = np.append(0, np.cumsum(n))
    length, found = np.minimum(n, WINDOW), []
    for words in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == words)
        count = n[own] - words + 1
        item = np.repeat(own, count)
        at = bound[item] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append(WuManber(words, (text, start, h), at, item, names))
    return found


def _occurrences(found: list[WuManber], texts):
    """(index of the first text, numbers of words, merged spans of words hit, items that occur) by slices of texts."""
    for first, held in sliced(texts):
        buf, start, end, h, bound = words_of(held, ALNUM_OR_HIGH)
        text, start = spaced(buf, start, end)
        start = start.tolist()
        blocks = {b: block_hashes(h, b) for b in {x.block for x in found}}
        spans, items = [], []
        for s, e in pairwise(bound.tolist()):
            own, hits, named = start[s : e + 1], [], set()
            for x in found:
                for a, b, names in x.occurrences(blocks[x.block][s:e], text, own):
                    hits.append((a, b))
                    named |= names
            merged: list[list[int]] = []
            for a, b in sorted(hits):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            spans.append(merged)
            items.append(sorted(named))
        yield first, np.diff(bound), spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(found: list[WuManber]):
    def search(batches):
        for batch in batches:
            row, ids = batch.column(0), batch.column(1)
            for first, n, spans, items in _occurrences(found, batch.column(2).to_pylist()):
                spans = [[{"start": a, "end": b} for a, b in x] for x in spans]
                columns = [row.slice(first, len(n)), ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "spans", "items"])

    return search


def _items(items: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """The items that may occur, and the number of groups that they are searched for in."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    return items, 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, n_words, spans, items) with hit spans of words [start, end) and the ids, as strings, of items that occur."""
    items, groups = _items(items, group_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    if groups > 1:
        texts = Scratch(docs.sparkSession).save(texts)  # all groups see the same rows
    out = None
    for g in range(groups):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else items
        search = _search(searchers([(r.item_id, r.text) for r in own.collect()]))
        found = texts.mapInArrow(search, "row long, id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")
        out = found if out is None else out.union(found)
    if groups > 1:
        out = out.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.drop("row")


def n_hit(spans):
    """Words covered by spans that may overlap."""
    step = lambda acc, s: F.struct((acc.n + F.greatest(s.end - F.greatest(s.start, acc.last), F.lit(0).cast("long"))).alias("n"), F.greatest(acc.last, s.end).alias("last"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("last")), step, lambda acc: acc.n)


def judged(found: DataFrame) -> DataFrame:
    found = found.withColumn("n_hit", n_hit(F.col("spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def uncontaminated(docs: DataFrame, items: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; where one group holds all items, texts stay in their tasks."""
    own, groups = _items(items, group_bytes)
    if groups > 1:
        held = keyed(docs, Scratch(docs.sparkSession))
        bad = judged(contamination(held, items, KEY, group_bytes=group_bytes)).filter("contaminated").select(F.col("id").alias(KEY))
        return held.join(bad, KEY, "left_anti").select(*docs.columns)
    found = searchers([(r.item_id, r.text) for r in own.collect()])

    def clean(batches):
        for batch in batches:
            keep = []
            for _, n_words, spans, _ in _occurrences(found, batch["text"].to_pylist()):
                hit = [sum(b - a for a, b in x) for x in spans]
                keep += [not (h and 20 * h >= n) for h, n in zip(hit, n_words.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n.n, i, array_to_string(w[i : i + n.n - 1], ' ') AS s FROM d, n, unnest(range(1, len(w) - n.n + 2)) AS u(i) WHERE len(w) >= n.n),
h AS (SELECT doc_id, item_id, i, n FROM x JOIN p USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
