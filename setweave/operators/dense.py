"""Joins that keep a fixed share of all pairs, block against block: nothing is shuffled or written but the sets or bitmaps themselves.

`join.met` sends each row of a hot key to every part of the other side, so what it writes on the way grows with the square of
that key's rows. Here rows are packed into blocks, a Cartesian product of the blocks brings every two together once, and the pairs
of a task are streamed to whoever reads them. Only the result itself still grows with the square of the sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.bounds import SLACK, Similarity
from setweave.functions.signature import words
from setweave.operators.blocks import dealt, spread
from setweave.plans.stage import materialised

#: Rows of bitmaps and elements of sets in a block; blocks even of small tables, and at most (each pair of blocks is a task).
ROWS, ELEMENTS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 16, 1 << 20, 6, 64
#: Pairs that a task handles at a time; rows of a batch of results; terms multiplied at once.
STRIP, BATCH, TERMS = 1 << 22, 1 << 18, 1024

_PAIRS = "set_id_x long, set_id_y long, n_x long, n_y long"
_NAMES = ["set_id_x", "set_id_y", "n_x", "n_y", "overlap"]


def _packed(pack, columns: list[str]):
    """Each partition as one block (block, blob...): pack gets its columns."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            block = TaskContext.get().partitionId()
            blobs = pack(pa.Table.from_batches(held).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], names=["block", *columns])

    return run


def _meet(rows: DataFrame, parts: int, elements: int, pack, columns: list[str], kernel, schema: str) -> DataFrame:
    kind = ", ".join(["block long", *[f"{c} binary" for c in columns]])
    blocks = materialised(dealt(rows, parts, elements).mapInArrow(_packed(pack, columns), kind))
    blocks = blocks.repartitionById(parts, F.col("block").cast("int"))  # blocks are few, and each is a partition again
    other = blocks.withColumnsRenamed({c: f"{c}_y" for c in blocks.columns})
    # the hint: each pair of partitions is a task, where a broadcast would leave all pairs of a block to one
    return blocks.join(other.hint("shuffle_replicate_nl"), F.col("block") <= F.col("block_y")).mapInArrow(kernel, schema)


def _parts(amount: int, each: int) -> int:
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(amount / each)))


def _batches(*columns: np.ndarray):
    for a in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c[a : a + BATCH], np.int64)) for c in columns], names=_NAMES[: len(columns)])


# --- bitmaps -----------------------------------------------------------------------------------------------------


def _pack_bitmaps(table: pa.Table):
    id_, n, hi = (np.asarray(table[c].combine_chunks()) for c in ("set_id", "n", "hi"))
    order = np.lexsort((id_, n))
    sig = np.asarray(pa.concat_arrays(table["sig"].chunks).flatten()).reshape(len(id_), -1)
    return np.stack([id_, n, hi])[:, order], sig[order]


def _within_reach(width: int, t: float, needed):
    def one_way(x, y, same: bool):
        (id_x, n_x, hi_x), sig_x = x
        (id_y, n_y, _), sig_y = y
        sizes = np.append(np.flatnonzero(np.append(True, n_x[1:] != n_x[:-1])), len(n_x))
        for first, end in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True):  # x's of a size, y's not smaller and within reach
            n = n_x[first]
            low, high = np.searchsorted(n_y, n), np.searchsorted(n_y, hi_x[first], "right")
            if low >= high:
                continue
            most = n + n_y[low:high] - 2 * needed(n, n_y[low:high], t)  # bits that may differ
            tied = int(np.searchsorted(n_y[low:high], n, "right"))
            step = max(1, STRIP // int(high - low))
            for a in range(first, end, step):
                b = min(end, a + step)
                far = np.bitwise_count(sig_x[a:b, None, 0] ^ sig_y[None, low:high, 0])
                for k in range(1, width):
                    far = far.astype(np.int32) + np.bitwise_count(sig_x[a:b, None, k] ^ sig_y[None, low:high, k])
                near = far <= np.floor(most).astype(np.int32)[None, :]
                near[:, :tied] &= id_x[a:b, None] < id_y[None, low : low + tied]
                i, j = np.nonzero(near)
                i, j = i + a, j + low
                yield from _batches(id_x[i], id_y[j], n_x[i], n_y[j])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = ((np.frombuffer(r[f"rows{s}"], np.int64).reshape(3, -1), np.frombuffer(r[f"sigs{s}"], np.uint64).reshape(-1, width)) for s in ("", "_y"))
                yield from one_way(x, y, r["block"] == r["block_y"])
                if r["block"] != r["block_y"]:
                    yield from one_way(y, x, False)

    return run


def bitmap_pairs(signed: DataFrame, t: float, bits: int, sim: Similarity) -> DataFrame:
    """(set_id_x, set_id_y, n_x, n_y) of signed (set_id, n, sig): pairs whose sizes and parity bitmaps allow the overlap."""
    rows = materialised(signed.filter("set_id is not null").select("set_id", F.col("n").cast("long").alias("n"), sim.maxsize(F.col("n"), t, SLACK).cast("long").alias("hi"), "sig"))
    count, elements = rows.agg(F.count("*"), F.sum("n")).first()
    return _meet(rows, _parts(count, ROWS), elements or 0, _pack_bitmaps, ["rows", "sigs"], _within_reach(words(bits), t, sim.needed), _PAIRS)


# --- overlaps ----------------------------------------------------------------------------------------------------


def _pack_sets(table: pa.Table):
    terms = pa.concat_arrays(table["terms"].chunks)
    vocabulary, place = np.unique(np.asarray(terms.flatten()), return_inverse=True)
    return np.stack([np.asarray(table[c].combine_chunks()) for c in ("set_id", "n")]), vocabulary, place.astype(np.uint32)


def _counts(own, other, common: int):
    """(first row, overlaps of some rows of own with all of other); both are (sets, their places in the common vocabulary), by set."""
    (of_x, place_x, nx), (of_y, place_y, ny) = own, other
    order = np.argsort(place_y, kind="stable")
    posting, start = of_y[order], np.searchsorted(place_y[order], np.arange(common + 1))
    many = (start[1:] - start[:-1])[place_x]
    rows = max(1, STRIP // ny)
    dense = nx * ny * common < 100 * int(many.sum())  # a product's step takes about a hundredth of a posting's
    if dense:
        right = np.zeros((common, ny), np.float32)
        right[place_y, of_y] = 1
    for a in range(0, nx, rows):
        b = min(nx, a + rows)
        first, end = np.searchsorted(of_x, [a, b])
        if dense:
            left = np.zeros((b - a, common), np.float32)
            left[of_x[first:end] - a, place_x[first:end]] = 1
            yield a, left @ right
            continue
        out, at = np.zeros((b - a) * ny, np.int64), first
        upto = np.cumsum(many[first:end])
        while at < end:
            to = max(at + 1, first + int(np.searchsorted(upto, (upto[at - first - 1] if at > first else 0) + STRIP, "right")))
            j = spread(start[place_x[at:to]], many[at:to])
            out += np.bincount(np.repeat((of_x[at:to] - a) * ny, many[at:to]) + posting[j], minlength=len(out))
            at = to
        yield a, out.reshape(b - a, ny)


def _overlapping(batches):
    for batch in batches:
        for r in batch.to_pylist():
            sides = []
            for s in ("", "_y"):
                rows = np.frombuffer(r[f"rows{s}"], np.int64).reshape(2, -1)
                sides.append((rows, np.frombuffer(r[f"terms{s}"], np.int64), np.frombuffer(r[f"places{s}"], np.uint32)))
            common = np.intersect1d(sides[0][1], sides[1][1], assume_unique=True)
            if not len(common):
                continue
            held = []
            for rows, vocabulary, place in sides:
                at = np.minimum(np.searchsorted(common, vocabulary), len(common) - 1)
                to = np.where(common[at] == vocabulary, at, -1)[place]
                of = np.repeat(np.arange(rows.shape[1]), rows[1])[to >= 0]
                held.append((of, to[to >= 0], rows.shape[1]))
            same = r["block"] == r["block_y"]
            (id_x, n_x), (id_y, n_y) = sides[0][0], sides[1][0]
            for a, overlap in _counts(*held, len(common)):
                i, j = np.nonzero(overlap)
                value, i = overlap[i, j], i + a
                if same:
                    once = i < j
                    i, j, value = i[once], j[once], value[once]
                x, y = id_x[i], id_y[j]
                turn = x > y
                yield from _batches(np.where(turn, y, x), np.where(turn, x, y), np.where(turn, n_y[j], n_x[i]), np.where(turn, n_x[i], n_y[j]), value)


def overlaps(sets: DataFrame) -> DataFrame:
    """(set_id_x, set_id_y, n_x, n_y, overlap) of sets with a common term."""
    rows = sets.filter("n > 0 and set_id is not null").select("set_id", F.col("n").cast("long").alias("n"), F.col("terms").cast("array<long>").alias("terms"))
    elements = rows.agg(F.sum("n")).first()[0] or 0
    return _meet(rows, _parts(elements, ELEMENTS), elements, _pack_sets, ["rows", "terms", "places"], _overlapping, f"{_PAIRS}, overlap long")
