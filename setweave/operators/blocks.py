"""Self-joins of large sets, block against block: only the sets themselves are shuffled and written, never postings or candidates.

Sets are dealt by size and packed into blocks of about BLOCK elements, which hold all that a block needs whichever it meets: sets
with the same elements as one, the postings of their prefixes in order of word and size, and parity bitmaps. Blocks are written to
a few files, and every two files meet in a task, by a Cartesian product that reads both from the shared folder, so that a block isn't read
for each other one. Of two blocks with sizes that may reach the threshold, the words that both have are looked up: a posting meets those of
the sizes that its position leaves within reach; bitmaps as wide as the sets drop most of what is left, and the overlap of the
rest is counted on the full sets. The number of pairs of blocks grows with the square of the input.
"""

from __future__ import annotations

import ctypes
import math
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.bounds import SLACK, Similarity
from setweave.plans.stage import materialised

#: Elements of a block; files that even small tables are packed into, so that several tasks get pairs of them; files up to which each
#: holds a block alone, and blocks of a file where there are more than it times that.
BLOCK, LEAST_FILES, FILES, EACH = 1 << 20, 4, 12, 8
#: A row group for each block, which is compressed already.
_ALONE = {"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "compression": "none"}
#: Pairs of postings, and of sets, that are handled at once.
SLAB, VERIFIED = 1 << 17, 1 << 13
#: Bits of the bitmaps, twice a block's largest size between these; cells of marked words.
BITS, MOST_BITS, MARKED = 512, 1 << 16, 1 << 23

_FOUND = "set_id_x long, set_id_y long, n_x long, n_y long, overlap long"
_IN_PAIRS = "set_id long, n_x long, n_y long, overlap long"
_COLUMNS = ("n", "hi", "mid", "most")


@contextmanager
def _settings(spark: SparkSession, **values: str):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What a block holds: ids in order of their sets; where each set's ids begin, the sets' sizes; words and the places of the sets'
#: elements among them; postings of prefixes by word and size: word, set, and the sizes up to which a partner may be, whose first
#: common element this is: larger ones (none if 0), and smaller ones; parity bitmaps.
_HELD = {"ids": "<i8", "members": "<u4", "n": "<i4", "words": "<i8", "place": "<i4", "word": "<i4", "of": "<i4", "larger": "<i4", "smaller": "<i4", "bits": "<u8"}


def _most(first: np.ndarray, last: np.ndarray, holds) -> np.ndarray:
    """The last number from first to last that holds, for each, where all up to it do; first - 1 if none does."""
    low, high = first - 1, last.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        good = holds(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _block(columns: np.ndarray, terms: np.ndarray, t: float, needed) -> dict[str, np.ndarray]:
    """Sets with the same elements as one; columns: set_id, n, hi, mid, most."""
    words, places = np.unique(terms, return_inverse=True)
    places = places.astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(columns[1])])
    known: dict[bytes, int] = {}
    kind = np.array([known.setdefault(places[a:b].tobytes(), len(known)) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)])
    first = np.unique(kind, return_index=True)[1]
    out = {"ids": columns[0][np.argsort(kind, kind="stable")], "members": np.concatenate([[0], np.cumsum(np.bincount(kind))]), "words": words}
    n, hi, mid, most = columns[1:, first]
    out["n"], out["place"] = n, places[spread(begin[first], n)]
    begin = np.concatenate([[0], np.cumsum(n)])
    most = np.clip(most, 0, n)
    sizes, own = np.unique(n, return_index=True)  # what follows from size and position alone is reckoned once for each
    table = np.concatenate([[0], np.cumsum(most[own])])
    size, pos, reach = np.repeat(sizes, most[own]), spread(np.zeros(len(own), np.int64), most[own]), np.repeat(hi[own], most[own])
    larger = _most(size, reach, lambda v: needed(size, v, t) <= size - pos)
    larger = np.where((larger >= size) & (pos < np.repeat(mid[own], most[own])), larger, 0)
    smaller = _most(np.ones_like(size), size, lambda v: needed(v, size, t) <= size - pos)
    at = spread(begin[:-1], most)
    of = np.repeat(np.arange(len(n)), most)
    row = at - begin[of] + table[np.searchsorted(sizes, n)][of]
    word = out["place"][at]
    order = np.argsort((word.astype(np.int64) << 32) | n[of], kind="stable")
    out |= {"word": word[order], "of": of[order], "larger": larger[row][order], "smaller": smaller[row][order]}
    width = min(MOST_BITS, max(BITS, 1 << int(2 * n.max() - 1).bit_length()))
    bits, step = np.empty((len(n), width // 64), np.uint64), max(1, (1 << 22) // width)
    for a in range(0, len(n), step):
        b = min(len(n), a + step)
        bit = words[out["place"][begin[a] : begin[b]]] & (width - 1)
        cells = np.bincount(np.repeat(np.arange(b - a), n[a:b]) * width + bit, minlength=(b - a) * width)
        bits[a:b] = np.packbits((cells & 1).astype(np.uint8).reshape(b - a, width), axis=1).view(np.uint64)
    return out | {"bits": bits}


def _lean() -> None:
    """Gives back what a reused worker holds from earlier stages, and from now on what large arrays took as soon as they go."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not everywhere
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def _pack(t: float, needed):
    def pack(batches):
        _lean()
        task, number, rows, size = TaskContext.get().partitionId() if TaskContext.get() else 0, 0, [], 0

        def block():
            nonlocal number, size
            columns, terms = np.concatenate([r[0] for r in rows], axis=1), np.concatenate([r[1] for r in rows])
            rows.clear()
            held = _block(columns, terms, t, needed)
            parts = [np.ascontiguousarray(held[k], kind) for k, kind in _HELD.items()]
            head = np.array([p.size for p in parts], np.int64)
            blob = zstandard.ZstdCompressor(1).compress(b"".join([head.tobytes(), *[p.tobytes() for p in parts]]))
            numbers = [(task << 32) | number, int(columns[1].min()), int(columns[2].max())]
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in numbers], pa.array([blob], pa.binary())], names=["block", "least", "reach", "blob"])

        for batch in batches:
            ends = np.asarray(batch["terms"].offsets)
            flat = np.asarray(batch["terms"].values)
            columns = np.stack([np.asarray(batch[c]) for c in ("set_id", *_COLUMNS)])
            at = 0
            while at < batch.num_rows:
                upto = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK * 3 // 2 - size, "right")) - 1))
                rows.append((columns[:, at:upto], flat[ends[at] : ends[upto]]))
                size += int(ends[upto] - ends[at])
                at = upto
                if at < batch.num_rows:  # half as large again at most
                    yield block()
        if rows:
            yield block()

    return pack


class Block:
    """The sets of a block, those with the same elements as one: representatives, and the ids that each stands for."""

    def __init__(self, blob: pa.Buffer):
        raw, at = zstandard.ZstdDecompressor().decompress(blob), 8 * len(_HELD)
        for (name, kind), size in zip(_HELD.items(), np.frombuffer(raw, np.int64, len(_HELD)).tolist(), strict=True):
            setattr(self, name, np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        self.bits = self.bits.reshape(len(self.n), -1)
        self.begin = np.concatenate([[0], np.cumsum(self.n, dtype=np.int64)])
        self.key = (self.word.astype(np.int64) << 32) | self.n[self.of]

    def bitmaps(self, width: int) -> np.ndarray:
        """Parity bitmaps of that many words: a bitmap's halves add up to one of half its bits."""
        out = self.bits
        while out.shape[1] > width:
            out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
        return out


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] numbers, then those of the next."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - count - begin, count)


def _met(x: Block, y: Block, to_y: np.ndarray, same: bool, strict: bool):
    """Pairs (x, y) of sets, x's no larger than y's (smaller if strict), with a common term that sizes and positions allow to be the first."""
    word = to_y[x.word]
    some = np.flatnonzero((x.larger > 0) & (word >= 0))
    word, of = word[some].astype(np.int64) << 32, x.of[some]
    low = np.searchsorted(y.key, word | x.n[of], "right" if strict else "left")  # in order of word and size
    many = np.maximum(np.searchsorted(y.key, word | x.larger[some], "right") - low, 0)
    some = np.flatnonzero(many)
    some = some[np.argsort(of[some], kind="stable")]
    of, low, many = of[some], low[some], many[some]
    sets = _begins(of)
    upto = np.append(np.cumsum(many) - many, many.sum())[np.append(sets, len(of))]
    a, ny = 0, np.int64(len(y.n))
    while a < len(sets):  # all that a set meets at once
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + SLAB, "right")) - 1)
        own = slice(sets[a], sets[b] if b < len(sets) else len(of))
        j, i = spread(low[own], many[own]), np.repeat(of[own], many[own])
        keep = np.flatnonzero(x.n[i] <= y.smaller[j])
        i, k = i[keep], y.of[j[keep]]
        if same:  # one block: of two sets of a size, the first
            keep = (x.n[i] < y.n[k]) | (i < k)
            i, k = i[keep], k[keep]
        if len(i):
            base = int(i[0])
            code, cells = (i - base).astype(np.int64) * ny + k, (int(i[-1]) - base + 1) * int(ny)
            if cells <= 32 * len(code):
                seen = np.zeros(cells, bool)
                seen[code] = True
                code = np.flatnonzero(seen)
            else:
                code.sort()
                code = code[_begins(code)]
            i, k = np.divmod(code, ny)
            yield i + base, k
        a = b


def _begins(names: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])


def _overlaps(x: Block, y: Block, to_y: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Overlaps of pairs in order of i: the words of some x's are marked, and looked up for the elements of their y's."""
    out, v, a = np.zeros(len(i), np.int64), len(y.words), 0
    most = max(1, MARKED // v)
    marks = np.zeros(min(most, len(np.unique(i))) * v, bool)
    load = np.concatenate([[0], np.cumsum(y.n[k], dtype=np.int64)])
    row = np.cumsum(np.append(True, i[1:] != i[:-1])) - 1
    while a < len(i):
        b = max(a + 1, min(int(np.searchsorted(load, load[a] + SLAB, "right")) - 1, int(np.searchsorted(row, row[a] + most))))
        own = np.unique(i[a:b])
        place = to_y[x.place[spread(x.begin[own], x.n[own])]]
        cell = np.repeat(np.arange(len(own)) * v, x.n[own]) + place
        cell = cell[place >= 0]
        marks[cell] = True
        n = y.n[k[a:b]]
        hit = marks[np.repeat((row[a:b] - row[a]) * v, n) + y.place[spread(y.begin[k[a:b]], n)]]
        out[a:b] = np.add.reduceat(hit, load[a:b] - load[a], dtype=np.int64)
        marks[cell] = False
        a = b
    return out


def _expanded(x: Block, y: Block, i, k, overlap):
    nx, ny = np.diff(x.members.astype(np.int64))[i], np.diff(y.members.astype(np.int64))[k]
    for a in range(0, len(i), 1024):
        own = slice(a, a + 1024)
        each = nx[own] * ny[own]
        pair = np.repeat(np.arange(len(each)), each)
        within = spread(np.zeros(len(each), np.int64), each)
        u = x.ids[x.members[i[own]][pair] + within // ny[own][pair]]
        v = y.ids[y.members[k[own]][pair] + within % ny[own][pair]]
        yield from _rows(u, v, x.n[i[own]][pair], y.n[k[own]][pair], overlap[own][pair])


def _rows(*columns, names=("set_id_x", "set_id_y", "n_x", "n_y", "overlap")):
    for a in range(0, len(columns[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 18)].astype(np.int64)) for c in columns], names=list(names))


def _members(x: Block, sets: np.ndarray, *columns: np.ndarray):
    """A row for each id that one of those sets stands for."""
    for a in range(0, len(sets), 1024):
        own = sets[a : a + 1024]
        many = x.members[own + 1].astype(np.int64) - x.members[own]
        yield from _rows(x.ids[spread(x.members[own].astype(np.int64), many)], *[np.repeat(c[a : a + 1024], many) for c in columns], names=("set_id", "n_x", "n_y", "overlap"))


def _partnered(x: Block, y: Block, i, k, overlap):
    for z, own in ((x, i), (y, k)):  # of each set the pairs that differ in what they are judged by
        rows = np.unique(np.stack([own, x.n[i], y.n[k], overlap]).astype(np.int64), axis=1)
        yield from _members(z, *rows)


def _copies(x: Block):
    """Pairs of sets with the same elements within a block."""
    for kind in np.flatnonzero(np.diff(x.members) > 1).tolist():
        ids, n = x.ids[x.members[kind] : x.members[kind + 1]], x.n[kind]
        for m in range(1, len(ids)):
            yield np.repeat(ids[m], m), ids[:m], np.repeat(n, m), np.repeat(n, m), np.repeat(n, m)


def _gathered(pieces, size: int = 1 << 16):
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= size:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _kernel(t: float, needed, pairs: bool):
    expanded = _expanded if pairs else _partnered

    def one_way(x: Block, y: Block, same: bool, strict: bool):
        if int(x.n.min()) + strict > int(y.n.max()):
            return
        at = np.minimum(np.searchsorted(y.words, x.words), len(y.words) - 1)
        to_y = np.where(y.words[at] == x.words, at, -1).astype(np.int32)
        width = min(x.bits.shape[1], y.bits.shape[1])
        bits_x, bits_y = x.bitmaps(width), y.bitmaps(width)
        step = max(1, SLAB // width)

        def near():
            for i, k in _met(x, y, to_y, same, strict):
                for a in range(0, len(i), step):
                    u, v = i[a : a + step], k[a : a + step]
                    far = np.bitwise_count(bits_x[u] ^ bits_y[v]).sum(axis=1, dtype=np.int32)
                    own = np.flatnonzero((x.n[u] + y.n[v] - far) / 2 >= needed(x.n[u].astype(np.int64), y.n[v].astype(np.int64), t))
                    if len(own):
                        yield u[own], v[own]

        for i, k in _gathered(near(), VERIFIED):
            overlap = _overlaps(x, y, to_y, i, k)
            some = overlap >= needed(x.n[i].astype(np.int64), y.n[k].astype(np.int64), t)
            yield x, y, i[some], k[some], overlap[some]

    def run(batches):
        _lean()
        x, y, last = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                block, other = batch["block"][at].as_py(), batch["block_y"][at].as_py()
                same = block == other
                if block != last:  # a task brings all others to a block before the next
                    x, y, last = None, None, block
                    x = Block(batch["blob"][at].as_buffer())
                y = None
                y = x if same else Block(batch["blob_y"][at].as_buffer())
                for met in one_way(x, y, same, False):
                    yield from expanded(*met)
                if same and pairs:
                    for rows in _gathered(_copies(x)):
                        yield from _rows(*rows)
                elif same:
                    sets = np.flatnonzero(np.diff(x.members) > 1)
                    yield from _members(x, sets, x.n[sets], x.n[sets], x.n[sets])
                else:
                    for met in one_way(y, x, False, True):
                        yield from expanded(*met)

    return run


def dealt(rows: DataFrame, parts: int, elements: int) -> DataFrame:
    """rows in order of n in that many partitions of about as many elements each; a size that fills several is dealt by id."""
    spark, sizes, start = rows.sparkSession, [], 0
    for n, many in sorted(tuple(r) for r in rows.groupBy("n").count().collect()):  # a row for each size that sets have
        sizes.append((n, start, many))
        start += n * many
    sizes = F.broadcast(spark.createDataFrame(sizes, "n long, start long, many long"))
    place = F.col("start") + F.pmod(F.xxhash64("set_id"), F.col("many")) * F.col("n")
    part = F.least(F.floor(place * F.lit(parts / max(1, elements))), F.lit(parts - 1)).cast("int")
    return rows.join(sizes, "n").repartitionById(parts, part).select(*rows.columns)


def found(sets: DataFrame, elements: int, t: float, sim: Similarity, pairs: bool = True) -> DataFrame:
    """(set_id_x, set_id_y, n_x, n_y, overlap): all pairs that reach the smallest overlap of t, and no other; sets hold `elements` in all.

    Not pairs: (set_id, n_x, n_y, overlap) of the sets in such pairs, so that copies aren't expanded into all pairs.

    sim has `needed(a, b, t)` besides the protocol: minoverlap with slack, for arrays of numbers.
    """
    spark, n = sets.sparkSession, F.col("n")
    bounds = [sim.maxsize(n, t, SLACK), sim.midprefix(n, t, SLACK), sim.maxprefix(n, t, SLACK)]
    columns = [n.cast("long"), *[c.cast("long").alias(k) for c, k in zip(bounds, _COLUMNS[1:], strict=True)]]
    rows = sets.filter(n > 0).select("set_id", *columns, "terms")
    many = math.ceil(elements / BLOCK)
    rows = dealt(rows, max(LEAST_FILES, min(many, FILES), many // EACH), elements)
    kind = "block long, least long, reach long, blob binary"
    one = "1"
    with _settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        blocks = materialised(rows.mapInArrow(_pack(t, sim.needed), kind), **_ALONE)
    whole = str(1 << 30)  # each file is a partition
    with _settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=one, spark__sql__files__maxPartitionBytes=whole, spark__sql__files__openCostInBytes=whole):
        other = blocks.withColumnsRenamed({c: f"{c}_y" for c in blocks.columns})
        return materialised(blocks.crossJoin(other).filter("block <= block_y and least <= reach_y and least_y <= reach").mapInArrow(_kernel(t, sim.needed, pairs), _FOUND if pairs else _IN_PAIRS))
