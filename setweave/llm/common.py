"""Shared pieces: scratch tables in the shared folder, vectorised hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the polynomial hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Texts are hashed together up to this many bytes at a time.
SLICE_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
ALNUM_OR_HIGH = np.zeros(256, bool)
ALNUM_OR_HIGH[48:58] = ALNUM_OR_HIGH[97:123] = ALNUM_OR_HIGH[65:91] = ALNUM_OR_HIGH[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        table = np.full(size, base, U64)
        table[0] = 1
        _powers[base] = have = np.cumprod(table, dtype=U64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """p with len(buf) + 1 entries; substring_hash(p, s, e) depends only on the bytes in between."""
    p = np.empty(len(buf) + 1, U64)
    p[0] = 0
    np.cumsum(BYTE_CODES[buf] * powers(BASE, len(buf))[: len(buf)], dtype=U64, out=p[1:])
    return p


def substring_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (p[end] - p[start]) * powers(INVERSE, len(p))[start]


def sliced(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) in slices of about SLICE_BYTES."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if held and size + len(b) > SLICE_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def words_of(texts: list[bytes], is_word: np.ndarray):
    """(bytes lower-cased, word starts, word ends, word hashes, first word of each text and the total)."""
    buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = is_word[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = mix(substring_hash(prefix_hashes(buf), starts, ends) + (ends - starts).astype(U64))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return buf, starts, ends, hashes, np.searchsorted(starts, offsets)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set (local runs and tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="setweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written below the shared folder: they cut lineage and outlive lost executors.

    Within `with released():`, the tables of all that was opened inside are removed at its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_folder(spark)}/setweave-{uuid.uuid4().hex}"
        self.n = 0
        if _opened:
            _opened[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        before = self.spark.conf.get(_TIDY, None)
        try:
            self.spark.conf.set(_TIDY, "true")  # the exchanges of a table that is written are over with it
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_TIDY) if before is None else self.spark.conf.set(_TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def remove(self) -> None:
        """Removes all of its tables; what is still to be computed from them can't be any more."""
        self._delete(self.top)


_opened: list[list[Scratch]] = []


@contextmanager
def released():
    """For a result that is written inside: what its operators wrote on the way is removed after it."""
    _opened.append([])
    try:
        yield
    finally:
        for scratch in _opened.pop():
            scratch.remove()


#: Names the rows of a table where ids may be null or repeat.
KEY = "_row"


def keyed(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df, written with a number for each of its rows, so that all who read it see the same ones."""
    return scratch.save(df.withColumn(KEY, F.monotonically_increasing_id()))


def has_keys(df: DataFrame, id_col: str) -> bool:
    """Whether the ids name the rows: none is null and none repeats."""
    ids = df.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.filter("id is null or n > 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps written as a partial aggregation and an equi-join, so that a
    centre with many neighbours is neither gathered in one task nor sent to the driver. Each step replaces links by links
    to smaller ids until none changes, so it ends on any graph.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs = scratch.save(pairs)
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        after = scratch.save(small.filter("u > v").distinct())
        scratch.drop(pairs)
        pairs = after
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    members = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def crc32_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
