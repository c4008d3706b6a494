"""MinHash near-dedup (operator 4) on five-word shingles.

Every text becomes its set of distinct shingles. Equal sets form one class, whose smallest id stands for it. A class
has a fast similarity sketch: in round i each element is hashed to a bin, in the first T rounds to a random bin and in
the next T to bin i - T, and a bin keeps the smallest (round, value) it saw. All bins are therefore filled after at most
2T rounds, and the fraction of equal bins is concentrated around the Jaccard similarity. Bands of four bins give the
candidates, which the full sets confirm.

Candidates are not all pairs of a bucket: each bucket first links its members to its smallest one; only where a bucket
still spans several components are its members compared, by sketch and in tiles of a bounded size, and first each
with its likeliest partner outside its component. What is left after that is verified inside the tile, on the texts of
the members that still have candidates, so no link between components is lost and no pair becomes a row; links inside a
component no longer matter for the result.

Two members of a group meet in no bucket with a chance of 5e-6 at the threshold, and are estimated below LEAST_ESTIMATE
with one under 1e-6. With exact=True neither is left to chance: links then come from the prefix join of the full sets.

Null texts, empty texts and texts without words have no shingles and link with nothing. Ties are settled by the
smaller id. Every row is a document of its own, also where its id is null or repeats that of another row; a component is
named by its smallest id that isn't null (null if it has none). An empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import KEY, NOT_BLANK, U64, Scratch, connected_components, has_keys, keyed, mix, sliced, words_of
from setweave.operators.join import self_join

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
WORDS, PERCENT = 5, 75
#: Pairs below this estimated similarity are not verified: it lies five standard deviations below the threshold.
LEAST_ESTIMATE = 0.55
#: Members of a bucket that meet in one task; larger buckets are split into pairs of such tiles.
TILE = 2048
_SEEDS = mix(np.arange(1, 2 * BINS + 2, dtype=U64) * U64(0xD1342543DE82EF95))
_PLACES = mix(np.arange(11, 11 + WORDS, dtype=U64)) | U64(1)


def shingle_sets(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes of the distinct shingles sorted within each text, bounds of the texts)."""
    for first, held in sliced(texts):
        _, _, _, h, bound = words_of(held, NOT_BLANK)
        n = np.diff(bound)
        size = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(held)), size)
        begin = np.zeros(len(held) + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        at = bound[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
        padded = np.concatenate([h, np.zeros(WORDS, U64)])
        value = np.zeros(len(at), U64)
        for k in range(WORDS):
            value += np.where(k < n[owner], padded[at + k], U64(0)) * _PLACES[k]
        value = mix(value + np.minimum(n, WORDS)[owner].astype(U64))
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield first, value, np.searchsorted(owner, np.arange(len(held) + 1))


def sketches(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """One row of BINS uint64 per set: round in the top bits, then the value; sets must not be empty."""
    n_sets = len(bound) - 1
    out = np.full(n_sets * BINS, np.iinfo(np.uint64).max, U64)
    owner = np.repeat(np.arange(n_sets), np.diff(bound))
    for i in range(2 * BINS):
        h = mix(values ^ _SEEDS[i])
        place = (h % U64(BINS)).astype(np.int64) if i < BINS else np.full(len(h), i - BINS)
        low = (U64(i) << U64(48)) | (h >> U64(16))
        slot = owner * BINS + place
        order = np.lexsort((low, slot))
        slot, low = slot[order], low[order]
        head = np.ones(len(slot), bool)
        head[1:] = slot[1:] != slot[:-1]
        out[slot[head]] = np.minimum(out[slot[head]], low[head])
        open_set = (out.reshape(n_sets, BINS) == np.iinfo(np.uint64).max).any(1)
        if not open_set.any():
            break
        stay = open_set[owner]
        values, owner = values[stay], owner[stay]
    return out.reshape(n_sets, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    grouped = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(1), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key


def _sign(batches):
    for batch in batches:
        ids = batch.column(0)
        for first, values, bound in shingle_sets(batch.column(1).to_pylist()):
            n = np.diff(bound)
            some = np.flatnonzero(n)
            doubled = mix(values ^ U64(0x5851F42D4C957F2D))
            sums = [np.add.reduceat(np.append(v, U64(0)), np.minimum(bound[:-1], len(v))) for v in (values, doubled)]
            keys = np.zeros((len(n), BANDS), U64)
            short = np.zeros((len(n), BINS), np.uint16)
            if len(some):
                sk = sketches(values, np.append(bound[:-1][some], bound[-1]))
                keys[some], short[some] = band_keys(sk), (mix(sk) >> U64(48)).astype(np.uint16)
            part = ids.slice(first, len(n))
            yield pa.RecordBatch.from_arrays(
                [
                    part,
                    pa.array(n, pa.int64()),
                    *[pa.array(np.where(n > 0, s, U64(0)).view(np.int64)) for s in sums],
                    pa.array([k.tobytes() if m else None for k, m in zip(keys, n, strict=True)], pa.binary()),
                    pa.array([k.tobytes() if m else None for k, m in zip(short, n, strict=True)], pa.binary()),
                ],
                names=["id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )


_SIGNED = "id long, n_shingles long, f1 long, f2 long, bands binary, sketch binary"


def _explode(batches):
    for batch in batches:
        ids = np.asarray(batch.column(0))
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, BANDS))], names=["key", "id"])


def _confirm(batches):
    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        seen: dict[int, np.ndarray] = {}
        need = dict(zip([*a, *b], [*ta, *tb], strict=True))
        names = list(need)
        for first, values, bound in shingle_sets(need.values()):
            for k in range(len(bound) - 1):
                seen[names[first + k]] = values[bound[k] : bound[k + 1]]
        keep = []
        for x, y in zip(a, b, strict=True):
            p, q = seen[x], seen[y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    known = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    known = known.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return known.select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long")


class _Bucket:
    """Members of a tile of one bucket, with the pairs that may link two of their components."""

    def __init__(self, group: pa.Table):
        self.ids, self.comp, self.side = (np.asarray(group[c]) for c in ("id", "comp", "side"))
        self.sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(-1, BINS)
        self.bands = np.frombuffer(b"".join(group["bands"].to_pylist()), np.int64).reshape(-1, BANDS)
        self.here = int(np.flatnonzero(self.bands[0] == group["key"][0].as_py())[0])
        self.two = self.side.max() != self.side.min()
        names, count = np.unique(self.comp, return_counts=True)
        self.largest = names[count.argmax()]

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(member, members of other components that may link with it, their estimates); each pair once."""
        for i in np.flatnonzero(self.comp != self.largest):
            ok = (self.comp != self.comp[i]) & ((self.comp == self.largest) | (self.ids > self.ids[i]))
            if self.two:
                ok &= self.side != self.side[i]
            j = np.flatnonzero(ok)
            estimate = (self.sketch[j] == self.sketch[i]).mean(1)
            keep = estimate >= LEAST_ESTIMATE
            yield int(i), j[keep], estimate[keep]

    def first_here(self, i: int, j: np.ndarray) -> np.ndarray:
        """Those of j that meet i in no earlier band than this bucket's."""
        return j[(self.bands[j] == self.bands[i]).argmax(1) == self.here]


def _likeliest(group: pa.Table) -> pa.Table:
    bucket, pairs = _Bucket(group), []
    for i, j, estimate in bucket.candidates():
        if len(j):
            pairs.append(sorted((int(bucket.ids[i]), int(bucket.ids[j[estimate.argmax()]]))))
    return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})


def _undecided(group: pa.Table) -> pa.Table:
    """The members with a candidate that this bucket has to decide."""
    bucket, some = _Bucket(group), np.zeros(group.num_rows, bool)
    for i, j, _ in bucket.candidates():
        j = bucket.first_here(i, j)
        some[j] = True
        some[i] |= len(j) > 0
    return group.filter(pa.array(some))


def _settle(group: pa.Table) -> pa.Table:
    """Confirms candidates on full sets; links between components that this tile already joined aren't looked for again."""
    bucket, sets = _Bucket(group), [None] * group.num_rows
    for first, values, bound in shingle_sets(group["text"].to_pylist()):
        for k in range(len(bound) - 1):
            sets[first + k] = values[bound[k] : bound[k + 1]]
    up: dict[int, int] = {}

    def find(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    a, b = [], []
    for i, j, _ in bucket.candidates():
        for k in bucket.first_here(i, j).tolist():
            u, v = find(int(bucket.comp[i])), find(int(bucket.comp[k]))
            if u != v:
                p, q = sets[i], sets[k]
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                if 100 * both >= PERCENT * (len(p) + len(q) - both):
                    up[max(u, v)] = min(u, v)
                    a.append(int(bucket.ids[i]))
                    b.append(int(bucket.ids[k]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _unsettled(buckets: DataFrame, component: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, id, comp, n) of the buckets that span several components."""
    placed = buckets.join(component.withColumnRenamed("component", "comp"), "id", "left")
    placed = placed.withColumn("comp", F.coalesce("comp", "id"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    return placed.join(scratch.save(mixed.filter("lo < hi").select("key", "n")), "key")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows of a bucket of over TILE members go to every pair of its tiles that has theirs."""
    rows = rows.withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = rows.select("*", other)
    return rows.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))


def _set_rows(batches):
    for batch in batches:
        for first, values, bound in shingle_sets(batch.column(1).to_pylist()):
            terms = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(np.sort(values.view(np.int64)) if len(bound) == 2 else np.concatenate([np.sort(values[s:e].view(np.int64)) for s, e in zip(bound, bound[1:])])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(bound) - 1), pa.array(np.diff(bound), pa.int64()), terms], names=["set_id", "n", "terms"])


def exact_links(texts: DataFrame) -> DataFrame:
    """(a, b): all linked pairs of rows (id, text), by a prefix join of their shingle sets (as 64-bit hashes)."""
    sets = texts.mapInArrow(_set_rows, "set_id long, n long, terms array<long>").filter("n > 0")
    return self_join(sets, PERCENT / 100, strategy="prefix").select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, exact: bool = False) -> DataFrame:
    """(id, n_shingles, component) for each row of docs."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if has_keys(rows, "id"):
        return _classes(rows, scratch, exact)
    held = keyed(rows, scratch)
    found = _classes(held.select(F.col(KEY).alias("id"), "text"), scratch, exact)
    found = scratch.save(found.withColumnRenamed("id", KEY).join(held.select(KEY, "id"), KEY))
    names = found.groupBy("component").agg(F.min("id").alias("name"))
    return found.join(names, "component").select("id", "n_shingles", F.col("name").alias("component"))


def _classes(texts: DataFrame, scratch: Scratch, exact: bool) -> DataFrame:
    """near_duplicates for rows (id, text) whose ids name them."""
    signed = scratch.save(texts.mapInArrow(_sign, _SIGNED))
    full = signed.filter("n_shingles > 0")
    # groups are written before they meet their rows: the join then has exchanges of its own, whose hot keys can be split
    same = full.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = full.select("id", "f1", "f2", "n_shingles").join(scratch.save(same), ["f1", "f2", "n_shingles"], "left")
    members = scratch.save(members.select("id", F.coalesce("rep", "id").alias("rep")))
    reps = members.filter("id = rep").select("id")
    if exact:
        component = connected_components(exact_links(texts.join(reps, "id")), scratch)
        return _named(signed, members, component)
    heads = scratch.save(full.select("id", "bands", "sketch").join(reps, "id"))
    exploded = heads.select("id", "bands").mapInArrow(_explode, "key long, id long")
    centre = exploded.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.save(exploded.join(scratch.save(centre.drop("n")), "key"))
    stars = buckets.filter("id > centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.save(confirmed(stars, texts))
    buckets = buckets.select("key", "id")
    component = connected_components(links, scratch)
    tile, schema = ["key", "lo", "hi"], "key long, lo int, hi int, id long, comp long, side int, sketch binary, bands binary"
    for last in (False, True):
        rows = _tiled(_unsettled(buckets, component, scratch)).join(heads, "id").select(*[c.split()[0] for c in schema.split(", ")])
        if last:
            rows = scratch.save(rows.groupBy(*tile).applyInArrow(_undecided, schema)).join(texts, "id")
            more = scratch.save(rows.groupBy(*tile).applyInArrow(_settle, "a long, b long"))
        else:
            more = scratch.save(confirmed(rows.groupBy(*tile).applyInArrow(_likeliest, "a long, b long").distinct(), texts))
        if not more.isEmpty():
            links = links.union(more)
            component = connected_components(links, scratch)
    return _named(signed, members, component)


def _named(signed: DataFrame, members: DataFrame, component: DataFrame) -> DataFrame:
    out = members.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    return signed.select("id", "n_shingles").join(out, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
