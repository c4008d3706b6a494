"""Embedding near-dedup (operator 3): int8 tile products with rigorous error bounds.

A vector x of unit length is quantised to round(x / s) with its own step s = max|x| / 127. Then the product of two
quantised vectors, times both steps, differs from the cosine by at most |e_x| + |e_y| + |e_x||e_y|, where e is the
vector of rounding errors and |e| its measured length: only pairs that reach the threshold less this bound are computed
again, in double precision. Products of int8 are summed by float32 BLAS over at most EXACT components at a time, so that
each sum stays below 2**24 and is exact, and in double precision across these; SLACK covers the rounding of the double
precision arithmetic around it, for any length of vector.

Vectors are grouped around pivots into blocks of at most about BLOCK rows, so that a block pair whose cones lie further
apart than the threshold's angle is skipped by the triangle inequality for angles. Lengths of vectors with fewer than 8 *
BLOCK rows have no pivots and share one job. Each remaining block pair is one task's tile. A tile returns one row for each
vector and the edges of a spanning forest, never all its pairs; equal vectors are counted once with their number, so large
groups of copies cost one row.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of unlike
lengths do not link with each other. Every row is a vector of its own, also where its id is null or repeats that of another
row; a component is named by its smallest id that isn't null (null if it has none). Only the id and vector columns are
read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import Scratch, connected_components

#: Rows of a block, and pivots at most (what the driver holds and tasks are sent: MAX_PIVOTS vectors).
BLOCK, MAX_PIVOTS = 4096, 512
#: Rows of a tile multiplied at a time.
STRIP = 1024
#: Components whose products of int8 float32 sums exactly: 127 * 127 * EXACT < 2**24.
EXACT = 1024


def slack(d: int) -> float:
    """What rounding in double precision may add to the bound, for vectors of d components."""
    return 1e-9 + 16 * d * np.finfo(np.float64).eps


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers as float32, steps, lengths of the error vectors (rounded up)."""
    step = np.abs(x).max(1) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * step[:, None]) ** 2).sum(1)) + 1e-12
    return q.astype(np.float32), step, error


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, v: int) -> int:
        while self.up[v] != v:
            self.up[v] = self.up[self.up[v]]
            v = self.up[v]
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float):
    """Yields (rows i of left, rows j of right) with cosine >= threshold; right None: within left, i < j."""
    own = right is None
    right = left if own else right
    qa, sa, ea = quantised(left)
    qb, sb, eb = (qa, sa, ea) if own else quantised(right)
    most, step = eb.max(initial=0), sb.max(initial=0)
    for at in range(0, len(left), STRIP):
        rows = slice(at, at + STRIP)
        products = qa[rows, :EXACT] @ qb[:, :EXACT].T
        for k in range(EXACT, left.shape[1], EXACT):
            products = products.astype(np.float64) + qa[rows, k : k + EXACT] @ qb[:, k : k + EXACT].T
        # the least that any column asks of a row, rounded down, in the products' own precision: few pairs are left to the bound itself
        room = threshold - slack(left.shape[1]) - (ea[rows] + most + ea[rows] * most)
        least = np.where(room > 0, room / (sa[rows] * step) * (1 - 1e-9), -np.inf).astype(products.dtype)
        i, j = np.nonzero(products >= np.nextafter(least, -np.inf, dtype=products.dtype)[:, None])
        near = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)] + at, j[k : k + (1 << 18)]
            near[k : k + (1 << 18)] = products[a - at, b] >= (threshold - slack(left.shape[1]) - (ea[a] + eb[b] + ea[a] * eb[b])) / (sa[a] * sb[b])
        i, j = i[near] + at, j[near]
        if own:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            ok = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
            yield a[ok], b[ok]


def _tile(threshold: float):
    def tile(group: pa.Table) -> pa.Table:
        block = np.asarray(group["block"])
        order = np.lexsort((np.asarray(group["id"]), block))
        group, block = group.take(pa.array(order)), block[order]
        ids, weight = np.asarray(group["id"]), np.asarray(group["copies"])
        x = unit(pa.concat_arrays(group["v"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))  # of one length
        cut = int(np.searchsorted(block, block[-1]))
        links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        within = group["x"][0].as_py() == group["y"][0].as_py()
        parts = tile_links(x, None, threshold) if within else tile_links(x[:cut], x[cut:], threshold) if cut else ()
        for a, b in parts:
            b = b if within else b + cut
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            edges += [(ids[p], ids[q]) for p, q in zip(a.tolist(), b.tolist(), strict=True) if forest.join(p, q)]
        some = np.flatnonzero(links)
        a, b = [p for p, _ in edges], [q for _, q in edges]
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[some], np.array(a, np.int64)])),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
                "other": pa.array([None] * len(some) + [int(q) for q in b], pa.int64()),
            }
        )

    return tile


def _homes(pivots: np.ndarray):
    def homes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch["v"].to_pylist()
            cell, angle = np.zeros(len(v), np.int64), np.full(len(v), np.pi)
            fits = np.array([len(u) == pivots.shape[1] for u in v])
            if fits.any():
                dots = unit([u for u, ok in zip(v, fits, strict=True) if ok]) @ pivots.T
                cell[fits] = dots.argmax(1)
                angle[fits] = np.arccos(np.clip(dots.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["id", "v", "copies", "cell", "angle"])

    return homes


def _few(sized: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows by tile of the lengths too rare for pivots, all of them in one job: a length's tiles are all pairs of its parts."""
    rows = sized.join(lengths.select("cell", F.ceil(F.col("n") / BLOCK).alias("parts")), "cell")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("mate_part"))
    name = lambda p: F.col("cell") * F.lit(1 << 32) + F.col(p)
    rows = rows.withColumn("block", name("part")).withColumn("other", name("mate_part"))
    return rows.select("id", "v", "copies", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_links, component) for each row."""
    spark = table.sparkSession
    scratch = scratch or Scratch(spark)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.transform("v", lambda c: c + F.lit(0.0))))
    good = rows.filter("v is not null")
    # equal vectors are one; they are told apart by a number of their own, as ids may be null or repeat
    distinct = good.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    distinct = scratch.save(distinct.select(F.monotonically_increasing_id().alias("id"), "least", "v", "copies"))
    sized = distinct.select("id", "v", "copies", F.size("v").cast("long").alias("cell"))
    per_length = scratch.save(sized.groupBy("cell").agg(F.count("*").alias("n")))
    few = F.col("n") < 8 * BLOCK
    tiles = [_few(sized, per_length.filter(few)).groupBy("x", "y").applyInArrow(_tile(threshold), "id long, links long, other long")]
    for length, n in sorted(tuple(r) for r in per_length.filter(~few).collect()):
        one = distinct.select("id", "v", "copies").filter(F.size("v") == length)
        k = min(MAX_PIVOTS, n // (4 * BLOCK))
        pivots = unit([r.v for r in one.orderBy(F.xxhash64("v"), "id").limit(k).collect()])
        placed = scratch.save(one.mapInArrow(_homes(pivots), "id long, v array<double>, copies long, cell long, angle double"))
        cells = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()
        reach = float(np.arccos(threshold)) + 1e-6
        apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
        parts = {c.cell: -(-c.n // BLOCK) for c in cells}
        near = [(c.cell, d.cell) for i, c in enumerate(cells) for d in cells[i:] if apart[c.cell, d.cell] <= c.radius + d.radius + reach]
        sizes = spark.createDataFrame([(c, p) for c, p in parts.items()], "cell long, parts long")
        pairs = spark.createDataFrame(near, "a long, b long")
        placed = placed.join(F.broadcast(sizes), "cell")  # at most MAX_PIVOTS rows, and its square below
        placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("angle")
        wide = pairs.select(F.col("a").alias("cell"), F.col("b").alias("mate")).union(pairs.filter("a <> b").select(F.col("b").alias("cell"), F.col("a").alias("mate")))
        wide = wide.join(sizes.select(F.col("cell").alias("mate"), F.col("parts").alias("mates")), "mate")
        sent = placed.join(F.broadcast(wide), "cell").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mates") - 1)).alias("mate_part"))
        name = lambda c, p: F.col(c) * F.lit(1 << 32) + F.col(p)
        sent = sent.withColumn("block", name("cell", "part")).withColumn("other", name("mate", "mate_part"))
        sent = sent.select("id", "v", "copies", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        tiles.append(sent.groupBy("x", "y").applyInArrow(_tile(threshold), "id long, links long, other long"))
    found = tiles[0]
    for t in tiles[1:]:
        found = found.union(t)
    found = scratch.save(found)
    links = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    heads = distinct.join(links, "id", "left").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = heads.groupBy("component").agg(F.min("least").alias("name"))
    heads = heads.join(names, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "name")
    out = rows.join(heads, "v", "left")
    linked = F.col("n_links").isNotNull()
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(linked, F.col("name")).otherwise(F.col("id")).alias("component"))


def op3_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda c: c / sqrt(list_dot_product(e, e))) AS e FROM v),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
k AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN k USING (vec_id) LEFT JOIN n USING (vec_id)
"""
