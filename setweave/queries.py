"""Registered queries of the similarity-join engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.functions.bounds import COSINE, DICE, JACCARD
from setweave.functions.signature import hamming, hash32, overlap_bound, signatures
from setweave.operators import join, prepare
from setweave.plans.stage import materialised, new_path
from setweave.sources import text


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _docs(spark, sf):
    return prepare.text_sets(_read(spark, sf, "documents"), "doc_id", "text")


def _bench(spark, sf):
    return prepare.text_sets(_read(spark, sf, "benchmark"), "item_id", "text")


def _order_parts(spark, sf):
    return prepare.relation_sets(_read(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


def _customer_parts(spark, sf):
    rows = _read(spark, sf, "lineitem").join(_read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return prepare.relation_sets(rows, "o_custkey", "l_partkey")


def _user_props(spark, sf):
    rows = _read(spark, sf, "events").withColumn("token", F.concat("event_type", F.lit("|"), F.coalesce("props", F.lit(""))))
    return prepare.relation_sets(rows, "user_id", "token")


def _as_terms(raw: DataFrame) -> DataFrame:
    """Sets of integer tokens, which are their own terms."""
    packed = raw.groupBy("set_id").agg(F.sort_array(F.collect_list("token")).alias("terms"))
    return packed.select("set_id", F.size("terms").cast("long").alias("n"), "terms")


def _encoded(raw: DataFrame) -> DataFrame:
    """Sets of dense term ids, for what returns them."""
    return materialised(prepare.encoded(raw))


def _doc_rows(spark, sf):
    return prepare.text_rows(_read(spark, sf, "documents"), "doc_id", "text")


def _sets(raw: DataFrame) -> DataFrame:
    return prepare.hashed_rows(raw) if "tokens" in raw.columns else prepare.hashed(raw)[0]


def _self(source, t, **kw):
    return lambda spark, sf: join.self_join(_sets(source(spark, sf)), t, **kw).select("x", "y", "overlap", F.round("sim", 6).alias("sim"))


def _binary(t, strategy, bits=64):
    def run(spark, sf):
        r, s = prepare.hashed(_bench(spark, sf), _docs(spark, sf))
        return join.binary_join(r, s, t, strategy=strategy, bits=bits).select("r_id", "s_id", "overlap", F.round("sim", 6).alias("sim"))

    return run


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _self(_doc_rows, 0.8, strategy="prefix")(spark, sf)


def _bounds(spark, sf):
    n, t = F.col("n"), F.col("t")
    sizes = prepare.set_sizes(_docs(spark, sf)).select("n").distinct()
    out = None
    for v in (0.5, 0.75, 0.8, 0.9):
        part = sizes.select(
            n,
            F.lit(v).alias("t"),
            JACCARD.minsize(n, v).alias("minsize"),
            JACCARD.maxsize(n, v).alias("maxsize"),
            JACCARD.minoverlap(n, n + 3, v).alias("minoverlap"),
            JACCARD.maxprefix(n, v).alias("maxprefix"),
            JACCARD.midprefix(n, v).alias("midprefix"),
            JACCARD.maxsize_at(n, F.lit(2), v).alias("maxsize_at"),
        )
        out = part if out is None else out.union(part)
    return out.filter(t.isNotNull())


def _prefixes(side):
    def run(spark, sf):
        items = prepare.entries(_encoded(_customer_parts(spark, sf)))
        return items.filter(F.col("pos") < getattr(JACCARD, side)(F.col("n"), 0.8)).select("set_id", "pos", "term_id")

    return run


def _prefix_pairs(spark, sf):
    """Candidates by prefixes and sizes alone: pairs with a common term in them."""
    items = prepare.entries(_encoded(_customer_parts(spark, sf))).filter(F.col("pos") < JACCARD.maxprefix(F.col("n"), 0.5))
    a, b = (items.select(*[F.col(c).alias(f"{c}_{s}") for c in ("set_id", "n", "term_id")]) for s in "xy")
    on = (F.col("term_id_x") == F.col("term_id_y")) & (F.col("set_id_x") < F.col("set_id_y"))
    on &= F.least("n_x", "n_y") >= JACCARD.minsize(F.greatest("n_x", "n_y"), 0.5)
    return a.join(b, on).select(F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y")).distinct()


def _signed(bits):
    def run(spark, sf):
        out = signatures(prepare.entries(_as_terms(_order_parts(spark, sf))), bits)
        ones = F.aggregate(F.transform("sig", lambda w: F.bit_count(w)), F.lit(0), lambda s, x: s + x)
        return out.select("set_id", "n", ones.alias("ones"))

    return run


def _hamming(spark, sf):
    """Each order against that of the next key."""
    out = signatures(prepare.entries(_as_terms(_order_parts(spark, sf))))
    a, b = (out.select(*[F.col(c).alias(f"{c}_{s}") for c in out.columns]) for s in "xy")
    met = a.join(b, F.col("set_id_x") + 1 == F.col("set_id_y"))
    h = hamming(F.col("sig_x"), F.col("sig_y"))
    return met.select(F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y"), h.alias("hamming"), overlap_bound(F.col("n_x"), F.col("n_y"), h).alias("bound"))


def _bitmap_pairs(spark, sf):
    found = join.bitmap_candidates(_as_terms(_customer_parts(spark, sf)), None, 0.5)
    return found.select(F.least("set_id_x", "set_id_y").alias("x"), F.greatest("set_id_x", "set_id_y").alias("y"))


def _matrix(spark, sf):
    found = join.overlaps(_sets(_user_props(spark, sf)))
    return found.select(F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y"), "overlap")


def _merge(spark, sf):
    """Overlaps of customers with the next key's."""
    sets = _sets(_customer_parts(spark, sf))
    pairs = sets.select(F.col("set_id").alias("set_id_x"), (F.col("set_id") + 1).alias("set_id_y"))
    return join.verified(pairs, sets).select(F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y"), "overlap")


def _postings(spark, sf):
    lists = prepare.posting_lists(prepare.entries(_as_terms(_order_parts(spark, sf))))
    return lists.select("term_id", F.size("sets").alias("length"), F.element_at("sets", 1).alias("first_set"), F.element_at("sets", -1).alias("last_set"))


def _matched(anti):
    def run(spark, sf):
        sets = _sets(_doc_rows(spark, sf))
        return join.matched(sets.select("set_id", "n"), join.partners(sets, 0.8, strategy="prefix"), anti)

    return run


def _loose(spark, sf):
    n = F.col("n")
    sizes = prepare.set_sizes(_docs(spark, sf)).select("n").distinct()
    return sizes.select(n, JACCARD.loose_maxsize(n, 0.8).alias("jaccard"), *[sim.maxsize(n, 0.8).alias(name) for name, sim in (("dice", DICE), ("cosine", COSINE))])


def _hash_terms(spark, sf):
    terms = prepare.term_frequencies(prepare.entries(_as_terms(_order_parts(spark, sf))))
    return terms.select("term_id", hash32(F.col("term_id")).alias("hash"))


def _text_lines(spark, sf):
    """Orders written as lines of text in order of their keys, and read back: numbered from 0, tokens up to their digits."""
    lines = _order_parts(spark, sf).groupBy("set_id").agg(F.concat_ws(" \t", F.transform(F.sort_array(F.collect_list("token")), lambda v: F.concat(v.cast("string"), F.lit("x")))).alias("value"))
    path = new_path(spark)
    lines.repartitionByRange("set_id").sortWithinPartitions("set_id").select("value").write.text(path)
    read = text.read_sets(spark, path)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, v: a + v)
    return read.select("set_id", F.size("tokens").cast("long").alias("n"), total.alias("total"))


def _pair_lines(layout):
    def run(spark, sf):
        """A join's pairs written as text and read back."""
        path = new_path(spark)
        text.write_pairs(_self(_order_parts, 0.8, strategy="prefix")(spark, sf), path, layout)
        return spark.read.text(path)

    return run


QUERIES = {
    "tokenize_sets": lambda spark, sf: _docs(spark, sf),
    "set_sizes": lambda spark, sf: prepare.set_sizes(_docs(spark, sf)),
    "term_df": lambda spark, sf: prepare.term_frequencies(prepare.entries(_as_terms(_order_parts(spark, sf)))),
    "term_offsets": lambda spark, sf: prepare.term_offsets(prepare.entries(_as_terms(_order_parts(spark, sf)))),
    "term_ends": lambda spark, sf: prepare.term_offsets(prepare.entries(_as_terms(_order_parts(spark, sf))), inclusive=True),
    "posting_lists": _postings,
    "term_rank_dictionary": lambda spark, sf: prepare.dictionary(_bench(spark, sf)),
    "vocab_stats": lambda spark, sf: prepare.statistics(_docs(spark, sf)),
    "bounds_table": _bounds,
    "probe_prefix": _prefixes("maxprefix"),
    "index_prefix": _prefixes("midprefix"),
    "prefix_candidates": _prefix_pairs,
    "signature_popcount": _signed(64),
    "signature_popcount_256": _signed(256),
    "hamming_upper_bound": _hamming,
    "bitmap_candidates": _bitmap_pairs,
    "selfjoin_naive_ge": _self(_doc_rows, 0.9, strategy="naive"),
    "selfjoin_naive_gt": _self(_doc_rows, 0.9, strategy="naive", boundary="gt"),
    "selfjoin_naive_overlap": _self(_doc_rows, 0.9, strategy="naive", boundary="overlap"),
    "selfjoin_size": _self(_doc_rows, 0.8, strategy="size"),
    "selfjoin_prefix": _self(_doc_rows, 0.8, strategy="prefix"),
    "selfjoin_prefix_low": _self(_doc_rows, 0.5, strategy="prefix"),
    "selfjoin_bitmap": _self(_doc_rows, 0.8, strategy="bitmap", bits=256),
    "selfjoin_orders_prefix": _self(_order_parts, 0.5, strategy="prefix"),
    "selfjoin_orders_size": _self(_order_parts, 0.5, strategy="size"),
    "selfjoin_orders_bitmap": _self(_order_parts, 0.5, strategy="bitmap"),
    "selfjoin_orders_gt": _self(_order_parts, 0.5, strategy="prefix", boundary="gt"),
    "selfjoin_float32": _self(_order_parts, 0.5, strategy="prefix", float32=True),
    "selfjoin_auto": _self(_order_parts, 0.8),
    "selfjoin_count": lambda spark, sf: join.count_pairs(_self(_doc_rows, 0.8, strategy="prefix")(spark, sf)),
    "selfjoin_dice": _self(_doc_rows, 0.8, strategy="prefix", sim=DICE),
    "selfjoin_dice_bitmap": _self(_order_parts, 0.6, strategy="bitmap", sim=DICE),
    "selfjoin_cosine": _self(_doc_rows, 0.8, strategy="prefix", sim=COSINE),
    "selfjoin_cosine_gt": _self(_order_parts, 0.6, strategy="prefix", boundary="gt", sim=COSINE),
    "loose_bounds": _loose,
    "hash_terms": _hash_terms,
    "set_offsets": lambda spark, sf: prepare.set_offsets(prepare.set_sizes(_order_parts(spark, sf))),
    "text_lines": _text_lines,
    "pair_lines_scored": _pair_lines("scored"),
    "pair_lines_plain": _pair_lines("plain"),
    "binary_auto": _binary(0.2, "auto"),
    "binary_prefix": _binary(0.2, "prefix"),
    "binary_bitmap": _binary(0.2, "bitmap", 256),
    "binary_naive": _binary(0.2, "naive"),
    "overlap_matrix": _matrix,
    "verify_merge": _merge,
    "matched_sets": _matched(False),
    "unmatched_sets": _matched(True),
}

_DOCS = "t AS (SELECT doc_id AS sid, unnest(list_distinct(regexp_split_to_array(text, '[ \\n\\t]+'))) AS tok FROM documents), r AS (SELECT * FROM t WHERE tok <> '')"
_BENCH = "bt AS (SELECT item_id AS sid, unnest(list_distinct(regexp_split_to_array(text, '[ \\n\\t]+'))) AS tok FROM benchmark), b AS (SELECT * FROM bt WHERE tok <> '')"
_ORDERS = "r AS (SELECT DISTINCT l_orderkey AS sid, l_partkey AS tok FROM lineitem)"
_CUSTOMERS = "r AS (SELECT DISTINCT o_custkey AS sid, l_partkey AS tok FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_USERS = "r AS (SELECT DISTINCT user_id AS sid, event_type || '|' || coalesce(props, '') AS tok FROM events)"
_SIZES = "s AS (SELECT sid, count(*) AS n FROM r GROUP BY 1)"
_OVERLAPS = "g AS (SELECT a.sid AS x, b.sid AS y, count(*) AS ov FROM r a JOIN r b ON a.tok = b.tok AND a.sid < b.sid GROUP BY 1, 2)"
_SCORED = "j AS (SELECT x, y, ov, p.n AS nx, q.n AS ny, ov::DOUBLE / (p.n + q.n - ov) AS sim FROM g JOIN s p ON p.sid = x JOIN s q ON q.sid = y)"
_RANKED = "f AS (SELECT tok, count(*) AS df FROM r GROUP BY 1), k AS (SELECT tok, row_number() OVER (ORDER BY df, tok) - 1 AS term_id FROM f), e AS (SELECT sid, n, term_id, row_number() OVER (PARTITION BY sid ORDER BY term_id) - 1 AS pos FROM r JOIN k USING (tok) JOIN s USING (sid))"


def _self_sql(source: str, where: str) -> str:
    return f"WITH {source}, {_SIZES}, {_OVERLAPS}, {_SCORED} SELECT x, y, ov AS overlap, round(sim, 6) AS sim FROM j WHERE {where}"


_BOUND_SQL = "least(nx, ny, ceil((nx + ny) * {t}::DOUBLE / (1 + {t}::DOUBLE)))"
_OVERLAP_9 = f"ov >= {_BOUND_SQL.format(t=0.9)} AND least(nx, ny) >= ceil(0.9::DOUBLE * greatest(nx, ny))"
_BINARY_SQL = f"WITH {_DOCS}, {_BENCH}, bs AS (SELECT sid, count(*) AS n FROM b GROUP BY 1), {_SIZES}, g AS (SELECT b.sid AS r_id, r.sid AS s_id, count(*) AS ov FROM b JOIN r USING (tok) GROUP BY 1, 2) SELECT r_id, s_id, ov AS overlap, round(ov::DOUBLE / (p.n + q.n - ov), 6) AS sim FROM g JOIN bs p ON p.sid = r_id JOIN s q ON q.sid = s_id WHERE ov::DOUBLE / (p.n + q.n - ov) >= 0.2::DOUBLE"
_PARITY = "x AS (SELECT sid, tok % {b} AS bit FROM r GROUP BY sid, bit HAVING count(*) % 2 = 1)"
_PREFIX_SQL = "WITH {c}, {s}, {k} SELECT sid AS set_id, pos::INTEGER AS pos, term_id FROM e WHERE pos < least(n, n - {bound} + 1)"
_BY_NEED = "WITH {d}, {s}, {g}, {j}, m AS (SELECT x AS sid FROM j WHERE sim >= 0.8::DOUBLE UNION SELECT y FROM j WHERE sim >= 0.8::DOUBLE) SELECT sid AS set_id, n FROM s WHERE sid {op} (SELECT sid FROM m)"

ORACLES = {
    "tokenize_sets": f"WITH {_DOCS} SELECT sid AS set_id, tok AS token FROM r",
    "set_sizes": f"WITH {_DOCS}, {_SIZES} SELECT sid AS set_id, n FROM s",
    "term_df": f"WITH {_ORDERS} SELECT tok AS term_id, count(*) AS df FROM r GROUP BY 1",
    "term_offsets": f"WITH {_ORDERS}, f AS (SELECT tok, count(*) AS df FROM r GROUP BY 1) SELECT tok AS term_id, df, (sum(df) OVER (ORDER BY tok) - df)::BIGINT AS start FROM f",
    "term_ends": f"WITH {_ORDERS}, f AS (SELECT tok, count(*) AS df FROM r GROUP BY 1) SELECT tok AS term_id, df, (sum(df) OVER (ORDER BY tok))::BIGINT AS start FROM f",
    "posting_lists": f"WITH {_ORDERS} SELECT tok AS term_id, count(*)::INTEGER AS length, min(sid) AS first_set, max(sid) AS last_set FROM r GROUP BY 1",
    "term_rank_dictionary": f"WITH {_BENCH}, f AS (SELECT tok, count(*) AS df FROM b GROUP BY 1) SELECT tok AS token, df, row_number() OVER (ORDER BY df, tok) - 1 AS term_id FROM f",
    "vocab_stats": f"WITH {_DOCS}, {_SIZES}, f AS (SELECT tok, count(*) AS df FROM r GROUP BY 1) SELECT (SELECT count(*) FROM s) AS n_sets, (SELECT max(n) FROM s) AS max_size, (SELECT sum(n)::BIGINT FROM s) AS n_entries, (SELECT count(*) FROM f) AS n_terms, (SELECT max(df) FROM f) AS max_df",
    "bounds_table": f"WITH {_DOCS}, {_SIZES}, v AS (SELECT DISTINCT n, t FROM s, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) w(t)) SELECT n, t, ceil(t * n)::BIGINT AS minsize, floor(n / t)::BIGINT AS maxsize, least(n, ceil((n + (n + 3)) * t / (1 + t))::BIGINT) AS minoverlap, least(n, n - ceil(t * n)::BIGINT + 1) AS maxprefix, least(n, n - least(n, ceil((n + n) * t / (1 + t))::BIGINT) + 1) AS midprefix, floor((n - (1 - 1e-10::DOUBLE + t) * 2) / t)::BIGINT AS maxsize_at FROM v",
    "probe_prefix": _PREFIX_SQL.format(c=_CUSTOMERS, s=_SIZES, k=_RANKED, bound="ceil(0.8::DOUBLE * n)"),
    "index_prefix": _PREFIX_SQL.format(c=_CUSTOMERS, s=_SIZES, k=_RANKED, bound="least(n, ceil((n + n) * 0.8::DOUBLE / (1 + 0.8::DOUBLE)))"),
    "prefix_candidates": f"WITH {_CUSTOMERS}, {_SIZES}, {_RANKED}, p AS (SELECT * FROM e WHERE pos < least(n, n - ceil(0.5::DOUBLE * n) + 1)) SELECT DISTINCT a.sid AS x, b.sid AS y FROM p a JOIN p b ON a.term_id = b.term_id AND a.sid < b.sid AND least(a.n, b.n) >= ceil(0.5::DOUBLE * greatest(a.n, b.n))",
    "signature_popcount": f"WITH {_ORDERS}, {_SIZES}, {_PARITY.format(b=64)} SELECT sid AS set_id, n, (SELECT count(*) FROM x WHERE x.sid = s.sid)::INTEGER AS ones FROM s",
    "signature_popcount_256": f"WITH {_ORDERS}, {_SIZES}, {_PARITY.format(b=256)} SELECT sid AS set_id, n, (SELECT count(*) FROM x WHERE x.sid = s.sid)::INTEGER AS ones FROM s",
    "hamming_upper_bound": f"WITH {_ORDERS}, {_SIZES}, {_PARITY.format(b=64)}, c AS (SELECT sid, count(*) AS c FROM x GROUP BY 1), i AS (SELECT a.sid, count(*) AS c FROM x a JOIN x b ON a.sid + 1 = b.sid AND a.bit = b.bit GROUP BY 1), h AS (SELECT p.sid AS x, q.sid AS y, p.n + q.n AS n, (coalesce(cp.c, 0) + coalesce(cq.c, 0) - 2 * coalesce(i.c, 0))::INTEGER AS hamming FROM s p JOIN s q ON p.sid + 1 = q.sid LEFT JOIN c cp ON cp.sid = p.sid LEFT JOIN c cq ON cq.sid = q.sid LEFT JOIN i ON i.sid = p.sid) SELECT x, y, hamming, (n - hamming) / 2.0::DOUBLE AS bound FROM h",
    "bitmap_candidates": f"WITH {_CUSTOMERS}, {_SIZES}, {_PARITY.format(b=64)}, c AS (SELECT sid, count(*) AS c FROM x GROUP BY 1), i AS (SELECT a.sid AS x, b.sid AS y, count(*) AS c FROM x a JOIN x b ON a.bit = b.bit AND a.sid < b.sid GROUP BY 1, 2), h AS (SELECT p.sid AS x, q.sid AS y, p.n AS nx, q.n AS ny, coalesce(cp.c, 0) + coalesce(cq.c, 0) - 2 * coalesce(i.c, 0) AS d FROM s p JOIN s q ON p.sid < q.sid LEFT JOIN c cp ON cp.sid = p.sid LEFT JOIN c cq ON cq.sid = q.sid LEFT JOIN i ON i.x = p.sid AND i.y = q.sid) SELECT x, y FROM h WHERE least(nx, ny) >= ceil(0.5::DOUBLE * greatest(nx, ny)) AND (nx + ny - d) / 2.0::DOUBLE >= least(nx, ny, ceil((nx + ny) * 0.5::DOUBLE / 1.5::DOUBLE - 1e-9::DOUBLE))",
    "selfjoin_naive_ge": _self_sql(_DOCS, "sim >= 0.9::DOUBLE"),
    "selfjoin_naive_gt": _self_sql(_DOCS, "sim > 0.9::DOUBLE"),
    "selfjoin_naive_overlap": _self_sql(_DOCS, _OVERLAP_9),
    **{k: _self_sql(_DOCS, "sim >= 0.8::DOUBLE") for k in ("selfjoin_size", "selfjoin_prefix", "selfjoin_bitmap")},
    "selfjoin_prefix_low": _self_sql(_DOCS, "sim >= 0.5::DOUBLE"),
    **{k: _self_sql(_ORDERS, "sim >= 0.5::DOUBLE") for k in ("selfjoin_orders_prefix", "selfjoin_orders_size", "selfjoin_orders_bitmap")},
    "selfjoin_orders_gt": _self_sql(_ORDERS, "sim > 0.5::DOUBLE"),
    "selfjoin_float32": _self_sql(_ORDERS, "sim::FLOAT >= 0.5::FLOAT"),
    "selfjoin_auto": _self_sql(_ORDERS, "sim >= 0.8::DOUBLE"),
    "selfjoin_count": f"WITH {_DOCS}, {_SIZES}, {_OVERLAPS}, {_SCORED} SELECT count(*) AS n_pairs FROM j WHERE sim >= 0.8::DOUBLE",
    "selfjoin_dice": _self_sql(_DOCS, "2 * ov::DOUBLE / (nx + ny) >= 0.8::DOUBLE").replace("round(sim, 6)", "round(2 * ov::DOUBLE / (nx + ny), 6)"),
    "selfjoin_dice_bitmap": _self_sql(_ORDERS, "2 * ov::DOUBLE / (nx + ny) >= 0.6::DOUBLE").replace("round(sim, 6)", "round(2 * ov::DOUBLE / (nx + ny), 6)"),
    "selfjoin_cosine": _self_sql(_DOCS, "ov::DOUBLE / sqrt((nx * ny)::DOUBLE) >= 0.8::DOUBLE").replace("round(sim, 6)", "round(ov::DOUBLE / sqrt((nx * ny)::DOUBLE), 6)"),
    "selfjoin_cosine_gt": _self_sql(_ORDERS, "ov::DOUBLE / sqrt((nx * ny)::DOUBLE) > 0.6::DOUBLE").replace("round(sim, 6)", "round(ov::DOUBLE / sqrt((nx * ny)::DOUBLE), 6)"),
    "loose_bounds": f"WITH {_DOCS}, {_SIZES} SELECT DISTINCT n, ceil(n / 0.8::DOUBLE)::BIGINT AS jaccard, floor(n * ((2 - 0.8::DOUBLE) / 0.8::DOUBLE))::BIGINT AS dice, floor(n / (0.8::DOUBLE * 0.8::DOUBLE))::BIGINT AS cosine FROM s",
    "hash_terms": f"WITH {_ORDERS} SELECT DISTINCT tok AS term_id, ((tok::HUGEINT * 2654435761) % 4294967296)::BIGINT AS hash FROM r",
    "set_offsets": f"WITH {_ORDERS}, {_SIZES} SELECT sid AS set_id, n, (sum(n) OVER (ORDER BY sid) - n)::BIGINT AS start FROM s",
    "text_lines": f"WITH {_ORDERS} SELECT row_number() OVER (ORDER BY sid) - 1 AS set_id, count(*) AS n, sum(tok)::BIGINT AS total FROM r GROUP BY sid",
    "pair_lines_scored": _self_sql(_ORDERS, "sim >= 0.8::DOUBLE").replace("SELECT x, y, ov AS overlap, round(sim, 6) AS sim FROM j", "SELECT '(' || x || ', ' || y || '): ' || round(sim, 6) AS value FROM j"),
    "pair_lines_plain": _self_sql(_ORDERS, "sim >= 0.8::DOUBLE").replace("SELECT x, y, ov AS overlap, round(sim, 6) AS sim FROM j", "SELECT y || ' ' || x AS value FROM j"),
    **dict.fromkeys(("binary_auto", "binary_prefix", "binary_bitmap", "binary_naive"), _BINARY_SQL),
    "overlap_matrix": f"WITH {_USERS}, {_OVERLAPS} SELECT x, y, ov AS overlap FROM g",
    "verify_merge": f"WITH {_CUSTOMERS}, {_SIZES}, i AS (SELECT a.sid, count(*) AS c FROM r a JOIN r b ON a.sid + 1 = b.sid AND a.tok = b.tok GROUP BY 1) SELECT p.sid AS x, q.sid AS y, coalesce(i.c, 0) AS overlap FROM s p JOIN s q ON p.sid + 1 = q.sid LEFT JOIN i ON i.sid = p.sid",
    "matched_sets": _BY_NEED.format(d=_DOCS, s=_SIZES, g=_OVERLAPS, j=_SCORED, op="IN"),
    "unmatched_sets": _BY_NEED.format(d=_DOCS, s=_SIZES, g=_OVERLAPS, j=_SCORED, op="NOT IN"),
}
