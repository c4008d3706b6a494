"""From text and relations to sets: tokens, dictionaries, entries and packed arrays.

Null texts and empty texts give no elements, and null ids and tokens are left out; rows that repeat give an element once. Sets
without elements have no row, so they match nothing. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setweave.plans.stage import materialised, new_path, remove


#: Counters that tokens are counted in for hashed_rows' order.
COUNTERS = 1 << 20
#: A word is kept once in a row group, however many sets have it.
_DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20), "compression": "zstd"}


def tokens(text: Column) -> Column:
    """Distinct words between blanks, tabs and line feeds."""
    return F.array_distinct(F.filter(F.split(text, "[ \n\t]+"), lambda w: w != ""))


def text_sets(docs: DataFrame, set_id: str, text: str) -> DataFrame:
    """(set_id, token), a row for each element."""
    return docs.filter(F.col(set_id).isNotNull()).select(F.col(set_id).cast("long").alias("set_id"), F.explode(tokens(F.col(text))).alias("token"))


def text_rows(docs: DataFrame, set_id: str, text: str) -> DataFrame:
    """(set_id, tokens), a row for each row whose id isn't null; tokens may be null or empty."""
    words = F.array_remove(F.array_distinct(F.split(F.col(text), "[ \n\t]+")), "")
    return docs.filter(F.col(set_id).isNotNull()).select(F.col(set_id).cast("long").alias("set_id"), words.alias("tokens"))


def relation_sets(rows: DataFrame, set_id: str, token: str) -> DataFrame:
    """(set_id, token) from any relation; nulls are no elements."""
    out = rows.select(F.col(set_id).cast("long").alias("set_id"), F.col(token).alias("token"))
    return out.filter("set_id is not null and token is not null").distinct()


def set_sizes(raw: DataFrame) -> DataFrame:
    return raw.groupBy("set_id").agg(F.count("*").alias("n"))


def frequencies(raw: DataFrame) -> DataFrame:
    """(token, df)."""
    return raw.groupBy("token").agg(F.count("*").alias("df"))


def dictionary(raw: DataFrame) -> DataFrame:
    """(token, df, term_id): rarest first, ties by token, from 0.

    Terms are numbered within ranges of the order; a range's offset is the running sum of the ranges' sizes, so that
    no single task sees the vocabulary.
    """
    ordered = frequencies(raw).repartitionByRange("df", "token").sortWithinPartitions("df", "token")
    ordered = materialised(ordered.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select("part", (F.sum("size").over(before) - F.col("size")).alias("offset"))  # a row for each range
    numbered = ordered.withColumn("part", part).join(F.broadcast(sizes), "part")
    return numbered.select("token", "df", (F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("term_id"))


def encoded(raw: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(set_id, n, terms): ascending distinct term ids."""
    terms = dictionary(raw) if terms is None else terms
    coded = raw.join(terms.select("token", "term_id"), "token")
    packed = coded.groupBy("set_id").agg(F.array_distinct(F.sort_array(F.collect_list("term_id"))).alias("terms"))
    return packed.select("set_id", F.size("terms").cast("long").alias("n"), "terms")


def hashed(raw: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """raw and the others as (set_id, n, terms), with terms in one order for all: rarest first over all of them.

    Terms are 64-bit hashes of the tokens (integers stay as they are), so that only numbers are sorted and shuffled; the order is
    by frequency and then hash. Tokens that share a hash are found by a second one and hashed anew, from another seed (which must
    come first: after the token it would leave equal hashes equal), until none do.
    """
    spark, kind = raw.sparkSession, raw.schema["token"].dataType.typeName()
    number = kind in ("byte", "short", "integer", "long")
    shared: list[list[int]] = []
    while True:
        term = F.col("token").cast("long") if number else F.xxhash64("token")
        for seed, hashes in enumerate(shared, 1):
            term = F.when(term.isin(hashes), F.xxhash64(F.lit(seed), "token")).otherwise(term)
        other = F.lit(0) if number else F.hash("token")
        rows = [materialised(r.select("set_id", term.alias("term"), other.alias("other"))) for r in (raw, *others)]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionAll(r)
        df = every.groupBy("term").agg(F.count("*").alias("df"), F.min("other").alias("lo"), F.max("other").alias("hi"))
        if len(rows) > 1:
            df = materialised(df)
        found = df.select("term", "df", (F.col("lo") != F.col("hi")).alias("clash"))
        packed = [r.join(found, "term").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("t"), F.max("clash").alias("clash")) for r in rows]
        out = [materialised(x.select("set_id", F.array_distinct("t.term").alias("terms"), "clash")) for x in packed]
        if number or all(x.filter("clash").isEmpty() for x in out):
            return [x.select("set_id", F.size("terms").cast("long").alias("n"), "terms") for x in out]
        shared.append([r.term for r in df.filter("lo <> hi").select("term").collect()])  # a few, however many tokens there are


def _vocabulary(batches):
    """(term, df, lo, hi) of every few batches."""
    held, size = [], 0

    def counted():
        term, other = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(term)
        term, other = term[order], other[order]
        at = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        columns = [term[at], np.diff(np.append(at, len(term))), np.minimum.reduceat(other, at), np.maximum.reduceat(other, at)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "df", "lo", "hi"])

    for batch in batches:
        held.append([np.asarray(batch[c].flatten()) for c in ("terms", "others")])
        size += len(held[-1][0])
        if size > 1 << 20:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def _in_order(counts):
    def order(batches):
        count = np.frombuffer(counts.value, np.uint32)
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch["terms"]), 0))
            ends, term = np.asarray(batch["terms"].offsets), np.asarray(batch["terms"].flatten())
            ends = ends - ends[0]
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.lexsort((term, (of << 32) | count[term % COUNTERS].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["set_id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term[at]))], names=["set_id", "terms"])

    return order


def hashed_rows(rows: DataFrame) -> DataFrame:
    """(set_id, n, terms) of (set_id, tokens), as hashed() gives them of (set_id, token), without shuffling the elements.

    The order of terms is by a count and then hash: tokens are counted in COUNTERS counters by their hashes, so it is
    by frequency only as far as few tokens share one. Any order that all sets have gives the same pairs.
    """
    spark, shared = rows.sparkSession, []
    while True:

        def term(token: Column) -> Column:
            out = F.xxhash64(token)
            for seed, hashes in enumerate(shared, 1):  # noqa: B023
                out = F.when(out.isin(hashes), F.xxhash64(F.lit(seed), token)).otherwise(out)
            return out

        coded = rows.select("set_id", F.transform("tokens", term).alias("terms"), F.transform("tokens", lambda token: F.hash(token)).alias("others"))
        coded = materialised(coded, path := new_path(spark), **_DICTIONARY)
        df = coded.mapInArrow(_vocabulary, "term long, df long, lo int, hi int")
        df = df.groupBy("term").agg(F.sum("df").alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        counted = df.groupBy(F.pmod("term", F.lit(COUNTERS)).cast("int").alias("at")).agg(F.sum("df").alias("df"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("clash"))
        counted = counted.toArrow()  # a row for each counter at most
        if not np.asarray(counted["clash"]).any():
            break
        shared.append([r.term for r in df.filter("lo <> hi").select("term").collect()])  # a few, however many tokens there are
        remove(spark, path)
    counts = np.zeros(COUNTERS, np.uint32)
    counts[np.asarray(counted["at"])] = np.minimum(np.asarray(counted["df"]), (1 << 31) - 1)
    order, kind = _in_order(spark.sparkContext.broadcast(counts.tobytes())), "set_id long, terms array<long>"
    out = materialised(coded.select("set_id", "terms").mapInArrow(order, kind), **_DICTIONARY)
    remove(spark, path)
    repeated = out.groupBy("set_id").count().filter("count > 1").select("set_id")
    if not repeated.isEmpty():
        repeated = materialised(repeated)
        merged = out.join(repeated, "set_id", "left_semi").groupBy("set_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
        out = materialised(out.join(repeated, "set_id", "left_anti").unionByName(merged.mapInArrow(order, kind)), **_DICTIONARY)
    return out.select("set_id", F.size("terms").cast("long").alias("n"), "terms")


def entries(sets: DataFrame) -> DataFrame:
    """(set_id, n, pos, term_id)."""
    return sets.select("set_id", "n", F.posexplode("terms").alias("pos", "term_id"))


def term_frequencies(items: DataFrame) -> DataFrame:
    return items.groupBy("term_id").agg(F.count("*").alias("df"))


def term_starts(sizes: DataFrame, inclusive: bool = False) -> DataFrame:
    """(key, size, start): running sums of sizes in order of key, before or up to each; no task sees more than a range of keys."""
    df = materialised(sizes.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy("part").agg(F.sum("size").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select("part", (F.sum("total").over(before) - F.col("total")).alias("offset"))  # a row for each range
    out = df.withColumn("upto", F.sum("size").over(own)).join(F.broadcast(totals), "part")
    return out.select("key", "size", (F.col("offset") + F.col("upto") - (0 if inclusive else F.col("size"))).alias("start"))


def term_offsets(items: DataFrame, inclusive: bool = False) -> DataFrame:
    """(term_id, df, start): running sums of list lengths in order of term_id, before or up to each list."""
    out = term_starts(term_frequencies(items).select(F.col("term_id").alias("key"), F.col("df").alias("size")), inclusive)
    return out.select(F.col("key").alias("term_id"), F.col("size").alias("df"), "start")


def set_offsets(sizes: DataFrame) -> DataFrame:
    """(set_id, n, start): where each set begins when all are laid out in order of set_id."""
    out = term_starts(sizes.select(F.col("set_id").alias("key"), F.col("n").alias("size")))
    return out.select(F.col("key").alias("set_id"), F.col("size").alias("n"), "start")


def posting_lists(items: DataFrame) -> DataFrame:
    """(term_id, sets): the explicit inverted index; joins don't need it."""
    return items.groupBy("term_id").agg(F.sort_array(F.collect_list("set_id")).alias("sets"))


def statistics(raw: DataFrame) -> DataFrame:
    sizes = set_sizes(raw).agg(F.count("*").alias("n_sets"), F.max("n").alias("max_size"), F.sum("n").alias("n_entries"))
    return sizes.crossJoin(frequencies(raw).agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df")))  # one row each
