"""Parity bitmaps: one bit per residue of a term, set where an odd number of terms has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def words(bits: int) -> int:
    if bits < 1:
        raise ValueError("a signature needs at least one bit")
    return -(-bits // WORD)


def hash32(v: Column) -> Column:
    """Multiplicative 32-bit hash, for spreading terms whose residues are uneven."""
    return F.pmod(v.cast("long") * F.lit(2654435761), F.lit(1 << 32))


def signatures(entries: DataFrame, bits: int = WORD) -> DataFrame:
    """(set_id, n, sig): sig is an array of words, the width rounded up to whole words."""
    width = words(bits) * WORD
    bit = F.pmod(F.col("term_id").cast("long"), F.lit(width))
    one = lambda k: F.when(bit.between(k * WORD, (k + 1) * WORD - 1), F.expr("1L").bitwiseAND(F.lit(1)))
    shifted = lambda k: F.call_function("shiftleft", one(k), F.pmod(bit, F.lit(WORD)).cast("int"))
    parts = [F.coalesce(F.bit_xor(shifted(k)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(words(bits))]
    out = entries.groupBy("set_id").agg(F.count("*").alias("n"), *parts)
    return out.select("set_id", "n", F.array(*[f"w{k}" for k in range(words(bits))]).alias("sig"))


def hamming(a: Column, b: Column, bits: int = WORD) -> Column:
    """Differing bits of two signatures of that width; written out word by word, so that it is compiled."""
    each = [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(words(bits))]
    return sum(each[1:], each[0])


def overlap_bound(n_a: Column, n_b: Column, distance: Column) -> Column:
    return (n_a + n_b - distance) / F.lit(2.0)
