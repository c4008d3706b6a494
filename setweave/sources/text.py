"""Sets from text lines, and pairs to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_TOKEN = 8191


def leading_int(token: Column) -> Column:
    """The integer a token begins with after blanks; 0 where there is none."""
    return F.coalesce(F.regexp_extract(token, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def line_tokens(line: Column, dialect: str = "whitespace") -> Column:
    if dialect == "whitespace":
        return F.transform(F.filter(F.split(line, "[ \t\n]+"), lambda w: w != ""), lambda w: F.substring(w, 1, MAX_TOKEN))
    if dialect == "single_space":
        parts = F.split(line, " ", -1)
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    raise ValueError(f"unknown dialect {dialect!r}")


def read_sets(spark: SparkSession, path: str, dialect: str = "whitespace", numeric: bool = True) -> DataFrame:
    """(set_id, tokens): a set for each line, numbered from 0 in the order of files and lines.

    single_space: blank lines are skipped and take no number; whitespace: they are empty sets.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = lines.select("value", *[F.col(c).alias(f"p{k}") for k, c in enumerate(place)], F.monotonically_increasing_id().alias("at"))
    if dialect == "single_space":
        lines = lines.filter("value <> ''")
    order = Window.partitionBy("p0", "p1").orderBy("at")
    lines = lines.withColumn("nth", F.row_number().over(order) - 1)
    blocks = lines.groupBy("p0", "p1").agg(F.count("*").alias("size"))  # a row for each block of a file
    before = Window.orderBy("p0", "p1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("p0", "p1", (F.sum("size").over(before) - F.col("size")).alias("offset"))
    tokens = line_tokens(F.col("value"), dialect)
    tokens = F.transform(tokens, leading_int) if numeric else tokens
    return lines.join(blocks, ["p0", "p1"]).select((F.col("offset") + F.col("nth")).alias("set_id"), F.array_distinct(tokens).alias("tokens"))


def exploded(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", F.explode("tokens").alias("token"))


def pair_lines(pairs: DataFrame, layout: str = "scored") -> DataFrame:
    """scored: ``(x, y): sim``; plain: ``y x``, the larger id first. Similarities are rounded to six places."""
    x, y = F.col("x").cast("string"), F.col("y").cast("string")
    if layout == "scored":
        return pairs.select(F.concat(F.lit("("), x, F.lit(", "), y, F.lit("): "), F.round("sim", 6).cast("string")).alias("value"))
    if layout == "plain":
        return pairs.select(F.concat(y, F.lit(" "), x).alias("value"))
    raise ValueError(f"unknown layout {layout!r}")


def write_pairs(pairs: DataFrame, path: str, layout: str = "scored") -> None:
    """text layouts as in pair_lines, or parquet; what is at path is replaced."""
    if layout == "parquet":
        pairs.write.mode("overwrite").parquet(path)
    else:
        pair_lines(pairs, layout).write.mode("overwrite").text(path)
