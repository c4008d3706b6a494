"""A corpus pipeline: five operators one after the other, each on all that the one before kept.

For all stages: every row is a document of its own, also where its doc_id is null or repeats that of another row, and rows
that repeat are each kept or dropped by the same rules. Nulls in other columns than text pass through. Null and empty texts
are handled as texts without words. Texts are read whole, however long. An empty table gives an empty table. Other
columns than those of documents are left out before an operator sees them, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm import contamination, near_dup, packing, pii, quality
from setweave.llm.common import KEY, Scratch, keyed, released

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the documents it is given.

    Null and empty texts are scored like any other. A score of exactly 0.5 is accepted, as are all where nothing was learned.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, *COLUMNS).filter("score >= 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; null ids come last.

    Of rows that tie in their id, any one stays. Texts without words have no copies, so all of them stay.
    """
    scratch = Scratch(spark)
    docs = keyed(docs.select(COLUMNS), scratch)
    found = near_dup.near_duplicates(docs, id_col=KEY, scratch=scratch).select(F.col("id").alias(KEY), "component")
    found = found.join(docs.select(KEY, "doc_id"), KEY)
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("x")).select(F.col(f"x.{KEY}"))
    return docs.join(kept, KEY, "left_semi").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; null and empty texts aren't, and nothing is by an empty benchmark."""
    return contamination.uncontaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text.

    A null text stays null and keeps its n_chars. Of spans that overlap, the one that begins first counts, then the longer one.
    """
    out = pii.redacted(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null or empty text is one piece, its end id.

    Pieces of one length are placed in the order of doc_id (nulls first), piece, start and checksum; rows that repeat get
    places of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("PII", redact),
    ("packing", pack),
]

#: The classifier and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages between return is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with released():
            docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
