"""The training-data pipeline: stages in order, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from marginalia.llm.common import materialize, table
from marginalia.session import few_rows

#: Words of a passage that may stand only once, however short or long they are.
PASSAGE = 51


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score for quality is 0.5 or more."""
    few_rows(spark)  # here and in all stages that follow: workers and JVM keep what they once held
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("score >= 0.5").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.near_dedup(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats an earlier passage of over 50 words; n_chars follows the text."""
    cut = suffix_dedup.remove_later_copies(docs, length=2 * PASSAGE - 1, gram=suffix_dedup.WORD_GRAM, words=True)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("best_fit_packing", pack_bins),
]

#: SQL expresses neither the learned classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
