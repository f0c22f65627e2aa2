"""Corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, whatever their names; the last adds
`copies` (`mix_copies` where that is a column already), how often the mix takes the document. Empty tables give
empty results in every stage. Models and statistics are learned on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import common, decontaminate, exact_dedup, language_id, mixing, near_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and blank texts too), or whose language is ambiguous; repeated rows stay each. Without labels all go."""
    common.workers_ready(spark)
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    named = language_id.predict(own, model, ["row"])
    return named.filter((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays, null ids last; null counts as empty; of repeated rows one stays."""
    common.workers_ready(spark)
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays, null ids last; blank and null texts are one class; of repeated rows one stays."""
    common.workers_ready(spark)
    return near_dedup.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item of 8 characters or more, with some edits; null texts stay, repeated rows each."""
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; null sources are a source; texts without words go, as they hold no words to take; repeated rows are dealt as single ones."""
    return mixing.mix(docs)


STAGES = [("language_id", known_language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("mix_sources", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
