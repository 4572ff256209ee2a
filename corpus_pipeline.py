"""The training-data pipeline over `documents`: each stage is written and the next reads it back.

Language ID drops texts that no language is found for and tells that of those that state none. Exact and near deduplication
keep one document of each group; near copies have 0.8 of their five-word shingles in common. SimHash links within two bits
are the first of them; those that a SimHash of 64 bits cannot find are completed by bands of minima, and every link is
verified on all shingles (see README). Mixing repeats and leaves out documents until sources stand at their weights, and packing cuts what is left into full sequences.

Every stage takes rows as they are: null and empty texts (dropped by the first stage), repeated rows, extra columns of any
name and type, and tables without rows, which give tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import exact_dedup, language, mixing, packing, simhash
from tallyframe.llm.queries import vocabulary
from tallyframe.session import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go; repeated rows stay; a null lang becomes the language told."""
    return language.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, null and empty ones included, one row stays, as of repeated rows."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row of the smallest doc_id stays (null last); texts without words are one group."""
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to three times; a null source is a source, repeated rows are rows of their own."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece; a null or empty text is a piece of its end-of-document id alone."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

# Language models, SimHash components and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
