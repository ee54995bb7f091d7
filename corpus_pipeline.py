"""A training corpus from raw documents, in stages that each call one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the rows of documents
that it keeps, and at the end the packed documents.  run() writes what a stage returns
as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesspan.llm.common import saved, table
from tesspan.llm.decontaminate import clean_documents
from tesspan.llm.exact_dedup import without_copies
from tesspan.llm.jaccard_dedup import without_near_copies
from tesspan.llm.packing import packed_documents
from tesspan.llm.quality import good_documents
from tesspan.llm.simhash_dedup import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints, and of those no two whose five-word shingles are 4/5 alike."""
    return without_near_copies(one_of_each(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document that is left."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminated), ("packing", packing)]

#: The first stage scores by a learned model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
