"""A training-data pipeline: toxicity, near duplicates, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. Defined results for nulls, empty tables, repeated rows and other columns are those of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm.common import discard, intermediate, materialise, table
from codeweft.llm.decontaminate import clean_documents
from codeweft.llm.mixing import mixed_documents
from codeweft.llm.ngram_join import distinct_documents
from codeweft.llm.sharding import interleave
from codeweft.llm.toxicity import THRESHOLD, scored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorization machine scores at the threshold or above."""
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.where(F.col(out.columns[-1]) < THRESHOLD).drop(out.columns[-1])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that of least doc_id."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words benchmark items make up 5 % or more."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights: complete copies, and pieces of the few documents that a quota cuts."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    return interleave(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The stages hold a fitted model and quotas by highest quotients, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again; what it wrote on the way, and what it read, then goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with intermediate(spark) as keep:
            out = keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
