"""A corpus pipeline of five stages: toxicity, near duplicates, decontamination, secrets, packing.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame, which
is written as Parquet and read again as the documents of the next stage. The first four return the
columns of ``documents`` and keep or drop whole rows; the last returns the packed pieces.

Defined cases: null texts, repeated rows, empty tables and further columns pass through as the
operators define them: a null text is neither toxic, near another, contaminated nor secret, and is
packed as its closing id. SQL can't express the trained stages, so ``ORACLE_SQL`` is None and the
tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakework.llm import jaccard, packing, secrets, tiling, toxicity
from lakework.llm.common import table
from lakework.session import scratch_dir


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labels of the documents at hand; those that score 0.7 or more go."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the least id of each group stays."""
    return jaccard.keep_one_of_each(docs, size=5, percent=80)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item go."""
    return tiling.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def documents_with_secrets_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the scan finds a secret go."""
    return secrets.keep_without_secrets(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of up to 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near duplicates", one_of_each_group_stays),
    ("decontamination", contaminated_documents_go),
    ("secrets", documents_with_secrets_go),
    ("packing", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
