"""From raw documents to packed sequences: filter, deduplicate twice, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and
returns a frame with the columns of documents; the last returns the packed pieces. Stages
are written as Parquet in the folder that executors share and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import bin_packing, exact_dedup, factor_machine, soft_mixing, superminhash
from tillbook.llm.common import quality_domains, table
from tillbook.plans.worktables import materialize

#: Shares of the tokens after mixing. No document is dropped: rates are 1 at least, so the
#: domain that is short of its share comes more often.
TARGETS = {"high": 0.7, "low": 0.3}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = factor_machine.fit(docs, table(spark, sf_dir, "labels"))
    return factor_machine.without_toxic(docs, machine)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return superminhash.without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domains = quality_domains(table(spark, sf_dir, "labels"))
    return soft_mixing.mixed(docs, soft_mixing.fit(docs, domains, TARGETS, least=1.0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bin_packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained model, similarity components and a packing: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
