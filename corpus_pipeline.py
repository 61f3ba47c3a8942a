"""The corpus pipeline: five stages over the documents table.

Each stage takes what its predecessor kept, as written and read again, and
returns the columns of documents; the last adds each document's place in
the mix and how often the mix takes it. Stages judge rows by their text: a
null text counts as empty, a null or repeated doc_id is a row like any other,
extra columns are carried along, and an empty table gives an empty result.

A stage starts by deleting the scratch tables of the one before it, whose
result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import decontaminate, exact_chunks, mixing, order_minhash, toxicity
from tideglass.llm.common import materialize, remove_scratch, scratch_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from the labelled ones among docs, does not reject."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of largest doc_id."""
    return exact_chunks.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one of least doc_id."""
    return order_minhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their virtual finish time and how many copies of each (1 to 3); those beyond the budget go."""
    return mixing.mix_sources(docs, carry=docs.columns).filter("copies > 0")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_turn(number: int, stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(spark, f"stage {number - 1}")
        with scratch_of(f"stage {number}"):
            return stage(spark, docs, sf_dir)

    return run_stage


_IN_ORDER: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
STAGES: list[tuple[str, Stage]] = [(name, in_turn(number, stage)) for number, (name, stage) in enumerate(_IN_ORDER, 1)]

#: Learned scores, sketches and alignments have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: the stages one after the other, each one's result written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            with scratch_of(f"kept {number}"):
                docs = materialize(docs, f"stage-{number}")
            remove_scratch(spark, f"kept {number - 1}")
    return docs
