"""The corpus pipeline: stages that run one after another over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontam, id_codec, mixing, simhash, toxicity
from inkwell.llm.encoder import vocabulary_path
from inkwell.session import materialize, release, table


def bound_batches(spark: SparkSession) -> None:
    """Whole texts pass through Python in the stages; batches by bytes instead of ten thousand rows keep workers and the JVM's buffers small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group stays."""
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id data set, as read back from its shards."""
    bound_batches(spark)
    return id_codec.round_trip(docs, vocabulary_path(id_codec.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_ids", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder for the next and deleted after it. Null and empty
    texts pass the filters (one of them the near-duplicates); an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if number:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
