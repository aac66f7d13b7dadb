"""The registered queries of this subpackage, one for each operator, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontam, id_codec, kneser_ney, langid, line_quality, mixing, simhash, token_counts, toxicity, warc
from inkwell.llm.encoder import vocabulary_path
from inkwell.session import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return register


@query()
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(mixing.MIX_SQL)
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


@query(decontam.CONTAMINATION_SQL)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, and where."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scores(docs, toxicity.train(docs, labels))


@query()
def op8_token_id_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest as read back from the written shards."""
    return id_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary_path(id_codec.VOCABULARY))


@query(line_quality.MEASURE_SQL)
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of every document."""
    return line_quality.measure(table(spark, sf_dir, "documents")).drop("cleaned")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


@query()
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score and the model's score of every document."""
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.train(docs, kneser_ney.ORDER))


@query(warc.REVISIT_SQL)
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the written archives."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("html", "url")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
