"""The corpus operators as queries over the tables of a scale folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import classifier, decontaminate, langid, lines, mixing, repetition, secrets, sharding, simhash, suffixes
from vellum.llm.shared import table
from vellum.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row number, shuffled place, shard and slot of every document."""
    return sharding.assignments(documents(spark, sf_dir))


SQL["op1_feistel_sharding"] = sharding.SHARD_SQL


@query
def op2_cross_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that are spread over many sites."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return lines.without_boilerplate(docs, removed_column="n_removed").drop("source")


SQL["op2_cross_site_lines"] = lines.LINE_SQL


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, exactly or in proximity."""
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("key")


@query
def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated n-gram and line characters and the verdict for every document."""
    return repetition.repetition(documents(spark, sf_dir))


SQL["op4_repetition_coverage"] = repetition.REPETITION_SQL


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that occurs again, with its document."""
    return suffixes.repeated_passages(documents(spark, sf_dir))


SQL["op5_repeated_passages"] = suffixes.PASSAGE_SQL


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret that a rule finds in a document."""
    return secrets.secrets(documents(spark, sf_dir))


SQL["op6_secret_scan"] = secrets.SECRET_SQL


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, and what it costs to parse it in it."""
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.training_text(docs)).withColumn("bits", F.round("bits", 6))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, probability of being clean and verdict for every document."""
    docs = documents(spark, sf_dir)
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).withColumn("clean", F.round("clean", 6))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a near-duplicate group, with its group and whether it stays."""
    return simhash.near_duplicate_groups(documents(spark, sf_dir)).select("doc_id", "group_id", "group_size", "keep")


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repetition of every document in the mix."""
    docs = documents(spark, sf_dir)
    shares = mixing.epochs(mixing.source_sizes(docs))
    return mixing.mixed(docs.select("doc_id", "source"), shares, copy_column="copy")


SQL["op10_source_mixing"] = mixing.MIX_SQL


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the sharded training mix."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
