"""The training-data pipeline: documents in, sharded training mix out.

Each stage is one of the corpus operators with production parameters.  It gets
all that its predecessor kept, read from Parquet; its decisions take effect.

Defined results: rows with null or empty text are clean to the classifier, belong
to no group and hold no benchmark item, so they stay until the mix, in which they
count as empty; a source of nothing else, and so of no size, gives nothing to the
mix.  Of rows that repeat id and text one stays.  Very long texts pass every stage
whole.  An empty table gives an empty table with shard and slot, an empty benchmark
removes nothing, and without usable labels the first stage keeps all.  Columns
other than doc_id, text and source pass through under their names, and should one
be called shard or slot, the added one gets an underscore.  Ids keep their type.
Ties are settled as the stages' operators say: the smallest id of a group stays,
equally probable classes count as clean, and rows equal in every column take
successive places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import classifier, decontaminate, mixing, sharding, simhash
from vellum.llm.shared import drop_written, settled, table
from vellum.session import spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality or toxic go."""
    return classifier.accepted(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or sampled to their source's share of the mix."""
    return mixing.mixed(docs, mixing.epochs(mixing.source_sizes(docs)))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a reproducible shuffle, with shard and slot."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mixing", mix),
    ("sharding", shard),
]

#: The classifier's training and the SimHash groups can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, made = spread(table(spark, sf_dir, "documents")), False
    for _, stage in STAGES:
        kept = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if made:
            drop_written(docs)
        docs, made = kept, True
    return docs
