"""From assets to analysed documents, and from those to index records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import CatalogConfig
from vellum.functions import text as T
from vellum.operators import content, vectors
from vellum.operators.models import Embedder, Summarizer, extractive
from vellum.operators.search import CHUNK, FOLDER, SECTION, SUMMARY, haystack
from vellum.sources import readers

RECORD = ("id", "doc_type", "doc_id", "text", "title", "uri", "source_id", "version_id", "location", "is_current", "section_ids", "tags", "vector", "terms")


def identified(assets: DataFrame) -> DataFrame:
    """Assets with doc_id, version_id, content_hash, size and folder."""
    web = F.startswith("uri", F.lit("http://")) | F.startswith("uri", F.lit("https://"))
    return assets.select(
        "*", T.document_id("source_id", "uri").alias("doc_id"), T.version_id("data").alias("version_id"), F.sha2("data", 256).alias("content_hash"), F.length("data").cast("bigint").alias("size"), T.folder_of(F.when(web, F.col("uri")).otherwise(F.col("name"))).alias("folder")
    )


def unchanged(items: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, content_hash) of items whose current edition is already indexed."""
    known = versions.where("is_current and embedded").select("doc_id", "content_hash")
    return items.select("doc_id", "content_hash").join(known, ["doc_id", "content_hash"], "left_semi").distinct()


def analysed(items: DataFrame, config: CatalogConfig = CatalogConfig(), summarize: Summarizer | None = None) -> DataFrame:
    """Identified assets with blocks, profile, summary, keywords and chunks.

    `blocks` is null where a file can't be decoded.  Nothing is shuffled.
    """
    read = items.withColumn("blocks", readers.parsed("name", "data")).drop("data")
    body = read.withColumn("body", F.coalesce(readers.block_text("blocks"), F.lit(""))).withColumn("profile", content.profile("blocks", "media_type"))
    return body.select(
        "*",
        content.profile_text(F.col("profile")).alias("about"),
        (summarize or extractive(config.summary_max_chars))(F.col("title"), F.substring("body", 1, config.summary_input_chars)).alias("summary"),
        content.keywords("body").alias("keywords"),
        content.block_chunks("blocks", config.chunk_max_tokens, config.chunk_overlap_tokens).alias("chunks"),
    ).drop("body")


def chunks_of(docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, version_id, idx, text, heading, location, token_count, text_hash)."""
    each = docs.select("doc_id", "version_id", F.explode("chunks").alias("c"))
    return each.select(T.chunk_id("doc_id", "version_id", "c.index").alias("chunk_id"), "doc_id", "version_id", F.col("c.index").alias("idx"), F.col("c.text").alias("text"), F.col("c.heading").alias("heading"), F.col("c.location").alias("location"), F.col("c.token_count").alias("token_count"), F.sha2("c.text", 256).alias("text_hash"))


def records_of(docs: DataFrame, membership: DataFrame, config: CatalogConfig = CatalogConfig(), embed: Embedder | None = None, searchable: bool = True) -> DataFrame:
    """One summary record per document and one record per chunk, embedded unless a search is to do that as it reads."""
    topics = F.when(F.size("profile.topics") > 0, F.col("profile.topics")).otherwise(F.col("keywords"))
    tags = F.slice(F.array_distinct(F.concat(topics, "keywords")), 1, 16)
    sections = membership.groupBy("doc_id").agg(F.sort_array(F.collect_set("section_id")).alias("section_ids"))
    known = docs.join(sections, "doc_id", "left").withColumn("section_ids", F.coalesce("section_ids", F.array().cast("array<string>")))
    brief = F.struct(
        F.concat(F.lit("summary::"), "doc_id", F.lit("::"), "version_id").alias("id"),
        F.lit(SUMMARY).alias("doc_type"),
        T.summary_record(F.col("title"), F.col("folder"), F.col("about"), F.col("summary"), F.col("keywords")).alias("text"),
        F.lit("").alias("location"),
        tags.alias("tags"),
    )

    def part(c: Column) -> Column:
        header = T.context_header(F.col("title"), F.col("folder"), F.col("about"), F.col("summary"), c["heading"])
        return F.struct(T.chunk_id("doc_id", "version_id", c["index"]).alias("id"), F.lit(CHUNK).alias("doc_type"), T.with_header(header, c["text"]).alias("text"), F.coalesce(c["location"], F.lit("")).alias("location"), F.slice("keywords", 1, 8).alias("tags"))

    each = known.select("doc_id", "title", "uri", "source_id", "version_id", "section_ids", "is_current", F.explode(F.concat(F.array(brief), F.transform("chunks", part))).alias("r"))
    flat = each.select("r.id", "r.doc_type", "doc_id", "r.text", "title", "uri", "source_id", "version_id", "r.location", "is_current", "section_ids", "r.tags")
    return _searchable(flat, config, embed) if searchable else flat


def _searchable(records: DataFrame, config: CatalogConfig, embed: Embedder | None) -> DataFrame:
    """Records with their vectors and the distinct terms that lexical search meets."""
    vector = embed(F.col("text")) if embed else vectors.embedding("text", config.embedding_dim)
    return records.withColumn("vector", vector).withColumn("terms", vectors.distinct_tokens(haystack())).select(*RECORD)


def rollup_records(rollups: DataFrame, config: CatalogConfig = CatalogConfig(), embed: Embedder | None = None) -> DataFrame:
    name = F.when(T.base_name("key") != "", T.base_name("key")).otherwise(F.col("key"))
    none = F.array().cast("array<string>")
    flat = rollups.where(F.col("doc_type").isin(FOLDER, SECTION)).select(
        F.col("rollup_id").alias("id"), "doc_type", F.col("rollup_id").alias("doc_id"), "text", F.concat(F.lit("["), "kind", F.lit(" roll-up] "), name).alias("title"), F.col("key").alias("uri"), F.lit("").alias("source_id"), F.lit("").alias("version_id"), F.col("key").alias("location"), F.lit(True).alias("is_current"), none.alias("section_ids"), none.alias("tags")
    )
    return _searchable(flat, config, embed)


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
