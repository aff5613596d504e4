"""Queries of what a catalogue holds: assets, blocks, documents, editions, records.

They register themselves beside those of `vellum.plans.catalogue`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import content, search, vectors
from vellum.plans.catalogue import _PROFILED, _TEXT, _sampled, asked, assets, documents, query, records, table
from vellum.plans.sql import KEYWORDS, hybrid_sql
from vellum.session import saved, shared_folder
from vellum.sources import connectors, readers
from vellum.sources import store as stores

_NAME = "lang || '/' || doc_id || '.txt'"


# Assets and blocks


@query(f"SELECT source AS source_id, 'text://' || doc_id AS uri, {_NAME} AS name, doc_id || '.txt' AS title, 'txt' AS media_type, strlen(text) AS size, doc_id AS seq FROM documents")
def text_assets(spark, sf_dir):
    """Texts as assets, with defaults for title and media type."""
    return assets(spark, sf_dir).select("source_id", "uri", "name", "title", "media_type", F.length("data").cast("bigint").alias("size"), "seq")


_TITLE = "trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'))"


@query(f"SELECT url AS uri, coalesce(nullif(title, ''), url) || '.html' AS name, coalesce(nullif(title, ''), url) AS title, 'html' AS media_type, text AS data FROM (SELECT url, {_TITLE} AS title, {_TEXT} AS text FROM pages) WHERE url <> '' AND text <> ''")
def page_assets(spark, sf_dir):
    """Crawled pages as assets."""
    pages = table(spark, sf_dir, "pages").select("url", readers.html_title("html").alias("title"), readers.html_text("html").alias("text"), F.lit(0).alias("depth"))
    return connectors.from_pages(pages).select("uri", "name", "title", "media_type", F.decode("data", "UTF-8").alias("data"))


@query(r"SELECT doc_id, 'text' AS type, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, doc_id || '.txt' AS location FROM documents WHERE trim(text) <> ''")
def plain_blocks(spark, sf_dir):
    """What the reader of plain text makes of each document."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    read = documents(spark, sf_dir).select("doc_id", F.inline(readers.parsed(name, F.encode("text", "UTF-8"))))
    return read.select("doc_id", "type", "text", "location")


@query(f"SELECT page_id, {_TEXT} AS text FROM pages WHERE {_TEXT} <> ''")
def html_blocks(spark, sf_dir):
    """What the reader of HTML makes of each page, by its Arrow decoder."""
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(readers.parsed(name, F.encode("html", "UTF-8")))).select("page_id", "text")


_GRID = " UNION ALL ".join(
    f"SELECT 'sql://db/{t}' AS uri, 0 AS n, '{' | '.join(cs)}' AS line UNION ALL SELECT 'sql://db/{t}', row_number() OVER (ORDER BY {', '.join(k)}), line FROM (SELECT {', '.join(k)}, {' || chr(32) || chr(124) || chr(32) || '.join(f'coalesce({c}::VARCHAR, chr(0))' for c in cs).replace('chr(0)', repr(''))} AS line FROM {t} ORDER BY {', '.join(k)} LIMIT 10)"
    for t, (k, cs) in _PROFILED.items()
)


@query(f"SELECT uri, n::BIGINT AS n, line FROM ({_GRID})")
def table_grid(spark, sf_dir):
    """Sampled tables as the reader of CSV shows them: cells between bars."""
    read = _sampled(spark, sf_dir).select("uri", F.inline(readers.parsed("name", "data")))
    return read.select("uri", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("bigint"))


_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, string_split({_PATH}, '/')[-1] AS base, lower(regexp_extract(string_split({_PATH}, '/')[-1], '[^.].*\\.([^.]*)$', 1)) AS extension FROM pages")
def path_names(spark, sf_dir):
    """Last part of each page's path and its extension."""
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(T.url_path("url")).alias("base"), T.extension(T.url_path("url")).alias("extension"))


@query(
    f"WITH {KEYWORDS}, k AS (SELECT doc_id, string_agg(token, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS five, string_agg(token, ', ' ORDER BY rank) AS k FROM ranked WHERE rank <= 8 GROUP BY doc_id) SELECT doc_id, CASE WHEN trim(text) = '' THEN '{content.NO_TEXT}' WHEN k IS NOT NULL THEN 'Prose document about ' || five || '. Topics: ' || k || '.' ELSE regexp_replace('Document beginning: ' || substr(string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1], 1, 200), '\\s+$', '') END AS about FROM documents LEFT JOIN k USING (doc_id)"
)
def profile_as_text(spark, sf_dir):
    """Each document's profile as it stands in headers."""
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit("").alias("location")))
    return documents(spark, sf_dir).select("doc_id", content.profile(blocks, F.lit("txt")).alias("p")).select("doc_id", content.profile_text(F.col("p")).alias("about"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_neighbours(spark, sf_dir):
    """The cosine expression on each vector and the next."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return pairs.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 9).alias("cosine"))


@query(
    f"WITH h AS ({hybrid_sql(final=False)}), e AS (SELECT query_id, rank, '[' || rank || '] ' || id || '.txt' || chr(10) || substr(text, 1, 800) AS block FROM h JOIN documents ON doc_id = id) SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM e GROUP BY query_id"
)
def hybrid_context(spark, sf_dir):
    """Numbered citations and excerpts of each query's best documents."""
    pool = records(spark, sf_dir)
    found = search.hybrid(pool, asked(spark, sf_dir), 8).select("query_id", "id", "score", F.col("rank").alias("position"))
    return search.context_blocks(search.evidence(search.sent(saved(found)).join(pool, "id")))


# Documents and editions


def _documents(spark, sf_dir, at: float, mark: str, condition: str):
    rows = documents(spark, sf_dir).where(condition)
    number = F.col("doc_id").cast("string")
    return rows.select(
        number.alias("doc_id"), F.col("source").alias("source_id"), F.concat(F.lit("text://"), number).alias("uri"), F.concat(F.lit(mark), number).alias("title"), F.lit("txt").alias("media_type"), F.length("text").cast("bigint").alias("size"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.col("lang").alias("folder"), F.lit("prose").alias("modality"), (F.col("doc_id") + F.lit(int(at) * 1_000_000)).alias("seq"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"), F.lit(False).alias("is_deleted"),
    )


@query(
    """
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE 'old ' END || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS updated_at, doc_id + CASE WHEN doc_id % 2 = 0 THEN 1000000 ELSE 2000000 END AS seq
FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
"""
)
def document_upsert(spark, sf_dir):
    """Documents of two builds: known ones keep their place and when they were created."""
    merged = stores.upsert_documents(_documents(spark, sf_dir, 1.0, "old ", "doc_id % 2 = 0"), _documents(spark, sf_dir, 2.0, "new ", "doc_id % 3 = 0"))
    return merged.select("doc_id", "title", "created_at", "updated_at", "seq")


def _versions(spark, sf_dir, at: float, suffix: str = ""):
    text = F.concat("text", F.lit(suffix))
    flags = [F.lit(True).alias(f) for f in stores.FLAGS]
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2(text, 256).alias("version_id"), F.sha2(text, 256).alias("content_hash"), F.length(text).cast("bigint").alias("size"), *flags, F.lit("").alias("summary"), F.array().cast("array<string>").alias("keywords"), F.lit(at).alias("created_at"))


@query("SELECT doc_id::VARCHAR AS doc_id, doc_id % 5 = 0 AS is_deleted, doc_id % 5 <> 0 AS is_current FROM documents")
def documents_deleted(spark, sf_dir):
    """Every fifth document marked as deleted, its editions with it."""
    gone = documents(spark, sf_dir).where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    docs, versions = stores.deleted(_documents(spark, sf_dir, 1.0, "", "true"), _versions(spark, sf_dir, 1.0), gone)
    return docs.select("doc_id", "is_deleted").join(versions.select("doc_id", "is_current"), "doc_id")


@query("SELECT doc_id::VARCHAR AS doc_id, doc_id % 2 <> 0 AS embedded, true AS chunked FROM documents")
def version_flags(spark, sf_dir):
    """A flag taken from every second edition; names that aren't flags change nothing."""
    even = F.col("doc_id").cast("bigint") % 2 == 0
    return stores.with_flags(_versions(spark, sf_dir, 1.0), even, embedded=False, summary=False).select("doc_id", "embedded", "chunked")


def _editions(spark, sf_dir):
    """Records of a first build, and of a second one in which every third document is new."""
    rows = records(spark, sf_dir).withColumn("vector", F.array().cast("array<float>"))
    number = F.col("id") % 3 == 0
    old = rows.withColumn("version_id", F.lit("first"))
    new = rows.where(number).withColumn("version_id", F.lit("second"))
    name = F.concat_ws("::", "doc_id", "version_id")
    return old.withColumn("id", name), new.withColumn("id", name)


@query("SELECT doc_id || '::first' AS id, doc_id % 3 <> 0 AS is_current FROM documents UNION ALL SELECT doc_id || '::second', true FROM documents WHERE doc_id % 3 = 0")
def records_archived(spark, sf_dir):
    """Records of both builds, where the store keeps earlier editions."""
    return stores.merge_records(*_editions(spark, sf_dir)).select("id", "is_current")


@query("SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '::second' ELSE '::first' END AS id, true AS is_current FROM documents")
def records_replaced(spark, sf_dir):
    """The same where it doesn't."""
    return stores.merge_records(*_editions(spark, sf_dir), archives=False).select("id", "is_current")


@query("SELECT doc_id::VARCHAR AS doc_id, title, sha256(text) AS version_id FROM (SELECT doc_id, text, 'kept ' || doc_id AS title FROM documents WHERE doc_id % 5 <> 0)")
def documents_with_versions(spark, sf_dir):
    """Documents that aren't deleted, with their current edition."""
    gone = documents(spark, sf_dir).where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    docs, versions = stores.deleted(_documents(spark, sf_dir, 1.0, "kept ", "true"), stores.upsert_versions(_versions(spark, sf_dir, 1.0, " before"), _versions(spark, sf_dir, 2.0)), gone)
    return docs.where("not is_deleted").join(versions.where("is_current"), "doc_id", "left").select("doc_id", "title", "version_id")


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(lang) AS section_id, 0.5::DOUBLE AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE 'first' END AS rationale FROM documents")
def snapshot_round_trip(spark, sf_dir):
    """Membership committed twice to a store of its own and read again."""
    store = stores.Store(spark, f"{shared_folder(spark).rstrip('/')}/holdings-{uuid.uuid4().hex}")
    member = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("lang", 256).alias("section_id"), F.lit(0.5).alias("confidence"), F.lit("first").alias("rationale"))
    store.commit({"membership": member})
    again = member.where(F.col("doc_id").cast("bigint") % 2 == 0).withColumn("rationale", F.lit("again"))
    store.commit({"membership": stores.upserted(store.read("membership"), again, "doc_id", "section_id")})
    store.vacuum()
    return store.read("membership")
