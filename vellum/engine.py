"""The catalogue as one object: add sources, build, search."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vellum.config import CatalogConfig
from vellum.operators import indexing, models, rollups, search
from vellum.operators.memory import ConversationMemory
from vellum.operators.models import Embedder, Summarizer
from vellum.session import remove, saved, shared_folder
from vellum.sources import connectors
from vellum.sources.backends import Catalogue, FlatIndexRecords, RecordStore, SnapshotRecords, TableStore, keeps_editions
from vellum.sources.store import SCHEMAS, Store, merge_records, upsert_documents, upsert_versions, upserted

Source = Callable[[], DataFrame]
Fetch = Callable[[str], tuple[str, str] | None]


class Engine:
    """Sources are gathered lazily; `build` analyses what is new and commits it.

    `embed` replaces the hashing embedding by another expression from text to
    array<float>, `summarize` the extractive summaries by one from title and text,
    `records` the snapshots of records by another store, and `store` the snapshots
    of all tables by another home for them.  Earlier editions are
    kept unless `archives=False` or the store can't; then they are deleted.
    `config.backend` chooses among the stores that come along.
    """

    def __init__(self, spark: SparkSession, config: CatalogConfig = CatalogConfig(), embed: Embedder | None = None, archives: bool = True, summarize: Summarizer | None = None, records: RecordStore | None = None, store: TableStore | None = None) -> None:
        if embed is None and config.embedding_provider == "openai":
            embed = models.model_embedder(models.openai_request(config.embedding_model, config.api_key))
        if summarize is None and config.summarizer_provider == "openai":
            summarize = models.model_summarizer(models.openai_complete(config.summarizer_model, config.api_key), config.summary_max_chars, config.summary_input_chars)
        self.spark, self.config, self.embed, self.summarize = spark, config, embed, summarize
        self.store, self.memory, self.sources = store or Store(spark, config.root), ConversationMemory(), []
        self.records = records or {"snapshots": SnapshotRecords, "flat": FlatIndexRecords}[config.backend](self.store)
        self.catalogue, self.own_records = Catalogue(spark, self.store), records is None
        self.archives = archives and keeps_editions(self.records)
        #: What went wrong with the sources of the last build.
        self.errors: list[str] = []
        shared_folder(spark)

    @classmethod
    def open(cls, spark: SparkSession, root: str, embed: Embedder | None = None, summarize: Summarizer | None = None, records: RecordStore | None = None, store: TableStore | None = None, archives: bool = True, **settings) -> Engine:
        return cls(spark, replace(CatalogConfig(root=root), **settings), embed, archives, summarize, records, store)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Everything that was built is already committed."""
        self.sources = []
        self.records.close()

    # -- sources ------------------------------------------------------------------

    def add_source(self, source: Source | DataFrame) -> Engine:
        """A table of assets, or a function that makes one when it is built."""
        self.sources.append(source if callable(source) and not isinstance(source, DataFrame) else lambda: source)
        return self

    def add_path(self, path: str, source_id: str = "filesystem", recursive: bool = True, extensions: list[str] | None = None) -> Engine:
        """A folder or file, or one of an object store where the path has a scheme."""
        remote = "://" in path and not path.startswith("file://")
        read = connectors.from_binary_files if remote else connectors.from_path
        return self.add_source(lambda: read(self.spark, path.removeprefix("file://"), source_id, recursive, extensions))

    def add_text(self, text: str, name: str, source_id: str = "manual", title: str = "") -> Engine:
        return self.add_source(lambda: connectors.from_text(self.spark, text, name, source_id, title))

    def add_pages(self, pages: DataFrame, start_url: str, source_id: str = "web", max_pages: int | None = None) -> Engine:
        """What a crawl of a site reaches in a table of pages (url, html)."""
        return self.add_source(lambda: connectors.from_pages(connectors.crawl(pages, start_url, max_pages or self.config.crawl_max_pages, self.config.crawl_max_depth), source_id))

    def add_url(self, url: str, fetch: Fetch = connectors.http_fetch, source_id: str = "web", max_pages: int | None = None, public: Callable[[str], bool] = connectors.is_public) -> Engine:
        """A live site, crawled on the driver; `fetch` gives (title, html) or None."""

        def read() -> DataFrame:
            found = connectors.crawl_live(url, fetch, max_pages or self.config.crawl_max_pages, self.config.crawl_max_depth, public)
            rows = [(p["url"], p["title"], p["text"], p["depth"]) for p in found]
            return connectors.from_pages(self.spark.createDataFrame(rows, "url string, title string, text string, depth int"), source_id)

        return self.add_source(read)

    def add_table(self, df: DataFrame, table: str, order: list[str], source_id: str = "database", sample_rows: int = 10) -> Engine:
        return self.add_source(lambda: connectors.sampled_table(df, table, order, source_id, sample_rows))

    def add_sql(self, path: str | None = None, connection=None, engine=None, source_id: str = "database", sample_rows: int = 10, tables: list[str] | None = None) -> Engine:
        """The tables of an SQLite file, of a DB-API connection or of an engine that gives one."""
        if path is None and connection is None and engine is None:
            raise ValueError("a database needs a path, a connection or an engine")
        return self.add_source(lambda: connectors.sql_tables(self.spark, path, connection, engine, source_id, sample_rows, tables))

    # -- building -----------------------------------------------------------------

    def build(self, force: bool = False, rebuild_rollups: bool = True) -> dict[str, int]:
        """Index what is new in all sources; counts of indexed, skipped, failed, chunks.

        A source that fails is counted, with the reason kept in `errors`, and doesn't
        stop the others.  Of several editions of a document in one build the last one
        is current.  Where nothing is new no table but the roll-ups is written.
        """
        counts = dict.fromkeys(("indexed", "skipped", "failed", "chunks"), 0)
        sources, self.sources, self.errors = self.sources, [], []
        versions, staged, paths = self.store.read("versions"), [], []
        for n, source in enumerate(sources):
            path = f"{shared_folder(self.spark).rstrip('/')}/staged-{time.time_ns()}-{n}"
            paths.append(path)
            try:
                items = indexing.identified(source()).withColumn("seq", F.col("seq") + (n << 48))
                known = indexing.unchanged(items, versions)
                fresh = items if force else items.join(known, ["doc_id", "content_hash"], "left_anti")
                indexing.analysed(fresh, self.config, self.summarize).write.parquet(path)
                if not force:
                    counts["skipped"] += items.join(known, ["doc_id", "content_hash"], "left_semi").count()
                staged.append(self.spark.read.parquet(path))
            except Exception as e:
                counts["failed"] += 1
                self.errors.append(f"source {n}: {type(e).__name__}: {e}")
        try:
            if staged:
                self._commit(reduce(DataFrame.unionByName, staged), counts)
        finally:
            for path in paths:
                remove(self.spark, path)
        if rebuild_rollups:
            self.rebuild_rollups()
        return counts

    def _commit(self, rows: DataFrame, counts: dict[str, int]) -> None:
        seen = rows.agg(F.count("blocks").alias("ok"), F.count(F.when(F.col("blocks").isNull(), 1)).alias("bad"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks")).first()
        counts["failed"] += seen["bad"]
        if not seen["ok"]:
            return
        counts["indexed"], counts["chunks"] = seen["ok"], seen["chunks"]
        last = F.desc("seq")
        docs = rows.where("blocks is not null").withColumn("edition", F.concat("doc_id", "version_id"))
        docs = indexing.newest(docs, "edition", last).drop("edition")
        current = indexing.newest(docs.select("doc_id", "version_id", "seq"), "doc_id", last).select("doc_id", "version_id", F.lit(True).alias("is_current"))
        docs = docs.join(current, ["doc_id", "version_id"], "left").withColumn("is_current", F.col("is_current").isNotNull())
        now = F.lit(time.time())
        old = {name: self.store.read(name) for name in SCHEMAS}
        documents = docs.where("is_current").select("doc_id", "source_id", "uri", "title", "media_type", "size", "metadata", "folder", F.col("profile.modality").alias("modality"), "seq", now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("is_deleted"))
        yes = F.lit(True)
        versions = docs.select("doc_id", "version_id", "content_hash", "size", "is_current", "summary", "keywords", *(yes.alias(f) for f in ("parsed", "summarized", "chunked", "embedded")), now.alias("created_at"))
        tables = {
            "documents": upsert_documents(old["documents"], documents),
            "versions": upsert_versions(old["versions"], versions),
            "chunks": upserted(old["chunks"], indexing.chunks_of(docs), "doc_id", "version_id"),
        }
        made = indexing.records_of(docs, old["membership"], self.config, self.embed)
        if self.own_records:
            # In one commit with what they belong to.
            self.store.commit(tables | {"records": merge_records(old["records"], made, self.archives)})
            return
        if self.archives:
            self.records.archive(docs.select("doc_id").distinct())
            self.records.delete_editions(docs.select("doc_id", "version_id").distinct())
        else:
            self.records.delete_documents(docs.select("doc_id").distinct())
        self.records.upsert(made)
        self.records.persist()
        self.store.commit(tables)

    def items(self) -> DataFrame:
        """Documents that aren't deleted, with the summary of their current edition."""
        current = self.store.read("versions").where("is_current").select("doc_id", "summary")
        return self.store.read("documents").where("not is_deleted").join(current, "doc_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))

    def rebuild_rollups(self) -> None:
        items = self.items().select("doc_id", "uri", "title", "folder", "summary", "seq")
        how = self.summarize or True
        made = rollups.folder_rollups(items, summarize=how).unionByName(rollups.section_rollups(self.store.read("sections"), self.store.read("membership"), items, summarize=how))
        records = indexing.rollup_records(made, self.config, self.embed)
        if self.own_records:
            self.store.commit({"rollups": records})
            return
        old = self.records.all_records().where(F.col("doc_type").isin(search.FOLDER, search.SECTION)).select("doc_id").distinct()
        self.records.delete_documents(saved(old))
        self.records.upsert(records)
        self.records.persist()

    def delete(self, *doc_ids: str) -> None:
        """Mark documents as deleted; their records are no longer found."""
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        self.catalogue.mark_deleted(*doc_ids)
        self.records.delete_documents(gone)

    # -- sections -----------------------------------------------------------------

    def create_section(self, name: str, description: str = "", parent_id: str | None = None) -> str:
        return self.catalogue.upsert_section(name, description, parent_id)

    def assign(self, doc_id: str, section_id: str, confidence: float = 1.0, rationale: str = "") -> None:
        self.catalogue.assign_membership(doc_id, section_id, confidence, rationale)

    # -- reading ------------------------------------------------------------------

    def search_all(self, queries: DataFrame, k: int | None = None, **options) -> DataFrame:
        """Evidence for a table of queries (query_id, query)."""
        return search.search(self.records.all_records(), queries, k, self.config, **options)

    def search(self, query: str, k: int | None = None, use_memory: bool = False, **options) -> list[Row]:
        """Ranked evidence for one query."""
        text = self.memory.context_query(query) if use_memory else query
        asked = self.spark.createDataFrame([(0, text)], "query_id bigint, query string")
        return self.search_all(asked, k, **options).orderBy("position").drop("query_id").collect()

    def context(self, query: str, k: int | None = None, **options) -> str:
        return "\n\n".join(f"[{i}] {e['citation']}\n{e['excerpt']}" for i, e in enumerate(self.search(query, k, **options), 1))

    def stats(self) -> dict:
        by_type = {r["doc_type"]: r["count"] for r in self.records.all_records().groupBy("doc_type").count().collect()}
        return {"documents": self.store.read("documents").where("not is_deleted").count(), "sections": self.store.read("sections").count(), "index_records": sum(by_type.values()), "by_type": by_type}

    def as_tool(self, name: str = "catalogue_search", k: int | None = None) -> Tool:
        return Tool(self, name, k or self.config.default_k)


class Tool:
    """Search as a tool that language models can call."""

    ABOUT = "Search the document catalogue; returns ranked evidence with citations."

    def __init__(self, engine: Engine, name: str, k: int) -> None:
        self.engine, self.name, self.k = engine, name, k
        self.parameters = {
            "type": "object",
            "properties": {
                "query": {"type": "string", "description": "What to look for, in plain words."},
                "k": {"type": "integer", "description": "Results at most.", "default": k},
                "source_ids": {"type": "array", "items": {"type": "string"}, "description": "Only these sources."},
            },
            "required": ["query"],
        }

    def run(self, query: str, k: int | None = None, source_ids: list[str] | None = None) -> dict:
        found = self.engine.search(query, k or self.k, source_ids=tuple(source_ids) if source_ids else None)
        return {"evidence": [r.asDict(recursive=True) for r in found]}

    __call__ = run

    def run_json(self, query: str, k: int | None = None, source_ids: list[str] | None = None) -> str:
        return json.dumps(self.run(query, k, source_ids), ensure_ascii=False)

    def as_langchain_tool(self):
        """The tool as LangChain's StructuredTool; needs its package."""
        from langchain.tools import StructuredTool

        def find(query: str, k: int = self.k) -> str:
            return self.run_json(query, k)

        find.__doc__ = self.ABOUT
        return StructuredTool.from_function(func=find, name=self.name, description=self.ABOUT)

    def chat_schema(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.ABOUT, "parameters": self.parameters}}

    def responses_schema(self) -> dict:
        return {"type": "function", "name": self.name, "description": self.ABOUT, "parameters": self.parameters}

    def messages_schema(self) -> dict:
        return {"name": self.name, "description": self.ABOUT, "input_schema": self.parameters}
