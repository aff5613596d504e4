"""What a record store and a catalogue have to offer, and those that come along.

Both work on tables: a verb takes all its documents or queries as one DataFrame.
The engine uses any object with these verbs; a store that lacks the two that
keep earlier editions, or inherits them from the protocol alone, is used without.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import search
from vellum.sources.store import SCHEMAS, deleted, demoted, upsert_documents, upsert_versions, upserted, with_flags


class TableStore(Protocol):
    """Where the catalogue's tables live, by their names in `store.SCHEMAS`.

    `read` gives an empty table for a name that was never committed; `commit`
    replaces all tables that it is given, in one step.
    """

    def read(self, name: str) -> DataFrame: ...

    def commit(self, tables: dict[str, DataFrame]) -> None: ...


class RecordStore(Protocol):
    def upsert(self, records: DataFrame) -> None: ...

    def delete_documents(self, docs: DataFrame) -> None: ...

    def delete_editions(self, editions: DataFrame) -> None: ...

    def archive(self, docs: DataFrame) -> None: ...

    def search_semantic(self, queries: DataFrame, k: int, filters: search.Filters | None = None) -> DataFrame: ...

    def search_lexical(self, queries: DataFrame, k: int, filters: search.Filters | None = None) -> DataFrame: ...

    def all_records(self) -> DataFrame: ...

    def persist(self) -> None: ...

    def close(self) -> None: ...


def implements(store: object, verb: str) -> bool:
    """Whether a store has a verb of its own, be it by class, instance or delegation."""
    own = getattr(store, verb, None)
    stub = getattr(RecordStore, verb, None)
    return own is not None and getattr(own, "__func__", own) is not stub


def keeps_editions(store: object) -> bool:
    return implements(store, "archive") and implements(store, "delete_editions")


class SnapshotRecords(RecordStore):
    """Records in the catalogue's snapshots; each verb is one commit."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def _commit(self, records: DataFrame) -> None:
        self.store.commit({"records": records})

    def upsert(self, records: DataFrame) -> None:
        self._commit(upserted(self.store.read("records"), records, "id"))

    def delete_documents(self, docs: DataFrame) -> None:
        self._commit(self.store.read("records").join(docs.select("doc_id").distinct(), "doc_id", "left_anti"))

    def delete_editions(self, editions: DataFrame) -> None:
        self._commit(self.store.read("records").join(editions.select("doc_id", "version_id").distinct(), ["doc_id", "version_id"], "left_anti"))

    def archive(self, docs: DataFrame) -> None:
        self._commit(demoted(self.store.read("records"), docs))

    def search_semantic(self, queries: DataFrame, k: int, filters: search.Filters | None = None) -> DataFrame:
        """(query_id, id, score, rank): filters apply before the k best are taken."""
        return search.semantic(self.all_records().where((filters or search.Filters(is_current=None)).condition()), queries, k)

    def search_lexical(self, queries: DataFrame, k: int, filters: search.Filters | None = None) -> DataFrame:
        return search.lexical(self.all_records().where((filters or search.Filters(is_current=None)).condition()), queries, k)

    def all_records(self) -> DataFrame:
        """Records of documents and the roll-ups, which have a table of their own."""
        return self.store.read("records").unionByName(self.store.read("rollups"))

    def persist(self) -> None:
        """Every commit is on disk already."""

    def close(self) -> None:
        self.persist()


class FlatIndexRecords(SnapshotRecords):
    """Inner-product search over all vectors; filters apply to `FETCH` times k best.

    As with an index that knows nothing of the records' other columns, strict
    filters may leave fewer than k results.
    """

    FETCH = 4

    def search_semantic(self, queries: DataFrame, k: int, filters: search.Filters | None = None) -> DataFrame:
        found = search.semantic(self.all_records(), queries, self.FETCH * k).select("query_id", "id", "score")
        named = found.join(self.all_records().where((filters or search.Filters(is_current=None)).condition()).select("id"), "id", "left_semi")
        return search.top_k(named.select("query_id", "id", "score"), k)


class Catalogue:
    """Documents, editions, chunks and sections of a catalogue, row by row or as tables."""

    def __init__(self, spark: SparkSession, store: TableStore) -> None:
        self.spark, self.store = spark, store

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def upsert_documents(self, docs: DataFrame) -> None:
        self.store.commit({"documents": upsert_documents(self.store.read("documents"), docs)})

    def get_document(self, doc_id: str) -> Row | None:
        return self.store.read("documents").where(F.col("doc_id") == doc_id).first()

    def all_documents(self, include_deleted: bool = False) -> DataFrame:
        docs = self.store.read("documents")
        return docs if include_deleted else docs.where("not is_deleted")

    def mark_deleted(self, *doc_ids: str) -> None:
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        documents, versions = deleted(self.store.read("documents"), self.store.read("versions"), gone)
        self.store.commit({"documents": documents, "versions": versions})

    def upsert_versions(self, versions: DataFrame) -> None:
        self.store.commit({"versions": upsert_versions(self.store.read("versions"), versions)})

    def get_current_version(self, doc_id: str) -> Row | None:
        return self.store.read("versions").where((F.col("doc_id") == doc_id) & F.col("is_current")).first()

    def get_version(self, doc_id: str, version_id: str) -> Row | None:
        return self.store.read("versions").where((F.col("doc_id") == doc_id) & (F.col("version_id") == version_id)).first()

    def set_version_flags(self, doc_id: str, version_id: str, **flags: bool) -> None:
        mine = (F.col("doc_id") == doc_id) & (F.col("version_id") == version_id)
        self.store.commit({"versions": with_flags(self.store.read("versions"), mine, **flags)})

    def save_chunks(self, chunks: DataFrame) -> None:
        self.store.commit({"chunks": upserted(self.store.read("chunks"), chunks, "doc_id", "version_id")})

    def get_chunks(self, doc_id: str, version_id: str) -> DataFrame:
        """Chunks of an edition in their order."""
        return self.store.read("chunks").where((F.col("doc_id") == doc_id) & (F.col("version_id") == version_id)).orderBy("idx")

    def upsert_section(self, name: str, description: str = "", parent_id: str | None = None) -> str:
        row = self.spark.createDataFrame([(name, description, parent_id)], "name string, description string, parent_id string").select(T.stable_key("name").alias("section_id"), "name", "description", "parent_id")
        self.store.commit({"sections": upserted(self.store.read("sections"), row, "section_id")})
        return row.first()["section_id"]

    def all_sections(self) -> DataFrame:
        return self.store.read("sections")

    def assign_membership(self, doc_id: str, section_id: str, confidence: float = 1.0, rationale: str = "") -> None:
        row = self._rows("membership", [(doc_id, section_id, confidence, rationale)])
        self.store.commit({"membership": upserted(self.store.read("membership"), row, "doc_id", "section_id")})

    def sections_of(self, doc_id: str) -> list[str]:
        return sorted(r["section_id"] for r in self.store.read("membership").where(F.col("doc_id") == doc_id).collect())

    def documents_of(self, section_id: str) -> list[str]:
        return sorted(r["doc_id"] for r in self.store.read("membership").where(F.col("section_id") == section_id).collect())

    def close(self) -> None:
        """Every commit is on disk already."""
