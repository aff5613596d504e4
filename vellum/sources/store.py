"""The catalogue's tables: Parquet snapshots behind one pointer file.

A table's snapshot is a folder that never changes.  A commit writes the new
snapshots of the tables that changed, then replaces the pointer in one step, so
readers see all of a commit or nothing, and a job that dies leaves the last
commit.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id string, source_id string, uri string, title string, media_type string, size bigint, metadata map<string,string>, folder string, modality string, seq bigint, created_at double, updated_at double, is_deleted boolean",
    "versions": "doc_id string, version_id string, content_hash string, size bigint, is_current boolean, summary string, keywords array<string>, parsed boolean, summarized boolean, chunked boolean, embedded boolean, created_at double",
    "chunks": "chunk_id string, doc_id string, version_id string, idx int, text string, heading string, location string, token_count int, text_hash string",
    "sections": "section_id string, name string, description string, parent_id string",
    "membership": "doc_id string, section_id string, confidence double, rationale string",
    "records": "id string, doc_type string, doc_id string, text string, title string, uri string, source_id string, version_id string, location string, is_current boolean, section_ids array<string>, tags array<string>, vector array<float>, terms array<string>",
}
#: Roll-ups are records, too, but are made anew by every build.
SCHEMAS["rollups"] = SCHEMAS["records"]
#: Search reads few kinds of records, mostly current ones.
PARTITIONS = {"records": ["doc_type", "is_current"], "rollups": ["doc_type"]}
FLAGS = ("is_current", "parsed", "summarized", "chunked", "embedded")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict[str, str]:
        """Folder of each table's current snapshot; empty where nothing is committed."""
        path, fs = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        at = self.pointer().get(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        columns = [c.strip().split(" ")[0] for c in SCHEMAS[name].replace("map<string,string>", "map").split(",")]
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{at}").select(*columns)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write new snapshots and move the pointer to them; old ones stay."""
        now = self.pointer()
        for name, df in tables.items():
            at = f"{name}/{uuid.uuid4().hex}"
            df.write.partitionBy(*PARTITIONS.get(name, [])).parquet(f"{self.root}/{at}")
            now[name] = at
        jvm = self.spark._jvm
        draft, fs = self._fs(f"{self.root}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(now).encode())
        out.close()
        to, _ = self._fs(f"{self.root}/CURRENT")
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, to, overwrite)

    def vacuum(self) -> None:
        """Delete snapshots that the pointer no longer names."""
        kept = set(self.pointer().values())
        for name in SCHEMAS:
            path, fs = self._fs(f"{self.root}/{name}")
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f"{name}/{f.getPath().getName()}" not in kept:
                    fs.delete(f.getPath(), True)


# -- merges -----------------------------------------------------------------------


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """All of `new`, and of `old` the rows with other keys."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*new.columns).unionByName(new)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by doc_id; a known document keeps when it was created and its place."""
    before = old.select("doc_id", F.col("created_at").alias("_created"), F.col("seq").alias("_seq"))
    dated = new.join(before, "doc_id", "left").withColumn("created_at", F.coalesce("_created", "created_at")).withColumn("seq", F.coalesce("_seq", "seq")).drop("_created", "_seq")
    return upserted(old, dated.select(*old.columns), "doc_id")


def upsert_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (doc_id, version_id); other editions of those documents are demoted."""
    before = old.select("doc_id", "version_id", F.col("created_at").alias("_created"))
    dated = new.join(before, ["doc_id", "version_id"], "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created").select(*old.columns)
    return upserted(demoted(old, new), dated, "doc_id", "version_id")


def demoted(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with is_current false for the documents of `new`."""
    touched = new.select("doc_id").distinct().withColumn("_touched", F.lit(True))
    return old.join(touched, "doc_id", "left").withColumn("is_current", F.col("is_current") & F.col("_touched").isNull()).drop("_touched").select(*old.columns)


def with_flags(versions: DataFrame, where: Column, **flags: bool) -> DataFrame:
    """Set flags of some versions; names that aren't flags are ignored."""
    return versions.withColumns({k: F.when(where, F.lit(v)).otherwise(F.col(k)) for k, v in flags.items() if k in FLAGS})


def deleted(documents: DataFrame, versions: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark documents deleted and demote all their versions."""
    gone = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    marked = documents.join(gone, "doc_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_gone").isNotNull()).drop("_gone").select(*documents.columns)
    return marked, demoted(versions, doc_ids)


def merge_records(old: DataFrame, new: DataFrame, archives: bool = True) -> DataFrame:
    """Add a build's records: those of earlier editions are archived, or go."""
    if not archives:
        return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns).unionByName(new)
    again = new.select("doc_id", "version_id").distinct()
    return demoted(old.join(again, ["doc_id", "version_id"], "left_anti").select(*new.columns), new).unionByName(new)
