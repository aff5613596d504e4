"""Lineage cuts and table access for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import shared_folder

#: Folders that the innermost open block has written.
_OPEN: ContextVar[list[str] | None] = ContextVar("_OPEN", default=None)


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again.

    The result no longer depends on executors that computed it, and it is
    columnar, so later readers prune what they don't need.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (mine := _OPEN.get()) is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by `written` once nothing reads them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


@contextmanager
def _scratch(spark: SparkSession) -> Iterator[None]:
    token = _OPEN.set([])
    try:
        yield
    finally:
        for path in _OPEN.get():
            _delete(spark, path)
        _OPEN.reset(token)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make()` gives, written once; tables that it wrote on the way are deleted."""
    path = f"{shared_folder(spark).rstrip('/')}/vellum-{uuid.uuid4().hex}"
    with _scratch(spark):
        out = make()
        out.write.parquet(path)
    if (mine := _OPEN.get()) is not None:
        mine.append(path)
    return spark.read.schema(out.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have yet, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str):
    """A column by its exact name, which may hold dots."""
    return F.col(f"`{name.replace('`', '``')}`")


def id_type(df: DataFrame, id_column: str) -> str:
    """The type of the id column, which results keep."""
    return df.schema[id_column].dataType.simpleString()


def key_of(columns: list[str]) -> Column:
    """128-bit key of some columns of a row; null has a key of its own, unlike any text's."""
    parts = []
    for name in columns:
        text = col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def content_key(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Column:
    """128-bit key of a row's id and text; equal rows have equal keys."""
    return key_of([id_column, text_column])
