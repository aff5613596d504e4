"""Hashing embeddings, sparse and dense, by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import tokens as K
from vellum.session import saved

DIM = 512


def postings(df: DataFrame, id_column: str = "id", text_column: str = "text", dim: int = DIM) -> DataFrame:
    """(id, bucket, weight): signed sublinear term frequencies by hash bucket.

    A row has all its features, so nothing is shuffled but ids, to find those that
    several rows share; the features of these rows are counted together.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = saved(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("shared")))
    kind = rows.schema["id"].dataType.simpleString()
    if shared.isEmpty():
        return rows.mapInArrow(_posted(dim), f"id {kind}, bucket int, weight double").withColumnRenamed("id", id_column)
    same = F.col("id").eqNullSafe(F.col("shared"))
    alone = rows.join(shared, same, "left_anti").mapInArrow(_posted(dim), f"id {kind}, bucket int, weight double")
    each = rows.join(shared, same, "left_semi").select("id", F.explode(T.with_bigrams(T.search_tokens("text"))).alias("token"))
    counted = each.groupBy("id", "token").agg(F.count("*").alias("n"))
    weighted = counted.select("id", T.token_bucket("token", dim).alias("bucket"), (T.token_sign("token") * (F.log(F.col("n").cast("double")) + 1)).alias("w"))
    return alone.unionByName(weighted.groupBy("id", "bucket").agg(F.sum("w").alias("weight"))).withColumnRenamed("id", id_column)


def _posted(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in K.slices(batch.column(1)):
                place, weight = _features(part, dim)
                total = np.bincount(place, weights=weight, minlength=1)
                there = np.flatnonzero(np.bincount(place, minlength=1))
                ids = batch.column(0).take(pa.array(at + there // dim))
                yield pa.RecordBatch.from_arrays([ids, pa.array((there % dim).astype(np.int32)), pa.array(total[there])], ["id", "bucket", "weight"])
                at += len(part)

    return run


def _features(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Place (row times dim, and bucket) and signed weight of each token and pair of each text."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    points, first = K.code_points(texts)
    t = K.tokens_of(points, first, keywords=False)
    size = max(len(t.words), 1)
    near = t.row[1:] == t.row[:-1]
    pair, which = np.unique(t.word[:-1][near] * size + t.word[1:][near], return_inverse=True)
    joined = pc.binary_join_element_wise(t.words.take(pa.array(pair // size)), t.words.take(pa.array(pair % size)), pa.scalar("_", t.words.type))
    # A pair may read like a token, in which case they count as one feature.
    coded = pc.dictionary_encode(pa.concat_arrays([t.words, joined]))
    feature = coded.indices.to_numpy().astype(np.int64)
    row, feature, times, _ = K.counted(np.concatenate([t.row, t.row[1:][near]]), np.concatenate([feature[t.word], feature[len(t.words) + which]]), len(coded.dictionary))
    digest = K.md5_words(coded.dictionary)
    slot, sign = (digest[:, 0] % dim).astype(np.int64), 1.0 - 2.0 * (digest[:, 1] & 1)
    return row * dim + slot[feature], sign[feature] * (1 + np.log(times))


def embed_texts(texts: pa.Array, dim: int = DIM) -> np.ndarray:
    """(n, dim) unit vectors of texts; all zeros where a text has no token."""
    place, weight = _features(texts, dim)
    out = np.bincount(place, weights=weight, minlength=len(texts) * dim).reshape(len(texts), dim)
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm == 0, 1, norm)[:, None]


def embed_text(text: str | None, dim: int = DIM) -> np.ndarray:
    return embed_texts(pa.array([text], pa.string()), dim)[0]


def embedding(text: Column | str, dim: int = DIM) -> Column:
    """Dense unit vectors, batch by batch."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        out, at = np.empty((len(texts), dim), dtype=np.float32), 0
        for part in K.slices(texts):
            out[at : at + len(part)] = embed_texts(part, dim)
            at += len(part)
        return pa.ListArray.from_arrays(pa.array((np.arange(len(texts) + 1) * dim).astype(np.int32)), pa.array(out.ravel()))

    return run(T.c(text))


def distinct_tokens(text: Column | str) -> Column:
    """The distinct tokens of each row, batch by batch."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in K.slices(texts):
            t = K.tokens_of(*K.code_points(part), keywords=False)
            row, word, _, _ = K.counted(t.row, t.word, len(t.words))
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)), t.words.take(pa.array(word)).cast(pa.string())))
        return pa.concat_arrays(out)

    return run(T.c(text))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where either is empty or zero."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    a, b = double(a), double(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((n > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)
