"""Supervised subword-embedding classifier of document quality.

A document is the average of learned vectors of its features: hashed words,
hashed character n-grams of each word (3 to 5 bytes with word ends marked) and
hashed pairs of neighbouring words, where a word that follows itself has one
feature of its own.  A softmax layer on the average tells the classes apart,
and both layers are trained by stochastic gradient descent in numpy.  A step
on the vectors is divided by the squared length of the document's average, so
that long and short documents move the output alike.

Training reads a bounded sample of the labelled rows (`TRAIN_ROWS`, chosen by
hash of the id, so it is the same on every run).  Executors turn whole texts into
buckets and shares, of which a text has at most `BUCKETS`, so what the driver
gets is bounded whatever the texts' lengths.  Scoring covers every document and
its whole text: as the output layer is linear in the average, each bucket's
product with it is formed once and scoring only adds those up.

Defined results: null or empty text has no features and gets the prior of the
classes; labels that are null or have no document are left out; where an id
has several labels the worse counts, and where it has several texts the least
text is trained on; without any usable label everything stays; repeated rows and
very long texts are each scored whole; ids keep their type; an empty table gives
no rows; other columns, whatever their names, pass through.  Ties: of equally
probable classes the first of CLASSES wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import col, id_type
from vellum.llm.textkit import _VALUE, _WORD, U64, gram_hashes, mix64, slices, span_hashes, spans_of, text_buffers, tidy

CLASSES = ("clean", "low_quality", "toxic")
#: Most labelled rows that training uses.
TRAIN_ROWS = 6000
BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4, 5)
EPOCHS = 5
RATE = 4.0
SEED = 17
#: Bytes of text worked on at once; the arrays of n-grams grow with it.
SLICE = 1 << 18
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BUCKET_BITS = U64(64 - BUCKETS.bit_length() + 1)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(h ^ U64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> _BUCKET_BITS).astype(np.int64)


@dataclass
class Words:
    """Distinct words of some rows with their features, and the rows' tokens."""

    row: np.ndarray  # of each token
    word: np.ndarray  # index of each token's distinct word
    feature: np.ndarray  # buckets, word by word
    first: np.ndarray  # where each distinct word's buckets begin
    pair_row: np.ndarray
    pair: np.ndarray  # bucket of each pair of neighbouring words


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    base = offsets[0]
    raw, bounds = raw[base : offsets[-1]], offsets - base
    letters = _WORD[raw]
    s1, e1 = spans_of(letters, bounds)
    s2, e2 = spans_of(~letters & ~_SPACE[raw], bounds)
    start, end = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    hashes = span_hashes(raw, start, end)
    row = np.searchsorted(bounds, start, side="right") - 1
    # Neighbours among words alone, so punctuation doesn't part a repeated word.
    n = len(s1)
    same_row = row[1:n] == row[: n - 1] if n else np.zeros(0, dtype=bool)
    a, b = hashes[: max(n - 1, 0)][same_row], hashes[1:n][same_row]
    pair = np.where(a == b, _bucket(np.array([3], dtype=U64), 3)[0], _bucket(a * U64(0xD1342543DE82EF95) + b, 2))
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    word = np.empty(len(hashes), dtype=np.int64)
    word[order] = np.cumsum(new) - 1
    pick = order[new]
    # The distinct words' bytes in a row, each between two end marks.
    size = end[pick] - start[pick] + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], 31, dtype=np.uint8)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
    body = (inside > 0) & (inside < np.repeat(size, size) - 1)
    flat[body] = raw[(np.repeat(start[pick], size) + inside - 1)[body]]
    left = np.repeat(size, size) - inside
    owners, buckets = [np.arange(len(pick))], [_bucket(ordered[new], 1)]
    for n_gram in GRAMS:
        grams = gram_hashes(_VALUE[flat], n_gram)
        whole = left[: len(grams)] >= n_gram
        owners.append(np.repeat(np.arange(len(pick)), np.maximum(size - n_gram + 1, 0)))
        buckets.append(_bucket(grams[whole], 10 + n_gram))
    owner, feature = np.concatenate(owners), np.concatenate(buckets)
    by_word = np.argsort(owner, kind="stable")
    return Words(row, word, feature[by_word], np.searchsorted(owner[by_word], np.arange(len(pick) + 1)), row[:n][:-1][same_row] if n else row[:0], pair)


def scores_of(raw: np.ndarray, offsets: np.ndarray, logits: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(rows, classes) probabilities from each bucket's share in the logits."""
    n, w = len(offsets) - 1, words_of(raw, offsets)
    total, count = np.zeros((n, len(bias))), np.zeros(n)
    if len(w.word):
        share = np.add.reduceat(logits[w.feature], w.first[:-1], axis=0)[w.word]
        count += np.bincount(w.row, weights=np.diff(w.first)[w.word], minlength=n) + np.bincount(w.pair_row, minlength=n)
        pairs = logits[w.pair]
        for c in range(len(bias)):
            total[:, c] = np.bincount(w.row, weights=share[:, c], minlength=n) + np.bincount(w.pair_row, weights=pairs[:, c], minlength=n)
    z = total / np.maximum(count, 1)[:, None] + bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, ascending, and how often it has each."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    w = words_of(raw, np.array([0, len(raw)]))
    times = np.bincount(w.word, minlength=len(w.first) - 1)
    bucket = np.concatenate([w.feature, w.pair])
    weight = np.concatenate([np.repeat(times, np.diff(w.first)), np.ones(len(w.pair), times.dtype)])
    order = np.argsort(bucket)
    bucket, weight = bucket[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[new].astype(np.int32), np.add.reduceat(weight, new) if len(new) else weight


def shares_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, ascending, and their shares of all its features."""
    bucket, count = counts_of(text)
    return bucket, (count / max(count.sum(), 1)).astype(np.float32)


def _packed(x: np.ndarray) -> bytes:
    """Small whole numbers, byte plane by byte plane, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: pa.Scalar) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data.as_buffer()), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


@tidy
def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [counts_of(t.as_py()) for t in batch.column(0)]
        steps = [_packed(np.diff(b, prepend=0)) for b, _ in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(steps, pa.binary()), pa.array([_packed(n) for _, n in pairs], pa.binary()), batch.column(1)], ["step", "count", "label"])


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int = len(CLASSES), epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(buckets x classes) shares in the logits, and the classes' bias."""
    rng, y = np.random.RandomState(seed), np.asarray(labels)
    prior = (np.bincount(y, minlength=classes) + 1) / (len(y) + classes)
    vectors = rng.uniform(-0.02, 0.02, (BUCKETS, WIDTH)).astype(np.float32)
    output, bias = rng.uniform(-0.5, 0.5, (WIDTH, classes)).astype(np.float32), np.log(prior).astype(np.float32)
    # Rows of the table as single values, which numpy scatters faster.
    rows = vectors.view(np.dtype((np.void, WIDTH * vectors.itemsize))).ravel()
    norms = [np.float32(share @ share + 1e-9) for _, share in examples]
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        for i in rng.permutation(len(y)):
            bucket, share = examples[i]
            mine = vectors.take(bucket, axis=0)
            hidden = share @ mine
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = output @ p
            output -= rate * np.float32(0.1) * np.outer(hidden, p) / (1 + hidden @ hidden)
            bias -= rate * np.float32(0.01) * p
            mine -= np.outer(share * (rate / norms[i]), back)
            rows[bucket] = mine.view(rows.dtype).ravel()
    return (vectors @ output).astype(np.float32), bias


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, label) of at most `limit` labelled documents, in the order of training."""
    texts = docs.select(col("doc_id"), col("text").cast("string").alias("text")).where("text is not null")
    # Labels that no text belongs to must not use up the sample.
    usable = labels.select(F.col("doc_id").cast(id_type(docs, "doc_id")).alias("doc_id"), "quality", "toxic").where("doc_id is not null and (quality is not null or toxic is not null)").join(texts.select("doc_id"), "doc_id", "left_semi")
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    chosen = known.select("doc_id", F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).alias("label")).orderBy(order, "doc_id").limit(limit)
    # At most `limit` rows of two numbers, so broadcasting them is bounded.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").select("text", "label")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label, clean, keep) of every row; `clean` is the probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = held.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, SLICE):
                p = scores_of(raw, offsets[a : b + 1], logits, bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.array(CLASSES)[p.argmax(axis=1)]), pa.array(p[:, 0]), pa.array(p.argmax(axis=1) == 0)], ["doc_id", "label", "clean", "keep"])

    return docs.select(col(id_column).alias("doc_id"), col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type(docs, id_column)}, label string, clean double, keep boolean")


def accepted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows that the model takes for clean, columns unchanged, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits, bias = held.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            keep = [scores_of(raw, offsets[a : b + 1], logits, bias).argmax(axis=1) == 0 for a, b in slices(offsets, SLICE)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    at = docs.columns.index("text")
    # By place, as names may hold dots.
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    rows = training_rows(docs, labels, limit).mapInArrow(_count_batches, "step binary, count binary, label int").toArrow()
    if not rows.num_rows:
        return np.zeros((BUCKETS, len(CLASSES)), np.float32), np.array([1.0, 0.0, 0.0], np.float32)
    examples = []
    for step, count in zip(rows["step"], rows["count"]):
        count = _unpacked(count)
        examples.append((np.cumsum(_unpacked(step), dtype=np.int32), (count / max(count.sum(), 1)).astype(np.float32)))
    return train(examples, rows["label"].to_pylist())
