"""Benchmark decontamination over a distributed positional inverted index.

`build_index` turns the training documents into index segments, one row each:
the sorted distinct terms of a few megabytes of text, and for every term the
ascending positions at which it occurs.  The index holds every token of every
document and is written once; any number of benchmarks can be searched in it.

`search` intersects, per segment and benchmark item, the posting lists of the
item's terms, each list shifted back by the term's offset in the item, so that
equal numbers mean one place of the whole item.  It begins with the rarest
terms: an item that may miss m of its terms must show one of its m + 1 rarest.

* exact: all terms of the item follow one another in a document;
* proximity: for some place c at least `share` of the terms lie within `slop`
  words of where they belong if the item began at c.

Items are compared by hashed terms (40 bits each).  Items of fewer than
`MIN_TERMS` terms match only exactly, as a share of so few says little.

Defined results: items and documents without words never match; every place of
an item in a document is reported that doesn't overlap a better one; of repeated
rows or items each place is reported once per distinct text; null ids are
reported as null and ids keep their type; a very long text is one row of an index
segment of its own size; an empty corpus or benchmark has no match; other
columns, whatever their names, pass through.  Ties: of places that overlap exact
ones come first, then those with more terms, then earlier ones.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import col, content_key, fresh, id_type, settled, written
from vellum.llm.textkit import U64, tidy, token_slices

#: Least share of an item's terms for a proximity match, and words of slack.
SHARE, SLOP = 0.8, 2
MIN_TERMS = 5
SEGMENT_BYTES = 2 << 20
#: Benchmark items are sent to executors in groups of about this many characters.
GROUP_CHARS = 16 << 20


def _pack(x: np.ndarray) -> bytes:
    """Differences of unsigned numbers, byte plane by byte plane (compresses well)."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(len(d), x.itemsize).T).tobytes()


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@tidy
def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, t in token_slices(batch.column(2), SEGMENT_BYTES):
            if not len(t.hash):
                continue
            term = t.hash >> U64(24)
            order = np.argsort(term, kind="stable")
            ordered = term[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            counts = np.diff(np.append(new, len(ordered))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    _one_list(batch.column(0).slice(a, b - a)),
                    _one_list(batch.column(1).slice(a, b - a)),
                    pa.array([_pack(t.first.astype(np.uint32))]),
                    pa.array([_pack(ordered[new])]),
                    pa.array([_pack(counts)]),
                    pa.array([_pack(order.astype(np.uint32))]),
                ],
                ["ids", "keys", "first", "terms", "counts", "postings"],
            )


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The positional index of a document table, written to the shared folder."""
    source = docs.select(col(id_column).alias("id"), content_key(docs, id_column, text_column).alias("key"), col(text_column).cast("string").alias("text"))
    schema = f"ids array<{id_type(docs, id_column)}>, keys array<binary>, first binary, terms binary, counts binary, postings binary"
    return written(source.mapInArrow(_segment_batches, schema))


class Items:
    """Benchmark items as flat arrays of terms."""

    def __init__(self, ids: pa.Array, texts: list[str]) -> None:
        parts = [(a, t) for a, _, t in token_slices(pa.array(texts, pa.string()))]
        self.ids = ids
        self.term = np.concatenate([t.hash for _, t in parts]) >> U64(24) if parts else np.zeros(0, U64)
        row = np.concatenate([t.row + a for a, t in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.searchsorted(row, np.arange(len(ids) + 1))
        self.size = np.diff(self.first)
        allowed = np.floor(self.size * (1 - SHARE) + 1e-9).astype(np.int64)
        self.miss = np.where(self.size < MIN_TERMS, 0, allowed)
        self.vocabulary, self.number = np.unique(self.term, return_inverse=True)


def _apart(place: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which of each row's places, best first, overlap none taken before."""
    if n == 1:
        return np.ones(len(place), dtype=bool)
    out = np.zeros(len(place), dtype=bool)
    taken: list[int] = []
    for i, (p, r) in enumerate(zip(place.tolist(), row.tolist())):
        if i and r != row[i - 1]:
            taken = []
        j = bisect.bisect(taken, p)
        if (j == 0 or p - taken[j - 1] >= n) and (j == len(taken) or taken[j] - p >= n):
            taken.insert(j, p)
            out[i] = True
    return out


def match_segment(items: Items, first: np.ndarray, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, slop: int = SLOP) -> list[tuple[int, int, bool, int, int]]:
    """(item, row, exact, position, matched terms) of each pair's places that don't overlap."""
    if not len(items.vocabulary) or not len(terms):
        return []
    at = np.minimum(np.searchsorted(terms, items.vocabulary), len(terms) - 1)
    found = terms[at] == items.vocabulary
    stop = np.cumsum(counts, dtype=np.int64)
    lo, hi = np.where(found, stop[at] - counts[at], 0), np.where(found, stop[at], 0)
    length = (hi - lo)[items.number]
    present = np.concatenate([[0], np.cumsum(length > 0)])
    lacking = items.size - (present[items.first[1:]] - present[items.first[:-1]])
    out = []
    for k in np.flatnonzero((items.size > 0) & (lacking <= items.miss)):
        s, n, miss = items.first[k], items.size[k], items.miss[k]
        number = items.number[s : s + n]
        lists = {v: postings[lo[v] : hi[v]].astype(np.int64) for v in set(number.tolist())}
        rare = np.argsort(length[s : s + n], kind="stable")
        place = np.unique(np.concatenate([lists[number[i]] - i for i in rare[: miss + 1]]))
        slack = slop if miss else 0
        if slack:
            place = np.unique((place[:, None] + np.arange(-slack, slack + 1)).ravel())
        # A place belongs to the row that holds its middle, and ends with the row.
        row = np.searchsorted(first, np.clip(place + n // 2, 0, first[-1] - 1), side="right") - 1
        near, exactly = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for done, i in enumerate(rare):
            if not len(place):
                break
            p, want = lists[number[i]], place + i
            low, high = np.maximum(want - slack, first[row]), np.minimum(want + slack, first[row + 1] - 1)
            j = np.searchsorted(p, low)
            near += (j < len(p)) & (p[np.minimum(j, len(p) - 1)] <= high) if len(p) else 0
            j = np.searchsorted(p, want)
            exactly += (j < len(p)) & (p[np.minimum(j, len(p) - 1)] == want) & (want >= first[row]) & (want < first[row + 1]) if len(p) else 0
            go_on = near + (n - done - 1) >= n - miss
            if not go_on.all():
                place, row, near, exactly = place[go_on], row[go_on], near[go_on], exactly[go_on]
        whole = exactly == n
        order = np.lexsort((place, -near, ~whole, row))
        heads = order[_apart(place[order], row[order], n)]
        out += [(int(k), int(row[h]), bool(whole[h]), int(max(place[h] - first[row[h]], 0)), int(near[h])) for h in heads]
    return out


def _search_group(index: DataFrame, ids: pa.Array, texts: list[str], item_type: str) -> DataFrame:
    held, doc_type = index.sparkSession.sparkContext.broadcast((ids, texts)), index.schema["ids"].dataType.elementType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                first, terms, counts, postings = (_unpack(batch.column(c)[i].as_py(), d) for c, d in ((2, np.uint32), (3, U64), (4, np.uint32), (5, np.uint32)))
                rows = match_segment(items, first.astype(np.int64), terms, counts.astype(np.int64), postings)
                if rows:
                    item, row, exact, position, matched = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            items.ids.take(pa.array(item)),
                            batch.column(0)[i].values.take(pa.array(row)),
                            batch.column(1)[i].values.take(pa.array(row)),
                            pa.array(["exact" if e else "proximity" for e in exact]),
                            pa.array(position, pa.int64()),
                            pa.array(matched, pa.int64()),
                            pa.array(items.size[list(item)], pa.int64()),
                        ],
                        ["item_id", "doc_id", "key", "kind", "position", "matched", "terms"],
                    )

    return index.mapInArrow(run, f"item_id {item_type}, doc_id {doc_type}, key binary, kind string, position bigint, matched bigint, terms bigint")


def search(index: DataFrame, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Matches of all benchmark items in an index.

    The items go to the executors in groups of at most about GROUP_CHARS, one
    pass over the index each, so what is sent at once doesn't grow.
    """
    items = benchmark.select(col(id_column).alias("id"), F.coalesce(col(text_column).cast("string"), F.lit("")).alias("text")).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // GROUP_CHARS))
    out = None
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(groups)) == g).orderBy("id", "text").toArrow()
        part = _search_group(index, rows["id"].combine_chunks(), rows["text"].to_pylist(), id_type(benchmark, id_column))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, doc_id, kind, position, matched, terms, key) of every match."""
    return settled(docs.sparkSession, lambda: search(build_index(docs), benchmark))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The table without rows that hold a benchmark item, columns unchanged."""
    key = fresh(docs, "row_key")
    hits = settled(docs.sparkSession, lambda: search(build_index(docs, id_column, text_column), benchmark).select(F.col("key").alias(key)).distinct())
    # Left to the planner: hits are broadcast only while they are known to be small.
    return docs.withColumn(key, content_key(docs, id_column, text_column)).join(hits, key, "left_anti").drop(key)
