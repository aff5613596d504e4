"""Repetition rules: how much of a document lies inside what it repeats.

For several n, every n-gram of a document's words is hashed by a rolling hash;
all words of n-grams that occur twice or more are marked, and the characters
of marked words are counted, each once.  Lines, without outer white space, are
treated alike.  A document is kept while every share stays within its limit.

Work is done in numpy on slices of Arrow buffers, in one pass without shuffle.

Defined results: null or empty text has no characters and is kept; documents of
fewer than n words have no n-grams; repeated rows are each measured alone; very
long texts are measured whole; ids keep their type and may be null; an empty table
gives no rows; only id and text are read, whatever other columns are called.
Ties: a share equal to its limit is within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vellum.llm.shared import col, id_type
from vellum.llm.textkit import _WORD, U64, gram_hashes, mix64, slices, span_hashes, spans_of, text_buffers

#: Largest share of characters in repeated n-grams, by n, and in repeated lines.
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
_SCHEMA = "chars bigint, " + "".join(f"repeated_{n} bigint, " for n in LIMITS) + "line_chars bigint, repeated_lines bigint, keep boolean"
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 11, 12, 13, 32]] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def measure(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Characters of words, in repeated n-grams, of lines, in repeated lines."""
    base, n_rows = offsets[0], len(offsets) - 1
    raw, bounds = raw[base : offsets[-1]], offsets - base
    letter = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])

    start, end = spans_of(_WORD[raw], bounds)
    row = np.searchsorted(bounds, start, side="right") - 1
    size, hashes = letter[end] - letter[start], span_hashes(raw, start, end)
    own = mix64(row.astype(U64) + U64(1))
    chars = np.bincount(row, weights=size, minlength=n_rows).astype(np.int64)
    repeated = {}
    for n in LIMITS:
        grams = gram_hashes(hashes, n)
        inside = row[: len(grams)] == row[n - 1 :] if len(grams) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        at = at[_repeated(grams[at] ^ own[at])]
        marks = np.bincount(at, minlength=len(row) + 1) - np.bincount(at + n, minlength=len(row) + 1)[: len(row) + 1]
        marked = np.cumsum(marks)[: len(row)] > 0
        repeated[n] = np.bincount(row[marked], weights=size[marked], minlength=n_rows).astype(np.int64)

    start, end = spans_of(raw != 10, bounds)
    ink = np.flatnonzero(~_BLANK[raw] & (raw != 10))
    first, last = np.searchsorted(ink, start), np.searchsorted(ink, end) - 1
    full = first <= last
    start, end = ink[first[full]], ink[last[full]] + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    size = letter[end] - letter[start]
    twice = _repeated(span_hashes(raw, start, end) ^ mix64(row.astype(U64) + U64(1)))
    lines = np.bincount(row, weights=size, minlength=n_rows).astype(np.int64)
    return chars, repeated, lines, np.bincount(row[twice], weights=size[twice], minlength=n_rows).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffers(pc.utf8_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), "")))
        for a, b in slices(offsets):
            chars, repeated, lines, again = measure(raw, offsets[a : b + 1])
            keep = again <= LINE_LIMIT * lines
            for n, limit in LIMITS.items():
                keep &= repeated[n] <= limit * chars
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, (chars, *repeated.values(), lines, again, keep))], ["doc_id", "chars", *(f"repeated_{n}" for n in LIMITS), "line_chars", "repeated_lines", "keep"])


def repetition(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures and verdict for every row."""
    return docs.select(col(id_column).alias("doc_id"), col(text_column).cast("string").alias("text")).mapInArrow(_batches, f"doc_id {id_type(docs, id_column)}, {_SCHEMA}")


def _sql() -> str:
    word = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"
    parts, joins, limits = [], "", []
    for n, limit in LIMITS.items():
        gram = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, n))])
        parts.append(f"""
g{n} AS (SELECT doc_id, pos, w, {gram} AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
d{n} AS (SELECT doc_id, pos, w, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g{n}),
m{n} AS (SELECT doc_id, w, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS marked FROM d{n}),
r{n} AS (SELECT doc_id, sum(length(w))::BIGINT AS c FROM m{n} WHERE marked GROUP BY doc_id)""")
        joins += f" LEFT JOIN r{n} USING (doc_id)"
        limits.append(f"coalesce(r{n}.c, 0) <= {limit}::DOUBLE * coalesce(t.chars, 0)")
    return f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{word}') AS w FROM documents)),
t AS (SELECT doc_id, sum(length(w))::BIGINT AS chars FROM words GROUP BY doc_id),
{",".join(parts)},
lines AS (SELECT doc_id, line, count(*) OVER (PARTITION BY doc_id, line) AS n FROM (
  SELECT doc_id, regexp_replace(unnest(string_split(lower(text), chr(10))), '^[\\t\\v\\f\\r ]+|[\\t\\v\\f\\r ]+$', '', 'g') AS line FROM documents) WHERE line <> ''),
l AS (SELECT doc_id, sum(length(line))::BIGINT AS chars, coalesce(sum(length(line)) FILTER (WHERE n > 1), 0)::BIGINT AS again FROM lines GROUP BY doc_id)
SELECT doc_id, coalesce(t.chars, 0) AS chars, {", ".join(f"coalesce(r{n}.c, 0) AS repeated_{n}" for n in LIMITS)},
  coalesce(l.chars, 0) AS line_chars, coalesce(l.again, 0) AS repeated_lines,
  coalesce(l.again, 0) <= {LINE_LIMIT}::DOUBLE * coalesce(l.chars, 0) AND {" AND ".join(limits)} AS keep
FROM documents LEFT JOIN t USING (doc_id){joins} LEFT JOIN l USING (doc_id)
"""


REPETITION_SQL = _sql()
