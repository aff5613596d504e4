"""Reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows are numbered 0..N-1 in the order of their id (null first), whatever files
or partitions they come from.  A keyed Feistel network permutes those numbers:
a number is split into a pair (left, right) of a grid of a x b >= N cells, and
rounds add a keyed function of one half to the other, modulo its size.  Where
the result lies outside 0..N-1 the permutation is applied again (cycle walking)
until it falls inside, so the whole is a permutation of 0..N-1.

Place p of the shuffled order lies in shard p mod S at slot p div S.  Shard and
slot of any row number, and the row number at any slot, are computed without
looking at data.

Only ids and 128-bit keys are sorted to number the rows.  Rows that repeat are
counted before anything is shuffled, and take successive numbers, so a row that
makes up a third of the table is one line of the sort.

Defined results: an empty table stays empty; N is at most 2**60; ids keep their
type and null ids are numbered first.  Ties: rows that repeat an id are numbered
by a key of all their columns, so only rows equal in every column, which are
interchangeable, are told apart by nothing.  Very long texts move as they are;
columns whose names clash with those added keep theirs, the added ones get an
underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import col, fresh, id_type, key_of, written

SHARDS, SEED, ROUNDS = 64, 7, 6
#: Rows that one task writes of a shard; larger shards have several writers.
TASK_ROWS = 100_000
_PRIME = (1 << 31) - 1


def round_keys(seed: int = SEED) -> list[tuple[int, int]]:
    """Two keys below the prime for each round."""
    digests = (hashlib.sha256(f"{seed}/{r}".encode()).digest() for r in range(ROUNDS))
    return [(int.from_bytes(d[:8], "big") % _PRIME, int.from_bytes(d[8:16], "big") % _PRIME) for d in digests]


def grid(n: int) -> tuple[int, int]:
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-n // a)


def _round(v: np.ndarray, k: tuple[int, int]) -> np.ndarray:
    t = (v + k[0]) % _PRIME
    t = (t * t + k[1]) % _PRIME
    return t * t % _PRIME


def _network(x: np.ndarray, n: int, keys: list[tuple[int, int]], back: bool) -> np.ndarray:
    a, b = grid(n)
    left, right = x // b, x % b
    sign = -1 if back else 1
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2 == 0:
            left = (left + sign * _round(right, keys[r])) % a
        else:
            right = (right + sign * _round(left, keys[r])) % b
    return left * b + right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Place of each row number in the shuffled order, or the reverse."""
    if n > 1 << 60:
        raise ValueError("too many rows")
    keys, out = round_keys(seed), np.asarray(x, dtype=np.int64)
    out = _network(out, n, keys, back)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = _network(out[outside], n, keys, back)
    return out


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition and the number of rows before each line in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(batch.num_columns - 1).to_numpy()
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        added = [pa.array(start, pa.int64()), pa.array(np.full(len(n), part, dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "start", "part"])


def numbered(keys: DataFrame) -> tuple[DataFrame, int]:
    """(id, key, first, n) of each distinct (id, key): its first row number and how
    many rows it has; and the number of all rows.

    One range shuffle of distinct lines; the row counts of its partitions, as few as
    there are partitions, turn places within partitions into places overall.
    """
    order = [F.col(c).asc_nulls_first() for c in ("id", "key")]
    ranged = keys.groupBy("id", "key").agg(F.count("*").alias("n")).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = written(ranged.mapInArrow(_running, f"id {id_type(keys, 'id')}, key binary, n bigint, start bigint, part bigint"))
    total, rows = 0, []
    for r in lines.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        rows.append((r["part"], total))
        total += r["n"]
    offsets = keys.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["part", "offset"]).astype("int64"), "part bigint, offset bigint")
    # One line per partition of the shuffle, so its size is bounded.
    return lines.join(F.broadcast(offsets), "part").select("id", "key", (F.col("start") + F.col("offset")).alias("first"), "n"), total


def _each_number() -> Column:
    return F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))


def _place(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("bigint")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return place(number)


def assignments(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, row_number, place, shard, slot) of every row; only ids move."""
    rows, n = numbered(docs.select(col(id_column).alias("id"), F.lit(b"").alias("key")))
    placed = rows.select(F.col("id").alias("doc_id"), _each_number().alias("row_number")).withColumn("place", _place(F.col("row_number"), n, seed))
    return placed.withColumn("shard", F.col("place") % shards).withColumn("slot", F.expr(f"place div {shards}"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_column: str = "doc_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """The whole rows with shard and slot, laid out by shard in slot order.

    Ids and keys are numbered on their own; the rows then move twice, to meet
    their numbers and to reach their shards.  Rows equal in every column move as
    one until they are numbered.  Each shard is written by as many tasks, one
    after the other in slot order, as its size asks for.
    """
    shard, slot, names = fresh(docs, "shard"), fresh(docs, "slot"), [f"c{i}" for i in range(len(docs.columns))]
    # By place, as names may clash or hold dots.
    plain = docs.toDF(*names).withColumn("key", key_of(names)).withColumn("id", F.col(names[docs.columns.index(id_column)]))
    rows, n = numbered(plain.select("id", "key"))
    whole = plain.groupBy("key").agg(F.first(F.struct(*names)).alias("row"))
    # Places are found before the rows are there, so that no text waits for Python.
    numbers = rows.select("key", _each_number().alias("number")).select("key", _place(F.col("number"), n, seed).alias("place"))
    met = whole.join(numbers, "key").select("row.*", "place")
    place = met.withColumn("shard", F.col("place") % shards).withColumn("slot", F.expr(f"place div {shards}"))
    slots = max(-(-n // shards), 1)
    # At least as many tasks as other shuffles have.
    writers = max(-(-slots // task_rows), -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    writer = (F.col("shard") * writers + F.floor(F.col("slot") * writers / slots)).cast("int")
    laid = place.repartitionById(shards * writers, writer).sortWithinPartitions("shard", "slot")
    return laid.select(*names, "shard", "slot").toDF(*docs.columns, shard, slot)


def _sql() -> str:
    def step(v: str, k: tuple[int, int]) -> str:
        t = f"(({v} + {k[0]}) % {_PRIME})"
        t = f"(({t} * {t} + {k[1]}) % {_PRIME})"
        return f"({t} * {t} % {_PRIME})"

    keys = round_keys()
    body = "SELECT doc_id, row_number, walks, x // b AS l, x % b AS r, a, b, n FROM walk_in"
    for i, k in enumerate(keys):
        if i % 2 == 0:
            body = f"SELECT doc_id, row_number, walks, (l + {step('r', k)}) % a AS l, r, a, b, n FROM ({body})"
        else:
            body = f"SELECT doc_id, row_number, walks, l, (r + {step('l', k)}) % b AS r, a, b, n FROM ({body})"
    return f"""
WITH RECURSIVE size AS (SELECT count(*)::BIGINT AS n FROM documents),
grid AS (SELECT n, ceil(sqrt(n))::BIGINT AS a, (n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT AS b FROM size),
numbers AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number FROM documents),
walk AS (
  SELECT doc_id, row_number, 0 AS walks, row_number AS x, a, b, n FROM numbers, grid
  UNION ALL
  SELECT doc_id, row_number, walks + 1, l * b + r, a, b, n
  FROM ({body.replace('walk_in', '(SELECT * FROM walk WHERE walks = 0 OR x >= n)')}))
SELECT doc_id, row_number, x AS place, x % {SHARDS} AS shard, x // {SHARDS} AS slot FROM walk WHERE walks > 0 AND x < n
"""


SHARD_SQL = _sql()
