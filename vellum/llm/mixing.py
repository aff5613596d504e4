"""Mixing sources to target weights by capped water-filling.

Each source has a size (characters of all its documents) and a target weight,
and the mix has a budget in characters.  A level is raised until the budget is
used: a source gets level * weight characters, but never more than `max_epochs`
passes over what it has.  What a clamped source can't take is shared among the
others in proportion to their weights, round by round, until no further source
is clamped.  Where the budget exceeds every cap, all sources end at their caps.

A source's share divided by its size is its number of passes.  Every document
is repeated the whole number of times, and once more where a number drawn from
the seed and its id falls below the fraction.

The level is found by aggregates over the table of sources, of which only one
row per round reaches the driver, so there may be millions of sources.

Defined results: null is a source like others; sources without characters or
weight, and null weights, give nothing; negative weights raise ValueError;
rows that repeat an id share its draw; a null id draws like the text 'null';
very long texts count with all their characters; an empty table has no sources;
other columns, whatever their names, pass through.  Ties: a draw equal to the
fraction gives no further repetition, and a source that reaches its cap exactly
is not clamped, which makes no difference to the shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import col, fresh, settled, written

#: Most passes over a source, and the mix's size in passes over the corpus.
MAX_EPOCHS, CORPUS_EPOCHS = 4, 1
SEED = 20240


def source_sizes(docs: DataFrame, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(source, size, weight): by default the weight is 1000 times the root of the size.

    Square roots favour small sources without levelling them; whole numbers
    make every sum exact, whatever its order.
    """
    size = F.coalesce(F.sum(F.length(col(text_column)).cast("bigint")), F.lit(0))
    return docs.groupBy(col(source_column).cast("string").alias("source")).agg(size.alias("size")).withColumn("weight", F.floor(1000 * F.sqrt("size")))


def with_weights(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """Replace the weights by those of a table (source, weight); absent is 0."""
    if not weights.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    w = weights.groupBy(F.col("source").alias("s")).agg(F.sum("weight").alias("w"))
    return sizes.join(w, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.coalesce("w", F.lit(0)).alias("weight"))


def epochs(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, budget: int | None = None) -> DataFrame:
    """(source, size, weight, epochs) by capped water-filling."""
    return settled(sizes.sparkSession, lambda: _filled(sizes, max_epochs, budget))


def _filled(sizes: DataFrame, max_epochs: int, budget: int | None) -> DataFrame:
    s = written(sizes.select("source", "size", "weight", (F.col("size") * max_epochs).alias("cap")))
    live = s.where("size > 0 and weight > 0")
    if budget is None:
        budget = CORPUS_EPOCHS * (s.agg(F.sum("size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = live.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["n"] == clamped:
            break
        clamped = row["n"]
        if not row["open"]:
            level = float("inf")
            break
        level = max(float(budget - row["taken"]), 0.0) / float(row["open"])
    give = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    return s.select("source", "size", "weight", F.when((F.col("size") > 0) & (F.col("weight") > 0), give / F.col("size")).otherwise(F.lit(0.0)).alias("epochs"))


def draw(id_column, seed: int = SEED):
    """A number in [0, 1) from the seed and a row's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, shares: DataFrame, seed: int = SEED, copy_column: str | None = None, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """Documents repeated by their source's passes; columns unchanged.

    `copy_column` names a column to be added, with the number of the repetition.
    """
    name, passes, copy = fresh(docs, "mix_source"), fresh(docs, "mix_passes"), copy_column or fresh(docs, "mix_copy")
    of = shares.select(F.col("source").alias(name), F.col("epochs").alias(passes)).where(F.col(passes) > 0)
    joined = docs.join(of, col(source_column).cast("string").eqNullSafe(F.col(name)))
    times = F.floor(passes) + F.when(draw(col(id_column), seed) < F.col(passes) - F.floor(passes), 1).otherwise(0)
    copies = F.when(times > 0, F.sequence(F.lit(1).cast("bigint"), times.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    out = joined.withColumn(copy, F.explode(copies))
    return out.drop(name, passes) if copy_column else out.drop(name, passes, copy)


_PASSES = f"""
sizes AS (SELECT source, sum(length(text))::BIGINT AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, CAST(floor(1000 * sqrt(size)) AS BIGINT) AS weight, size * {MAX_EPOCHS} AS cap FROM sizes),
ranked AS (
  SELECT *, row_number() OVER o AS k,
    coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM weighted WHERE size > 0 WINDOW o AS (ORDER BY cap::DOUBLE / weight, source)),
levels AS (
  SELECT k, ((SELECT {CORPUS_EPOCHS} * sum(size) FROM sizes) - taken)::DOUBLE / open::DOUBLE AS level, weight, cap FROM ranked),
chosen AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY k LIMIT 1),
passes AS (
  SELECT source, least(weight * coalesce((SELECT level FROM chosen), 'inf'::DOUBLE), cap::DOUBLE) / size AS epochs FROM ranked),
repeats AS (
  SELECT doc_id, d.source,
    CAST(floor(epochs) AS BIGINT) + CASE WHEN ('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < epochs - floor(epochs) THEN 1 ELSE 0 END AS times
  FROM documents d JOIN passes p ON d.source = p.source)
"""
MIX_SQL = f"WITH {_PASSES} SELECT doc_id, source, unnest(range(1, times + 1)) AS copy FROM repeats"
