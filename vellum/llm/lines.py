"""Removal of lines that are spread over many sites.

How many distinct sites a line occurs on is estimated by a HyperLogLog sketch
per line hash; sketches of parts merge by aggregation, so a line on millions of
pages costs no more than its sketch.  Lines whose estimate lies within the
sketch's error of the threshold are counted exactly, and lines at or above the
threshold are taken out of every document.

A line is compared lower-cased and without outer spaces; lines shorter than
`MIN_CHARS` are never removed, as short lines recur by chance.

Lines to be removed meet the documents' lines in an equi-join of 64-bit hashes,
and documents get their list of places in another.  Whether either is done by
broadcast is left to the planner, which knows the sizes when it decides.

Defined results: null text stays null and empty text empty; a null site counts
as no site; a document of nothing but boilerplate becomes empty text; every row
stays, repeated rows each on their own; very long texts are treated line by line
in linear time; an empty table stays empty; other columns, whatever their names,
pass through.  Ties: a line on exactly `sites` sites is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import col, fresh, key_of, settled, written

#: Sites from which on a line is boilerplate, and the shortest line removed.
SITES, MIN_CHARS = 10, 12
#: 2**12 registers: a standard error of 1.6 percent; the band is four of them.
SKETCH_BITS, BAND = 12, 0.065


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(line)))


def boilerplate(docs: DataFrame, sites: int = SITES, site_column: str = "source", text_column: str = "text") -> DataFrame:
    """(line, sites): hash and number of sites of every line to be removed.

    `sites` is exact near the threshold and the sketch's estimate above it.
    """
    return settled(docs.sparkSession, lambda: _spread(docs, sites, site_column, text_column))


def _spread(docs: DataFrame, sites: int, site_column: str, text_column: str) -> DataFrame:
    line = F.explode(line_array(col(text_column).cast("string")))
    lines = docs.where(col(site_column).isNotNull()).select(col(site_column).cast("string").alias("site"), line.alias("text"))
    lines = lines.where(F.length(F.trim("text")) >= MIN_CHARS).select(line_key(F.col("text")).alias("line"), F.xxhash64("site").alias("site"))
    # A line on a single site, as most are, needs no sketch: its least and
    # greatest site are equal, and those aggregate in plain hash tables.
    often = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line")
    shared = written(lines.join(often, "line", "left_semi"))
    spread = written(shared.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("estimate")).where(F.col("estimate") >= sites * (1 - BAND) - 1))
    close = F.col("estimate") < sites * (1 + BAND) + 1
    exact = shared.join(spread.where(close), "line").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= sites)
    return spread.where(~close).select("line", F.col("estimate").alias("sites")).unionByName(exact)


def without_boilerplate(docs: DataFrame, sites: int = SITES, site_column: str = "source", text_column: str = "text", removed_column: str | None = None) -> DataFrame:
    """The table with lines on `sites` sites or more taken out of its texts.

    `removed_column` names a column to be added, with the number of lines taken.
    """
    gone = boilerplate(docs, sites, site_column, text_column).select("line")
    key, at, lines = fresh(docs, "text_key"), fresh(docs, "removed_at"), fresh(docs, "text_lines")
    # What goes from a text depends on the text alone, so its key stands for it.
    keyed = docs.withColumn(key, key_of([text_column])).withColumn(lines, line_array(col(text_column).cast("string")))
    each = keyed.select(col(key).alias("key"), F.posexplode(col(lines)).alias("at", "text")).where(F.length(F.trim("text")) >= MIN_CHARS)
    places = each.select("key", "at", line_key(F.col("text")).alias("line")).join(gone, "line", "left_semi")
    removed = places.groupBy("key").agg(F.collect_set("at").alias(at)).withColumnRenamed("key", key)
    # The text goes on as its lines, so that they are cut once and not for each place.
    joined = keyed.drop(text_column).join(removed, key, "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size(col(lines)) - 1), col(at))
    kept = F.when(col(at).isNull(), col(lines)).otherwise(F.transform(stays, lambda i: F.get(col(lines), i)))
    out = joined.withColumn(text_column, F.array_join(kept, "\n", ""))
    if removed_column:
        out = out.withColumn(removed_column, F.coalesce(F.size(col(at)), F.lit(0)).cast("bigint"))
    return out.select(*[col(c) for c in docs.columns], *([col(removed_column)] if removed_column else []))


LINE_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
spread AS (
  SELECT lower(trim(line)) AS k FROM lines WHERE length(trim(line)) >= {MIN_CHARS} GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}),
flagged AS (SELECT l.*, k IS NOT NULL AS gone FROM lines l LEFT JOIN spread ON lower(trim(line)) = k AND length(trim(line)) >= {MIN_CHARS})
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed
FROM flagged GROUP BY doc_id
"""
