"""Roll-ups: one synthesized text per folder and per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.models import Summarizer, extractive
from vellum.operators.search import FOLDER, SECTION


def folder_members(items: DataFrame) -> DataFrame:
    """(key, child, is_direct, ...): every item under its folder and all above.

    `items` has doc_id, uri, title, folder, summary and seq; `child` is the
    folder below `key` on the way to the item.
    """
    chain = F.concat(F.array("folder"), T.ancestors("folder"))
    steps = F.transform(chain, lambda f, i: F.struct(f.alias("key"), F.when(i > 0, F.element_at(chain, F.greatest(i, F.lit(1)))).alias("child"), (i == 0).alias("is_direct")))
    return items.select("*", F.explode(steps).alias("step")).select("*", "step.*").drop("step")


def folder_counts(items: DataFrame) -> DataFrame:
    """(key, n_total, n_direct, n_subfolders) of every folder; combines before the shuffle."""
    return folder_members(items).groupBy("key").agg(F.count("*").alias("n_total"), F.count(F.when(F.col("is_direct"), 1)).alias("n_direct"), F.count_distinct("child").alias("n_subfolders"))


def _lines(rows: Column, chars: int) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["name"], F.lit(": "), F.substring(r["summary"], 1, chars))), "\n")


def _listed(members: DataFrame, key: str, most: int) -> DataFrame:
    """The first members of each group in catalogue order, as one array."""
    name = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("uri"), F.lit(""))
    order = Window.partitionBy(key).orderBy("seq", "doc_id")
    first = members.select(key, "seq", "doc_id", name.alias("name"), F.coalesce("summary", F.lit("")).alias("summary")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "name", "summary"))).alias("rows"))


def _summary(summarize: Summarizer | bool, title: Column) -> Column:
    return (extractive() if summarize is True else summarize)(title, F.col("base"))


def folder_rollups(items: DataFrame, min_items: int = 1, max_children: int = 30, summarize: Summarizer | bool = True) -> DataFrame:
    """(rollup_id, kind, key, text, doc_type) of every folder with enough items.

    The text is summarized, by `summarize` where that is a summarizer, or kept as it is.
    """
    members = folder_members(items)
    counts = folder_counts(items).where(F.col("n_total") >= min_items)
    below = members.where("child is not null").select("key", "child").distinct()
    nth = Window.partitionBy("key").orderBy("child")
    subs = below.withColumn("n", F.row_number().over(nth)).where("n <= 12").groupBy("key").agg(F.sort_array(F.collect_list("child")).alias("subs"))
    full = counts.join(_listed(members, "key", max_children), "key").join(subs, "key", "left")
    own = lambda s: F.coalesce(F.when(T.base_name(s) != "", T.base_name(s)), s)
    n = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("Folder: "), "key", F.lit("\nHolds "), n("n_total"), F.lit(" document(s) in total ("), n("n_direct"), F.lit(" directly, across "), n("n_subfolders"), F.lit(" sub-folder(s)).\n"),
        F.when(F.col("subs").isNotNull(), F.concat(F.lit("Sub-folders: "), F.array_join(F.transform("subs", own), ", "), F.lit("\n"))).otherwise(""),
        F.lit("Key documents: "), F.array_join(F.transform(F.slice("rows", 1, 8), lambda r: r["name"]), ", "), F.lit("\n\nContents:\n"), _lines(F.col("rows"), 240),
    )
    head = F.concat(F.lit("Folder: "), "key", F.lit(" ("), n("n_total"), F.lit(" documents, "), n("n_subfolders"), F.lit(" sub-folders)\n"))
    out = full.select("key", "n_total", "n_subfolders", text.alias("base"))
    final = F.concat(head, _summary(summarize, F.col("key"))) if summarize else F.col("base")
    return out.select(F.concat(F.lit("folder_"), T.stable_key("key")).alias("rollup_id"), F.lit("folder").alias("kind"), "key", final.alias("text"), F.lit(FOLDER).alias("doc_type"))


def section_rollups(sections: DataFrame, membership: DataFrame, items: DataFrame, max_children: int = 50, summarize: Summarizer | bool = True) -> DataFrame:
    """The same for sections (section_id, name) that have members among the items."""
    members = membership.select("section_id", "doc_id").distinct().join(items, "doc_id")
    counts = members.groupBy("section_id").agg(F.count("*").alias("n"))
    full = sections.select("section_id", "name").join(counts, "section_id").join(_listed(members, "section_id", max_children), "section_id")
    n = F.col("n").cast("string")
    base = full.select("section_id", "name", "n", F.concat(F.lit("Section: "), "name", F.lit("\n"), n, F.lit(" document(s).\n\nContents:\n"), _lines(F.col("rows"), 300)).alias("base"))
    final = F.concat(F.lit("Section: "), "name", F.lit(" ("), n, F.lit(" documents)\n"), _summary(summarize, F.col("name"))) if summarize else F.col("base")
    return base.select(F.concat(F.lit("section_"), "section_id").alias("rollup_id"), F.lit("section").alias("kind"), F.col("section_id").alias("key"), final.alias("text"), F.lit(SECTION).alias("doc_type"))
