"""Section structure of block streams, by window functions.

``blocks``: doc_id, ord, type, text and level (of headings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped_level, strip

LEVELS = 6


def _by_document():
    return Window.partitionBy("doc_id").orderBy("ord")


def section_paths(blocks: DataFrame) -> DataFrame:
    """Adds ``section`` (0 before any heading), ``heading`` and ``path`` (titles above it).

    For each level the latest heading is carried forward; it belongs to a path
    if it came after the latest heading of every level above it and stands
    above the section's own heading.
    """
    so_far = _by_document().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = strip(F.col("text"))
    opens = (F.col("type") == "heading") & (title != "")
    b = blocks.withColumn("_lv", F.when(opens, clamped_level(F.col("level")))).withColumn("section", F.sum(opens.cast("int")).over(so_far))
    for n in range(1, LEVELS + 1):
        b = b.withColumn(f"_h{n}", F.last(F.when(F.col("_lv") == n, F.struct("ord", title.alias("title"))), ignorenulls=True).over(so_far))
    own = F.last(F.when(opens, F.struct(F.col("_lv").alias("level"), title.alias("title"))), ignorenulls=True).over(so_far)
    b = b.withColumn("_own", own)
    kept = []
    for n in range(1, LEVELS + 1):
        above = [F.coalesce(F.col(f"_h{m}.ord"), F.lit(-1)) for m in range(1, n)]
        newest = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        kept.append(F.when((F.col("_own.level") > n) & (F.col(f"_h{n}.ord") > newest), F.col(f"_h{n}.title")))
    b = b.withColumn("path", F.array_compact(F.array(*kept))).withColumn("heading", F.col("_own.title"))
    return b.drop("_lv", "_own", *(f"_h{n}" for n in range(1, LEVELS + 1)))


def heading_frequency(blocks: DataFrame) -> DataFrame:
    """``doc_id, title, n`` of every heading."""
    return blocks.where("type = 'heading'").groupBy("doc_id", strip(F.col("text")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


def running_headers(blocks: DataFrame) -> DataFrame:
    """Sections of headings alone, all of which repeat in their document."""
    titled = section_paths(blocks)
    repeats = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "type", strip(F.col("text"))))
    b = titled.withColumn("_n", repeats)
    return b.groupBy("doc_id", "section").agg(F.every(F.col("type") == "heading").alias("bare"), F.every(F.col("_n") > 1).alias("repeated"), F.min("heading").alias("title")).where("bare and repeated").select("doc_id", "section", "title")


def table_of_contents(blocks: DataFrame) -> DataFrame:
    """``doc_id, toc``: title, level, page and block id of every heading, in order."""
    entry = F.struct("ord", strip(F.col("text")).alias("title"), clamped_level(F.col("level")).alias("level"), F.col("page_number").alias("page"), "block_id")
    toc = blocks.where("type = 'heading'").groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return toc.select("doc_id", F.transform("e", lambda x: F.struct(x["title"].alias("title"), x["level"].alias("level"), x["page"].alias("page"), x["block_id"].alias("block_id"))).alias("toc"))
