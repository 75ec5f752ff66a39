"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition forms one run: its distinct digests with the number of
rows and the identifier to keep.  Runs then merge in binomial rounds: round k
joins ``2**fan_in_bits`` neighbouring runs of round k-1 into one, and the rows
of a merged run are dealt out by (run, digest), so even the last round, with a
single run, is spread over all partitions.  Each round aggregates map-side
before it exchanges, so a digest that holds a third of all rows arrives as one
row per run.  Digests only merge if a second hash and the byte length agree.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, whole_text

_KEY = ["_sha", "_check", "_bytes"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One compact row per document: id, row token, run number and digests."""
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
        F.spark_partition_id().alias("_run"),
    ).select(
        "_id",
        "_row",
        "_run",
        F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.xxhash64("_text").alias("_check"),
        F.octet_length("_text").alias("_bytes"),
    )


def merge_runs(rows: DataFrame, n_runs: int, keep: str = "max", fan_in_bits: int = 3) -> DataFrame:
    """Merge ``n_runs`` runs into one: a row per digest with its keeper and count."""
    best = F.max if keep == "max" else F.min
    run = rows.groupBy("_run", *_KEY).agg(best(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    while n_runs > 1:
        n_runs = (n_runs - 1 >> fan_in_bits) + 1
        run = (
            run.withColumn("_run", F.shiftright("_run", fan_in_bits))
            .groupBy("_run", *_KEY)
            .agg(best("_keep").alias("_keep"), F.sum("_n").alias("_n"))
        )
    return run.drop("_run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in_bits: int = 3) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep``: ``"max"`` or ``"min"``, which identifier of equal texts stays.

    Defined cases: null text counts as empty; a null id is smaller than any
    other; of rows that repeat both id and text exactly one is kept; an empty
    table gives an empty result; columns other than the two named are not read.
    """
    rows = checkpoint(digest_runs(docs, id_col, text_col))
    last = rows.agg(F.max("_run")).first()[0]
    groups = merge_runs(rows, (last or 0) + 1, keep, fan_in_bits)
    return rows.drop("_run").join(groups, _KEY).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep._id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
