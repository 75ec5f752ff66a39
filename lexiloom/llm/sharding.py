"""Sharding by extendible hashing.

A document's hash (the first 60 bits of the MD5 of its id, a line feed and its
text) picks its shard by a prefix of bits.  The directory starts at
depth 0; a bucket above the byte limit splits on its next bit, others stay.

The bytes are first summed into fine cells (``cell_bits`` more bits than shards
need on average), then all depths of the directory are decided at once from the
cells: a document's depth is the smallest at which its bucket fits.  Cells that
are themselves too large go into another round with more bits, and only they.
What no bit can split (rows with the same hash, or a document above the limit)
is cut into numbered overflow pages by a running sum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, whole_text

_BITS = 60


def _prefix(bits) -> F.Column:
    return F.expr(f"shiftright(_hash, {_BITS - bits})") if isinstance(bits, int) else F.expr(f"shiftright(_hash, {_BITS} - {bits})")


def _directory(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves ``cell, depth, prefix`` of cells that fit at a depth up to ``high``, and cells that don't."""
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("_bytes").alias("b"))
    cells = checkpoint(cells)
    levels = cells.select("cell", "b", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.select("cell", "b", "depth", F.expr(f"shiftright(cell, {high} - depth)").alias("prefix"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    leaves = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    return leaves.select("cell", "leaf.*"), cells.where(F.col("b") > limit).select("cell")


def shard(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = 6) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, shard, depth, page, shard_bytes``.

    ``shard`` is the bucket's bits as text (the empty string at depth 0) and
    ``page`` its overflow page, 0 unless the bucket can't be split.  Each
    (shard, page) holds at most ``limit_bytes`` of UTF-8 text, except where a
    single document is larger; it then has a page of its own.

    Defined cases: null text has 0 bytes; ids may be null or repeated, rows
    with equal id and text go to the same bucket; an empty table gives an empty
    result; other columns are not read.
    """
    if limit_bytes <= 0:
        raise ValueError("limit_bytes must be positive")
    text = whole_text(text_col)
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("_id"),
            F.octet_length(text).cast("long").alias("_bytes"),
            F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text)), 1, _BITS // 4), 16, 10).cast("long").alias("_hash"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    low, high = 0, min(_BITS, math.ceil(math.log2(max(1, total / limit_bytes))) + cell_bits)
    left, done = rows, []
    while True:
        leaves, over = _directory(left, low, high, limit_bytes)
        over = checkpoint(over)
        placed = left.withColumn("cell", _prefix(high))
        last = high >= _BITS or over.isEmpty()
        done.append(placed.join(leaves, "cell").drop("cell", "_part", "_row").withColumn("page", F.lit(0)))
        if last:
            break
        left = checkpoint(placed.join(over, "cell", "left_semi").drop("cell"))
        low, high = high + 1, min(_BITS, high + cell_bits)
    if not over.isEmpty():
        done.append(_overflow(placed.join(over, "cell", "left_semi"), limit_bytes))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_bytes").alias("n_bytes"),
        F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise("").alias("shard"),
        "depth",
        "page",
        "shard_bytes",
    )


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets that share all hash bits.

    Rows of one hash have one size but for collisions, so a page takes a fixed
    number of them, the largest size deciding.  A row's number in its bucket
    comes from counts per (bucket, input partition) of the checkpointed rows:
    no task sorts a hot hash alone, and a task that runs again numbers alike.
    """
    parts = rows.groupBy("cell", "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_bytes").alias("_most"))
    ahead = Window.partitionBy("cell").orderBy("_part")
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = parts.select(
        "cell",
        "_part",
        (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"),
        F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max("_most").over(whole), F.lit(1)))).cast("long").alias("_per"),
    )
    nth = F.row_number().over(Window.partitionBy("cell", "_part").orderBy("_row")) - 1
    paged = rows.withColumn("_nth", nth).join(starts, ["cell", "_part"])
    paged = checkpoint(paged.withColumn("page", (F.floor((F.col("_before") + F.col("_nth")) / F.col("_per")) + 1).cast("int")).select("_id", "_bytes", "_hash", "cell", "page"))
    sums = paged.groupBy("cell", "page").agg(F.sum("_bytes").alias("shard_bytes"))
    return paged.join(sums, ["cell", "page"]).select("_id", "_bytes", "_hash", F.lit(_BITS).alias("depth"), F.col("cell").alias("prefix"), "shard_bytes", "page")
