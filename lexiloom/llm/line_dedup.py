"""Line dedup: hashes in ranges, sorted by document, first occurrences streamed.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lowered.
Only 128 bits of a key travel, never the line.

1. Each document gives its distinct long keys.  They are counted per key and
   document bucket, each id once, so that a key found in a third of all
   documents becomes at most ``salts`` rows.
2. These rows are range-partitioned by hash and sorted by document, largest
   first.  A window over that order streams them: the first row of a key names
   the document that keeps its lines, at whatever positions.
3. Lines of keys in enough documents, but for the keeper's, set bits.  The
   result is a sparse bitmap per document: 64-bit words, and only those that
   drop a line.

Only DataFrame functions are used.  The joins on hashes are plain sort-merge
joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, free_name, whole_text

_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _ascii_lower(key: Column) -> Column:
    """A-Z lowered and nothing else; for text of ASCII alone the faster ``lower`` does that."""
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(F.lit(11), text).alias("_rid"))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``_id, _rid, _keys``: per document (pos, h1, h2) of every line whose key is long enough."""
    lines = F.transform(split_lines(F.col("_text")), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_STRIP)).alias("key")))
    long_ones = F.filter(lines, lambda x: F.length(x["key"]) >= min_chars)

    # each step is a transform of its own, so that a key is lowered once for both hashes
    lowered = F.transform(long_ones, lambda x: F.struct(x["pos"].alias("pos"), _ascii_lower(x["key"]).alias("key")))
    hashed = F.transform(lowered, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))
    return _document(docs, id_col, text_col).where(F.length("_text") >= min_chars).select("_id", "_rid", hashed.alias("_keys"))


def repeated_keys(hashes: DataFrame, min_docs: int, salts: int = 16) -> DataFrame:
    """Keys found in at least ``min_docs`` documents and the document that keeps them."""
    distinct = F.array_distinct(F.transform("_keys", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))
    once = hashes.select("_id", F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(salts)).cast("int").alias("_salt"), F.explode(distinct).alias("_k"))
    keyed = once.select(F.col("_k.h1").alias("_h1"), F.col("_k.h2").alias("_h2"), "_salt", "_id").repartition("_h1", "_h2", "_salt")
    # rows of one id are one document; both aggregations use the partitioning above
    ids = keyed.groupBy("_h1", "_h2", "_salt", "_id").agg(F.lit(1).alias("_one"))
    salted = ids.groupBy("_h1", "_h2", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"))
    runs = salted.repartitionByRange("_h1").sortWithinPartitions("_h1", "_h2", F.desc("_last"))
    stream = Window.partitionBy("_h1", "_h2").orderBy(F.desc("_last"))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        runs.select("_h1", "_h2", F.row_number().over(stream).alias("_nth"), F.sum("_n").over(whole).alias("_docs"), F.col("_last").alias("_keeper"))
        .where((F.col("_nth") == 1) & (F.col("_docs") >= min_docs))
        .select("_h1", "_h2", "_keeper")
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, salts: int = 16) -> DataFrame:
    """``_id, _rid, n_dropped, keep_bitmap`` of documents that lose lines.

    ``keep_bitmap`` is an array of (word, bits): bit ``i`` of word ``w`` is 0
    if line ``64 w + i`` goes.  Words that aren't listed keep all their lines.
    """
    hashes = checkpoint(line_hashes(docs, id_col, text_col, min_chars))
    lines = hashes.select("_id", "_rid", F.explode("_keys").alias("_k")).select("_id", "_rid", F.col("_k.pos").alias("_pos"), F.col("_k.h1").alias("_h1"), F.col("_k.h2").alias("_h2"))
    found = lines.join(repeated_keys(hashes, min_docs, salts), ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    words = found.groupBy("_id", "_rid", F.shiftright("_pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_drop")
    )
    return words.groupBy("_id", "_rid").agg(
        F.sum(F.bit_count("_drop")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("_drop").alias("bits")))).alias("keep_bitmap"),
    )


def apply_bitmap(text: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps, joined by a line feed."""
    by_word = F.map_from_entries(F.transform(bitmap, lambda x: F.struct(x["word"], x["bits"])))
    dense = F.transform(F.sequence(F.lit(0), F.element_at(bitmap, -1)["word"]), lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("long")))
    bit = lambda words, i: F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
    kept = F.transform(
        F.array(F.struct(dense.alias("d"), split_lines(text).alias("l"))),
        lambda x: F.array_join(F.filter(x["l"], lambda _, i: F.getbit(bit(x["d"], i), i % 64) == 1), "\n"),
    )
    return F.coalesce(F.when(bitmap.isNull(), text).otherwise(F.element_at(kept, 1)), F.lit(""))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, salts: int = 16) -> DataFrame:
    """All columns of ``docs`` with the kept lines as text, and two counts, ``_lx_lines`` and ``_lx_dropped``.

    Defined cases: null text is one empty line; rows that share an id are one
    document to the counts and share the decision; a null id is smaller than
    any other; an empty table gives an empty result; a text without dropped
    lines is returned unchanged; columns of any name are passed on, and where
    one already has the name of a count, that count gets a further underscore.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs, salts)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(F.lit(11), whole_text(text_col)).alias("_key"))
    joined = rows.join(maps, (F.col("_key") == F.col("_rid")) & F.col("_own").eqNullSafe(F.col("_id")), "left")
    before = F.col("_row").getField(text_col)
    whole = F.coalesce(before.cast("string"), F.lit(""))
    kept = F.when(F.col("n_dropped").isNull(), before).otherwise(apply_bitmap(whole, F.col("keep_bitmap")))
    return joined.select(
        *[(kept if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns],
        F.size(split_lines(whole)).cast("long").alias(free_name(docs, "_lx_lines")),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias(free_name(docs, "_lx_dropped")),
    )
