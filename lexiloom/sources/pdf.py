"""PDF through a layout reader behind a protocol, or as pre-parsed items.

No PDF library is assumed.  A reader is any picklable object with ``read``; it
is called on the executors, and a second reader may stand in where it fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B

ITEM_SCHEMA = "doc_id string, source_file string, ord int, label string, text string, level int, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, group_id string"


class LayoutReader(Protocol):
    def read(self, content: bytes) -> list[dict]:
        """Items in order: label, text, level, page_number, bbox (4 numbers) and group_id."""


def read_items(pdfs: DataFrame, reader: LayoutReader, fallback: LayoutReader | None = None) -> DataFrame:
    """Layout items of ``doc_id, source_file, content``."""
    names = ["doc_id", "source_file", "ord", "label", "text", "level", "page_number", "bbox", "group_id"]
    box = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), box, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                doc, source, content = (batch.column(i)[at].as_py() for i in range(3))
                try:
                    items = reader.read(content)
                except Exception:
                    if fallback is None:
                        raise
                    items = fallback.read(content)
                rows = [(doc, source, n, i.get("label", "text"), i.get("text", ""), i.get("level"), i.get("page_number"), dict(zip(("x0", "y0", "x1", "y1"), i["bbox"], strict=True)) if i.get("bbox") else None, i.get("group_id")) for n, i in enumerate(items)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return pdfs.select("doc_id", "source_file", "content").mapInArrow(run, ITEM_SCHEMA)


def blocks_from_items(items: DataFrame) -> DataFrame:
    """Items to blocks: labels mapped, headers and footers dropped, columns read in order, fragments merged."""
    mapped = B.map_labels(items)
    ordered = B.reorder_columns(mapped).withColumn("ord", F.col("reading_ord")).drop("reading_ord")
    return B.stamp_blocks(B.merge_adjacent(ordered).withColumn("has_image", F.lit(False)))


def flat_pages(items: DataFrame) -> DataFrame:
    """The plain reading: one block per page."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "text")))
    text = F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x["text"])), lambda t: t != ""), "\n")
    return items.groupBy("doc_id", "source_file", "page_number").agg(F.min("ord").alias("ord"), text.alias("text")).withColumn("type", F.lit("pdf_page"))
