"""Incremental ingest: new files become blocks and chunks as they arrive.

The reference workload has no streams; this runs the same batch operators in
``foreachBatch`` over a file source, each micro-batch appending once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_documents
from ..session import ChunkSettings
from ..sources.files import text_blocks


def chunk_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, settings: ChunkSettings = ChunkSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> StreamingQuery:
    """Chunk Parquet files of documents that land in ``source``; ends when none are left.

    Chunks of a batch are written under its number, so a batch that is run
    again after a failure replaces its own output.
    """

    def batch(docs: DataFrame, number: int) -> None:
        chunk_documents(text_blocks(docs, id_col, text_col, source_col), settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
