"""Files and text columns to block tables."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import html, markdown, office, plain

BLOCK_SCHEMA = "doc_id string, source_file string, ord int, block_id string, type string, text string, level int, page_number int, metadata_json string"

#: Suffix -> (parser, whether it takes bytes).
PARSERS = {
    "txt": (plain.parse_text, False),
    "md": (markdown.parse_markdown, False),
    "markdown": (markdown.parse_markdown, False),
    "html": (html.parse_html, False),
    "htm": (html.parse_html, False),
    "docx": (office.parse_docx, True),
    "xlsx": (office.parse_xlsx, True),
    "xlsm": (office.parse_xlsx, True),
    "pptx": (office.parse_pptx, True),
}


class UnsupportedFile(ValueError):
    """No parser for a suffix."""


def parse(content: str | bytes, suffix: str, profile: str = "structured") -> list[plain.Parsed]:
    """Blocks of one document."""
    if suffix not in PARSERS or (suffix == "xlsm" and profile == "legacy"):
        raise UnsupportedFile(f"Unsupported file type: {suffix}")
    parser, wants_bytes = PARSERS[suffix]
    if not wants_bytes and isinstance(content, bytes):
        content = plain.decode(content)
    return parser(content, profile)


def blocks_of(rows: DataFrame, profile: str = "structured") -> DataFrame:
    """Block rows of ``doc_id, source_file, suffix, content``; documents are parsed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in BLOCK_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for at in range(batch.num_rows):
                doc, source, suffix, content = (batch.column(i)[at].as_py() for i in range(4))
                found = parse(content or "", suffix, profile) if content or suffix == "txt" else []
                out = []
                for n, (kind, text, level, extra) in enumerate(found, 1):
                    meta = {k: v for k, v in extra.items() if v is not None}
                    out.append((doc, source, n, f"block-{n}", kind, text, level, extra.get("page_number"), json.dumps(meta, ensure_ascii=False, sort_keys=True) if meta else None))
                columns = zip(*out, strict=True) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.select("doc_id", "source_file", "suffix", "content").mapInArrow(run, BLOCK_SCHEMA)


def read_files(spark: SparkSession, path: str, profile: str = "structured") -> DataFrame:
    """Blocks of all files under ``path``; a file of an unknown type is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.when(suffix.isin(*PARSERS), suffix).otherwise(F.raise_error(F.concat(F.lit("Unsupported file type: "), suffix)))
    return blocks_of(files.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), known.alias("suffix"), "content"), profile)


def text_blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str, suffix: str = "txt", profile: str = "structured") -> DataFrame:
    """Blocks of a table of texts, each read as a file with ``suffix``."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).cast("string").alias("source_file"), F.lit(suffix).alias("suffix"), F.col(text_col).alias("content"))
    return blocks_of(rows, profile)


def paragraph_blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One block per non-empty line, inside the JVM; the cheap reader for line-oriented text."""
    lines = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).alias("source_file"), F.posexplode(F.split(text_col, "\n", -1)).alias("ord", "text")).where(F.trim("text") != "")
    return lines.select("doc_id", "source_file", "ord", F.concat(F.lit("block-"), (F.col("ord") + 1).cast("string")).alias("block_id"), F.lit("text").alias("type"), "text", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("metadata_json"))


def match_documents(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records' ``doc_ids`` joined to files by Unicode-normalised path, in order.

    Adds ``matches``, the number of files of that normal form: 1 is right, 0 is
    missing and more are ambiguous.
    """
    nfc = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x)), "string")
    wanted = records.select("id", F.posexplode("doc_ids").alias("pos", "doc_id")).withColumn("_nfc", nfc(F.col("doc_id")))
    have = files.select(F.col("path"), nfc(F.col("path")).alias("_nfc"))
    found = have.groupBy("_nfc").agg(F.count(F.lit(1)).alias("matches"), F.min("path").alias("path"))
    return wanted.join(found, "_nfc", "left").select("id", "pos", "doc_id", F.when(F.col("matches") == 1, F.col("path")).alias("path"), F.coalesce("matches", F.lit(0)).alias("matches"))


def fetched(records: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """``id, pos, doc_id, path`` and the content of every record's documents; a missing or ambiguous one is an error."""
    found = match_documents(records, files.select("path"))
    wrong = F.when(F.col("matches") == 0, F.concat(F.lit("no such document: "), "doc_id")).when(F.col("matches") > 1, F.concat(F.lit("ambiguous document: "), "doc_id"))
    checked = found.withColumn("path", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("path")))
    return checked.join(files.select("path", content), "path").select("id", "pos", "doc_id", "path", content)


def parsed_once(wanted: DataFrame, files: DataFrame, profile: str = "structured") -> DataFrame:
    """Blocks for each (id, path) of ``wanted``, every file being parsed once however often it is asked for.

    ``files``: path, content.  Adds ``id`` to the columns of ``blocks_of``.
    """
    distinct = files.join(wanted.select("path").distinct(), "path", "left_semi")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parsed = blocks_of(distinct.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), suffix.alias("suffix"), "content"), profile)
    return wanted.select("id", F.col("path").alias("doc_id")).join(parsed, "doc_id")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set (Parquet or JSON lines) with ``row_index`` in file order.

    Rows are numbered within their part of a file; the parts, which are few,
    get the numbers before them from their counts.
    """
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    if "row_index" in rows.columns:
        return rows
    part = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"))
    kept = F.struct(*rows.columns).alias("_row")
    parts = rows.select(kept, part.alias("_part"), F.monotonically_increasing_id().alias("_n"))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = counts.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_n")) - 1
    numbered = parts.withColumn("_nth", nth).join(before, "_part")
    return numbered.select("_row.*", (F.col("_before") + F.col("_nth")).cast("long").alias("row_index"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run file: ``id, question, answer_model, contexts, answer``; contexts become texts."""
    if not path.endswith(".parquet"):
        raise ValueError("run files are Parquet")
    run = spark.read.parquet(path)
    need = ["id", "question", "answer_model", "contexts", "answer"]
    if missing := [c for c in need if c not in run.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if "struct" in run.schema["contexts"].dataType.simpleString():
        run = run.withColumn("contexts", F.transform("contexts", lambda c: c["text"]))
    return run


def source_sentences(text: DataFrame, id_col: str, text_col: str, words: int = 6, longest: int = 300) -> DataFrame:
    """An independent reader for coverage: ``doc_id, sentence`` of six words or more."""
    bare = F.regexp_replace(F.col(text_col), r"\[\d{1,2}:\d{2}(?::\d{2})?\]", " ")
    parts = text.select(F.col(id_col).alias("doc_id"), F.explode(F.split(bare, r"(?<=[.!?])\s+|\n+")).alias("sentence"))
    s = F.trim("sentence")
    return parts.select("doc_id", s.alias("sentence")).where((F.size(F.split("sentence", r"\s+")) >= words) & (F.length("sentence") < longest))
