"""Transcribing images of pages, formulas and figures through a model.

Every image is asked for once: images are keyed by the digest of their bytes
and looked up in a cache table first.  What a model returns is checked before
it is used, retried where that may help, and else left to a local engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .answers import ERROR_MARK, ImageModel
from .blocks import check_formula_transcript, check_page_transcript

DARK = 128


def ink_ratio(grey: np.ndarray) -> float:
    """Share of dark pixels of a grey image (rows x columns, 0 is black)."""
    return float((np.asarray(grey) < DARK).mean()) if np.asarray(grey).size else 0.0


def text_line_count(grey: np.ndarray, least: float = 0.005) -> int:
    """Number of text lines: runs of rows that hold ink."""
    inked = (np.asarray(grey) < DARK).mean(1) > least if np.asarray(grey).size else np.zeros(0, bool)
    return int((inked & ~np.r_[False, inked[:-1]]).sum()) if len(inked) else 0


def described(images: DataFrame, model: ImageModel, prompt: str, attempts: int = 1) -> DataFrame:
    """Adds ``transcript`` to rows with a column ``image``; errors are marked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(image):
            if image is None:
                return None
            error = ""
            for _ in range(attempts):
                try:
                    return model.describe_image(bytes(image), prompt)
                except Exception as e:  # noqa: BLE001 - one image's failure is its result
                    error = f"{ERROR_MARK} {type(e).__name__}: {e}"[:500]
            return error

        for batch in batches:
            yield pd.Series([one(x) for x in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return images.withColumn("transcript", F.pandas_udf(run, "string")(F.col("image")))


def transcribe(regions: DataFrame, cache: DataFrame, model: ImageModel, prompt: str, attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(regions with ``transcript``, new cache rows ``key, transcript``); equal images are sent once."""
    keyed = regions.withColumn("key", F.sha2("image", 256))
    missing = keyed.where("image is not null").select("key", "image").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = described(missing, model, prompt, attempts).where(F.col("transcript").isNotNull() & ~F.col("transcript").startswith(ERROR_MARK)).select("key", "transcript")
    return keyed.join(cache.unionByName(fresh), "key", "left").drop("key"), fresh


def transcribe_pages(pages: DataFrame, model: ImageModel, prompt: str, local: ImageModel | None = None) -> DataFrame:
    """Pages (doc_id, page_number, image, ink, text_lines) with ``text`` and ``engine``.

    A page whose transcript fails its check is read by ``local``, if there is one.
    """
    t = described(pages, model, prompt, 2)
    t = t.withColumn("check", check_page_transcript(F.when(~F.coalesce(F.col("transcript").startswith(ERROR_MARK), F.lit(True)), F.col("transcript")), F.col("ink"), F.col("text_lines")))
    good = t.where("check.ok").select("doc_id", "page_number", F.coalesce("transcript", F.lit("")).alias("text"), F.lit("model").alias("engine"))
    rest = t.where("not check.ok").drop("transcript")
    if local is None:
        return good.unionByName(rest.select("doc_id", "page_number", F.lit(None).cast("string").alias("text"), F.col("check.reason").alias("engine")))
    return good.unionByName(described(rest, local, prompt).select("doc_id", "page_number", F.col("transcript").alias("text"), F.lit("local").alias("engine")))


def enrich_formulas(regions: DataFrame, cache: DataFrame, model: ImageModel, prompt: str, most: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Formula regions (doc_id, ord, kind, image) with checked transcripts, the first ``most`` of a document; and new cache rows.

    Regions that stay without a usable transcript are dropped.
    """
    first = regions.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    found, fresh = transcribe(first, cache, model, prompt)
    return found.where(F.col("transcript").isNotNull() & check_formula_transcript(F.col("transcript"), F.col("kind"))["ok"]), fresh


def outcome_counts(results: DataFrame, outcome: str = "engine") -> DataFrame:
    """How many pages each engine, or reason, accounts for."""
    return results.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def ordered_detections(boxes: DataFrame, row_height: int = 20) -> DataFrame:
    """Text of detections (doc_id, page_number, top, left, text) in reading order."""
    parts = F.sort_array(F.collect_list(F.struct(F.round(F.col("top") / row_height).alias("r"), "left", "text")))
    return boxes.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
