"""Answering: passages, context, prompts, and models behind small protocols.

Models are passed in as picklable objects and called in Arrow batches on the
executors; an error of one row becomes that row's answer and ends nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_variants

# Messages, markers and header keys that results depend on.
NO_CONTEXT = "No relevant context was found in the document to answer the question."
ERROR_MARK = "[PIPELINE_ERROR]"
ERROR_CHARS = 500
HEADER_KEYS = ("source_file", "doc_title", "page_number", "page_numbers", "slide_number", "sheet_name", "heading_path", "section", "block_type", "time_start")
MAX_VARIANTS = 8
# End of fixed values.

PROMPTS = {
    "v1": "Answer from the context below, in the language of the question; say so if it is not enough. Be brief and name the source.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:",
    "v2": "Answer strictly from the passages below, completely and in the language of the question. Keep figures and units as they stand. End with the files and pages you used.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:",
    "v3": "Answer strictly from the passages below, completely and in the language of the question. Keep figures and units as they stand. Give the answer alone, without sources.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:",
    "v4": "Answer strictly from the passages below, in the language of the question. Give what was asked and nothing else, without sources.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:",
}
PARAPHRASE = "Rephrase this search question in {count} other ways, one a line:\n{question}"
HYPOTHETICAL = "Write a short passage that would answer this question:\n{question}"


class TextModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class ImageModel(Protocol):
    def describe_image(self, image: bytes, prompt: str) -> str: ...


class HashingEncoder:
    """Deterministic stand-in for a sentence encoder: hashed words, unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h >> 16 & 1 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


def encoded(df: DataFrame, text_col: str, encoder: Encoder, out: str = "vector", batch: int = 256) -> DataFrame:
    """Adds a vector column; an encoder that returns another number of rows is an error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found: list = []
            for at in range(0, len(texts), batch):
                part = [t or "" for t in texts[at : at + batch]]
                vectors = encoder.encode(part)
                if len(vectors) != len(part) or any(len(v) == 0 for v in vectors):
                    raise ValueError("the encoder returned an unexpected shape")
                found += [[float(x) for x in v] for v in vectors]
            yield pd.Series(found, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def reranked(scorer: PairScorer, batch: int = 64):
    """A function for ``search(reranked=...)`` that scores (question, text) pairs."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            pairs = list(zip(q, t, strict=True))
            yield pd.Series([float(s) for at in range(0, len(pairs), batch) for s in scorer.predict(pairs[at : at + batch])], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    score = F.pandas_udf(run, "double")
    return lambda hits: hits.withColumn("rerank_score", score("question", "text"))


def generated(df: DataFrame, prompt: Column, model: TextModel, out: str = "answer") -> DataFrame:
    """Adds a model's answer; null prompts stay null, blank answers and errors are marked."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(p):
            if p is None:
                return None
            try:
                answer = (model.generate(p) or "").strip()
                if not answer:
                    raise ValueError("blank answer")
                return answer
            except Exception as e:  # noqa: BLE001 - one row's failure is its result
                return f"{ERROR_MARK} {type(e).__name__}: {e}"[:ERROR_CHARS]

        for prompts in batches:
            yield pd.Series([one(p) for p in prompts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "string")(prompt))


def formulations(questions: DataFrame, model: TextModel, mode: str = "paraphrase", count: int = 3) -> DataFrame:
    """``query_id, formulation, text``: the question (0) and distinct variants of it.

    A model that fails leaves the question alone.
    """
    if mode not in ("paraphrase", "hyde", "mixed") or not 1 <= count <= MAX_VARIANTS:
        raise ValueError("mode is paraphrase, hyde or mixed and count from 1 to 8")
    q = questions.select("query_id", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("text"))
    n = {"paraphrase": count, "hyde": 0, "mixed": count - 1}[mode]
    fill = lambda t, **k: F.replace(F.lit(t.format(question="\x01", **k)), F.lit("\x01"), F.col("text"))
    parts = F.array(F.col("text"))
    if n:
        q = generated(q, fill(PARAPHRASE, count=n), model, "_raw")
        raw = F.when(~F.col("_raw").startswith(ERROR_MARK), F.col("_raw"))
        parts = F.concat(parts, F.coalesce(parse_variants(raw, F.col("text"), n), F.array().cast("array<string>")))
    if mode != "paraphrase":
        q = generated(q, fill(HYPOTHETICAL), model, "_hyde")
        passage = F.when(~F.col("_hyde").startswith(ERROR_MARK), F.regexp_replace("_hyde", r"\s+", " "))
        parts = F.concat(parts, F.array_compact(F.array(passage)))
    low = F.transform(parts, F.lower)
    first = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("t"), i.alias("i"))), lambda x: F.array_position(low, F.lower(x["t"])) == x["i"] + 1)
    return q.select("query_id", F.posexplode(F.transform(first, lambda x: x["t"])).alias("formulation", "text"))


def cached_calls(requests: DataFrame, cache: DataFrame, model: TextModel, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Answers of prompts, the model being asked once for each that the cache lacks.

    Returns (requests with ``answer``, new cache rows ``key, answer``).
    """
    keyed = requests.withColumn("key", F.sha2(F.col(prompt), 256))
    missing = keyed.select("key", F.col(prompt)).dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = generated(missing, F.col(prompt), model).where(~F.col("answer").startswith(ERROR_MARK)).select("key", "answer")
    return keyed.join(cache.unionByName(fresh), "key", "left").drop("key"), fresh


def select_passages(hits: DataFrame) -> DataFrame:
    """The first hit of each passage (parent text, else the chunk's own), with new ranks."""
    h = hits.withColumn("passage", F.coalesce(F.nullif("context", F.lit("")), F.col("text")))
    first = h.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "passage").orderBy("rank"))).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("_n")


def context_header(columns: list[str]) -> Column:
    """``key=value | ...`` of what describes a passage, from the columns there are."""

    def shown(key: str) -> Column:
        c = F.col(key)
        if key == "heading_path":
            return F.array_join(c, " > ")
        if key == "page_numbers":
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
        return c.cast("string")

    parts = []
    for key in HEADER_KEYS:
        if key not in columns:
            continue
        ok = F.coalesce(shown(key) != "", F.lit(False))
        if key == "page_numbers" and "page_number" in columns:
            ok = ok & ~(F.col("page_number").isNotNull() & (F.size(key) == 1))
        if key == "page_number" and "page_numbers" in columns:
            ok = ok & ~F.coalesce(F.size("page_numbers") > 1, F.lit(False))
        if key == "section" and "heading_path" in columns:
            ok = ok & ~F.coalesce(F.size("heading_path") > 0, F.lit(False))
        parts.append(F.when(ok, F.concat(F.lit(f"{key}="), shown(key))))
    joined = F.array_join(F.array_compact(F.array(*parts)), " | ") if parts else F.lit("")
    return F.when(joined != "", joined).otherwise("metadata: none")


def contexts(passages: DataFrame, version: str = "v3") -> DataFrame:
    """``query_id, context``: numbered passages under their headers, in rank order.

    In ``v1`` a header names the chunk's number, its score and every piece of
    metadata, as they are.
    """
    if version == "v1":
        shown = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in HEADER_KEYS if k in passages.columns]
        score = F.regexp_replace(F.format_string("%.6f", F.col("score").cast("double")), r"\.?0+$", "")
        head = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit(" | score="), score, F.lit(" | metadata: "), F.concat_ws(", ", *shown), F.lit("]"))
    else:
        head = F.concat(F.lit("[Источник "), F.col("rank").cast("string"), F.lit(" | "), context_header(passages.columns), F.lit("]"))
    part = F.struct("rank", head.alias("h"), F.col("passage").alias("p"))
    lines = F.transform(F.sort_array(F.collect_list(part)), lambda x: F.concat(x["h"], F.lit("\n"), x["p"]))
    return passages.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("context"))


def qa_prompt(question: Column, context: Column, version: str = "v3") -> Column:
    if version not in PROMPTS:
        raise ValueError(f"version must be one of {', '.join(PROMPTS)}")
    filled = F.replace(F.lit(PROMPTS[version]), F.lit("{question}"), question)
    return F.replace(filled, F.lit("{context}"), context)


def answer(questions: DataFrame, hits: DataFrame, model: TextModel, version: str = "v3") -> DataFrame:
    """``query_id, question, contexts, answer``; without hits a fixed message and no model call."""
    p = select_passages(hits)
    text = contexts(p, version)
    meta = [c for c in HEADER_KEYS if c in p.columns]
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source_file").alias("document_id"), F.col("passage").alias("text"),
        F.col("text").alias("retrieval_text"), F.col("score").cast("double").alias("score"), F.to_json(F.struct(*meta)).alias("metadata_json"),
    )
    kept = p.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("contexts"))
    q = questions.select("query_id", F.col("text").alias("question")).join(text, "query_id", "left").join(kept, "query_id", "left")
    prompt = F.when(F.col("context").isNotNull(), qa_prompt(F.col("question"), F.col("context"), version))
    out = generated(q, prompt, model)
    return out.select("query_id", "question", "contexts", F.coalesce("answer", F.lit(NO_CONTEXT)).alias("answer"))
