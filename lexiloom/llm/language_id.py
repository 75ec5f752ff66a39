"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text, what
is not a letter counting as a blank.  A feature's value is its share of the
text's n-grams times its inverse document frequency, counted over all rows
that may be learnt from.  Training is
follow-the-regularised-leader (proximal) with an L1 and an L2 penalty, on a
bounded sample of labelled rows, followed by temperature calibration on a part
of the sample that training did not see.

Scoring needs no feature table: a logit is the mean of idf * weight over all
n-grams of the whole text, taken in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import short_batches, whole_text

BITS = 15
SCALE = 30.0  # brings shares of n-grams to about 1
UNDETERMINED = "und"
_DF_BLOCK = 1024


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(32))


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order; order 0 of ``n`` begins at each place."""
    h = codes * np.uint32(0x9E3779B1)
    yield (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    for n in (1, 2):
        if len(codes) <= n:
            return
        h = (h[:-1] ^ h[:-1] >> np.uint32(13)) * np.uint32(0xC2B2AE35) + codes[n:] * np.uint32(0x9E3779B1)
        yield (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def _offsets(order: int) -> int:
    return order << BITS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their shares, for training."""
    parts = [g.astype(np.int64) + _offsets(k) for k, g in enumerate(_grams(_codes(text)))]
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids, n / n.sum()


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages, idf and temperature included
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Rows of probabilities; NaN for texts without a letter."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        for i, text in enumerate(texts):
            codes = _codes(text)
            if not (codes != 32).any():
                continue
            total, n = np.zeros(len(self.languages)), 0
            for at in range(0, len(codes), 1 << 18):  # blocks overlap by what an n-gram reaches
                for k, g in enumerate(_grams(codes[at : at + (1 << 18) + 2])):
                    g = g[: 1 << 18]
                    total += self.weights[_offsets(k) : _offsets(k + 1)].take(g, 0).sum(0, dtype=np.float64)
                    n += len(g)
            z = total / n + self.bias
            z = np.exp(z - z.max())
            out[i] = z / z.sum()
        return out


def document_frequencies(rows: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many texts hold each feature, and how many texts there are: one bounded row set per partition, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(_offsets(3) + 1, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen = np.zeros(len(df), bool)
                for k, g in enumerate(_grams(_codes(value.as_py()))):
                    seen[g.astype(np.int64) + _offsets(k)] = True
                df += seen
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at // _DF_BLOCK, pa.int32()), pa.array(at % _DF_BLOCK, pa.int32()), pa.array(df[at], pa.int64())], ["b", "i", "n"])

    found = short_batches(rows).select(F.col(text_col).alias("t")).mapInArrow(run, "b int, i int, n long").groupBy("b", "i").agg(F.sum("n").alias("n"))
    out = np.zeros(_offsets(3) + 1, np.int64)
    for r in found.groupBy("b").agg(F.collect_list("i").alias("i"), F.collect_list("n").alias("n")).toLocalIterator():
        out[np.array(r.i) + r.b * _DF_BLOCK] = r.n
    return out[:-1], int(out[-1])


def train(texts: list[str], labels: list[str], frequencies: tuple[np.ndarray, int] | None = None, l1: float = 0.3, l2: float = 1.0, alpha: float = 0.5, beta: float = 1.0, epochs: int = 3, seed: int = 7) -> LanguageModel:
    """FTRL-proximal with elastic net on four fifths; temperature on the rest.

    ``frequencies``: how many texts hold each feature, and of how many; those
    of the texts given unless they are known for more.
    """
    languages = sorted(set(labels))
    size, k = _offsets(3), len(languages)
    if not texts:
        return LanguageModel([UNDETERMINED], np.zeros((size, 1), np.float32), np.zeros(1), 1.0)
    rows = [(features(t), languages.index(y)) for t, y in zip(texts, labels, strict=True) if t]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = {int(i) for i in order[: len(rows) // 5]}
    fit = [i for i in range(len(rows)) if i not in held] or list(range(len(rows)))
    df, known = np.zeros(size), len(fit)
    if frequencies:
        df, known = frequencies
    else:
        for i in fit:
            df[rows[i][0][0]] += 1
    idf = np.log((1 + known) / (1 + df)) + 1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0, w)

    for _ in range(epochs):
        for i in rng.permutation(fit):
            (ids, share), y = rows[i]
            at = np.append(ids, size)
            x = np.append(share * idf[ids] * SCALE, 1.0)
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    scaled = w[:size] * idf[:, None] * SCALE
    logits = [(share @ scaled[ids] + w[size], y) for (ids, share), y in (rows[i] for i in sorted(held))]

    def loss(t: float) -> float:
        total = 0.0
        for v, y in logits:
            v = v / t
            total += np.log(np.exp(v - v.max()).sum()) + v.max() - v[y]
        return total

    temperature = float(min(np.geomspace(0.2, 5, 33), key=loss)) if logits else 1.0
    return LanguageModel(languages, (scaled / temperature).astype(np.float32), w[size] / temperature, temperature)


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows_per_language: int = 600, most_languages: int = 500, **options) -> LanguageModel:
    """Train on a sample of labelled rows, at most about ``rows_per_language`` of each language.

    Rows are drawn by a hash of ``key_col``, so the same rows at every run; the
    share to draw, and the document frequencies, come from all labelled rows.
    More than ``most_languages`` values of ``lang_col`` are an error.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    draw = F.pmod(F.xxhash64(F.lit(17), F.coalesce(F.col(key_col).cast("string"), F.lit(""))), F.lit(1_000_000))
    below = F.lit(None).cast("long")
    for lang, n in sorted(counts.items()):
        below = F.when(F.col(lang_col) == lang, F.lit(int(1_000_000 * min(1.0, rows_per_language / n)))).otherwise(below)
    sample = rows.where(draw < below).select(F.col(text_col).alias("t"), F.col(lang_col).alias("y"), F.col(key_col).alias("k")).collect()
    sample.sort(key=lambda r: (r.y, str(r.k), r.t))
    return train([r.t for r in sample], [r.y for r in sample], document_frequencies(rows, text_col), **options)


def language_struct(model: LanguageModel, text: Column) -> Column:
    """Struct (lang, score) of a text column; ``und`` and 0 for null or letterless text."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = model.probabilities(texts.tolist())
            none = np.isnan(p[:, 0]) if len(p) else np.zeros(0, bool)
            p[none] = 0
            names = np.array(model.languages, object)[p.argmax(1)] if len(p) else np.zeros(0, object)
            names[none] = UNDETERMINED
            yield pd.DataFrame({"lang": names, "score": p.max(1) if len(p) else np.zeros(0)})

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "lang string, score double")(text)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, whole texts.

    Defined cases: null text, or text without a letter, is ``und`` with score
    0; rows may repeat; an empty table gives an empty result; other columns are
    not read.
    """
    scored = short_batches(docs).select(docs[id_col].alias("doc_id"), language_struct(model, whole_text(text_col)).alias("_p"))
    return scored.select("doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is determined with at least ``min_score``.

    Defined cases: those of ``identify``; null and letterless texts go, rows
    that repeat share a decision, columns of any name are passed on.
    """
    p = language_struct(model, whole_text(text_col))
    return short_batches(docs).where((p["lang"] != UNDETERMINED) & (p["score"] >= min_score))
