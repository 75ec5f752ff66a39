"""Reports, audits, coverage and retrieval metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTROL, MOJIBAKE, TABLE_RULE, strip, tokens
from .batch import _each

# Limits of the audits, and prices per 1000 tokens.
LONG_HEADING, SHORT_BODY = 300, 15
PRICE_INPUT, PRICE_CACHED, PRICE_OUTPUT = 0.3, 0.5, 0.075
# End of fixed values.


def medians(values: DataFrame) -> DataFrame:
    """``metric, median`` of rows ``metric, v``, exact, without bringing a metric's values into one task.

    A sketch bounds the middle; values below it are counted, and only the
    thousandth part between its bounds is sorted, as distinct values with
    counts.
    """
    v = values.where("v is not null")
    middle = v.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [0.4995, 0.5005], 10_000).alias("q"))
    # one row for each metric that was asked for
    near = v.join(F.broadcast(middle), "metric").select("metric", "v", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    counted = near.groupBy("metric", "n", F.when((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")), F.col("v")).when(F.col("v") > F.col("high"), float("inf")).alias("at")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("metric").orderBy(F.asc_nulls_first("at")))
    ranks = [F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)]
    placed = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("c"))
    holds = [F.when((r >= F.col("_from")) & (r < F.col("_to")), F.col("at")) for r in ranks]
    return placed.groupBy("metric").agg(((F.max(holds[0]) + F.max(holds[1])) / 2).alias("median"))


def metric_report(scored: DataFrame, metrics: list[str], negative: str | None = None, answer: str = "answer") -> DataFrame:
    """``metric, n_examples, mean, median, min, max`` (rounded to 4), and means of negative answers.

    ``negative``: a pattern, matched without regard to case; null answers don't match.
    """
    hit = F.coalesce(F.col(answer).rlike(f"(?i){negative}"), F.lit(False)) if negative else F.lit(False)
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))
    long = scored.select(hit.alias("hit"), F.explode(each).alias("m")).select("hit", "m.metric", "m.v")
    one = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_examples"), F.count_if("hit").alias("n_negative"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg(F.when(F.col("hit"), F.col("v"))).alias("mean_on_negative")
    )
    asked = scored.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    both = asked.join(one, "metric", "left").join(medians(long.select("metric", "v")), "metric", "left")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("n_examples", "n_negative"))
    return both.select("metric", *counts, *(F.round(k, 4).alias(k) for k in ("mean", "median", "min", "max", "mean_on_negative")))


def usage_cost(calls: DataFrame, by: list[str], price_input: float = PRICE_INPUT, price_cached: float = PRICE_CACHED, price_output: float = PRICE_OUTPUT) -> DataFrame:
    """Token sums and cost; cached tokens have a price of their own."""
    s = calls.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")))
    cost = F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0)) / 1000 * price_input + F.col("cached_tokens") / 1000 * price_cached + F.col("output_tokens") / 1000 * price_output
    return s.withColumn("cost", cost)


def block_audit(blocks: DataFrame, file_type: str | None = None) -> DataFrame:
    """``rule, key, detail`` of blocks that look wrong."""
    text = F.coalesce("text", F.lit(""))
    short = F.substring(text, 1, 60)
    order = Window.partitionBy("doc_id").orderBy("ord")
    mark = F.struct("type", strip(text).alias("t"))
    b = blocks.withColumn("_repeat", (strip(text) != "") & mark.eqNullSafe(F.lag(mark).over(order)))
    rules = [
        ("empty_block", "doc_id", (strip(text) == "") & ~F.col("type").isin("figure", "image"), F.col("type")),
        ("mojibake", "doc_id", text.rlike(MOJIBAKE), short),
        ("control_chars", "doc_id", text.rlike(CONTROL), short),
        ("heading_too_long", "doc_id", (F.col("type") == "heading") & (F.length(text) > LONG_HEADING), short),
        ("block_without_source_file", "doc_id", F.coalesce(F.col("source_file") == "", F.lit(True))),
        ("duplicate_adjacent_block", "doc_id", F.col("_repeat"), short),
    ]
    if file_type == "pdf":
        rules.append(("pdf_block_without_page", "doc_id", F.col("page_number").isNull(), F.col("type")))
    return _each(b, rules)


def chunk_audit(chunks: DataFrame, budget: int) -> DataFrame:
    """``rule, key, detail`` of chunks that look wrong; the chunks are computed once.

    Chunks of a document with equal texts are counted by the texts' digests;
    every chunk that a rule finds is one row before, and only these and the
    digests are exchanged.
    """
    text = F.coalesce("text", F.lit(""))
    some = strip(text) != ""
    crumb = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")
    rest = F.regexp_replace(F.substr(text, F.length(crumb) + 1), r"^[ >\n]+|[ >\n]+$", "")
    body = F.when((crumb != "") & F.startswith(text, crumb), rest).otherwise(text)
    table = (F.size("block_types") == 1) & F.array_contains("block_types", "table")
    found = _each(
        chunks,
        [
            ("empty_chunk", "chunk_id", ~some),
            ("chunk_over_budget", "chunk_id", some & (F.length(text) > budget), F.length(text)),
            ("chunk_without_content", "chunk_id", some & (F.length(body) < SHORT_BODY), F.substring(text, 1, 70)),
            ("table_chunk_without_header", "chunk_id", some & table & F.contains(text, F.lit("|")) & ~text.rlike(TABLE_RULE)),
            ("chunk_without_source_file", "chunk_id", some & F.coalesce(F.col("source_file") == "", F.lit(True))),
            ("", "doc_id", some, F.sha2(strip(text), 256)),
        ],
    )
    # rows without a rule are texts; their digest is the detail until they are counted
    counted = found.groupBy("rule", "key", "detail").agg(F.count(F.lit(1)).alias("n"))
    same = F.when((F.col("rule") == "") & (F.col("n") > 1), F.array(F.struct(F.lit("duplicate_chunk").alias("rule"), "key", F.concat(F.lit("x"), F.col("n").cast("string")).alias("detail"))))
    rows = F.when(F.col("rule") == "", same).otherwise(F.array_repeat(F.struct("rule", "key", "detail"), F.col("n").cast("int")))
    return counted.select(F.explode(rows).alias("v")).select("v.rule", "v.key", "v.detail")


def findings(violations: DataFrame, samples: int = 3, salts: int = 64) -> DataFrame:
    """``rule, n, samples``: counts by rule with its first few details.

    A rule's rows are dealt over ``salts`` groups first, each of which passes
    on its own first details, so that a rule broken everywhere isn't sorted by
    one task.
    """
    salted = violations.withColumn("_salt", F.pmod(F.xxhash64("key", "detail"), F.lit(salts)))
    within = Window.partitionBy("rule", "_salt").orderBy("key", "detail")
    distinct = salted.groupBy("rule", "_salt", "key", "detail").agg(F.count(F.lit(1)).alias("k")).withColumn("_nth", F.row_number().over(within))
    first = F.when(F.col("_nth") <= samples, F.struct("key", "detail"))
    parts = distinct.groupBy("rule", "_salt").agg(F.sum("k").alias("n"), F.collect_list(first).alias("f"))
    whole = parts.groupBy("rule").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("f"))), 1, samples).alias("f"))
    return whole.select("rule", "n", F.sort_array(F.filter(F.transform("f", lambda x: x["detail"]), lambda d: d.isNotNull())).alias("samples"))


def coverage(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, sentence, covered``: is a source sentence in its document's chunks or their contexts?

    Sentences of a document meet its chunks as one row.  They mostly come in
    the order of the chunks, so each is looked for after the last one found
    first; searching all from the start takes the square of a text's length.
    """
    keyed = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.struct("chunk_index", F.pandas_udf(_keys, "string")("text", "context").alias("t")).alias("c"))
    whole = keyed.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["t"]), "").alias("all"))
    s = sentences.select(F.col("doc_id").cast("string").alias("doc_id"), "sentence")
    both = s.groupBy("doc_id").agg(F.collect_list(F.struct("sentence")).alias("s")).join(whole, "doc_id", "left")
    found = F.arrays_zip(F.col("s.sentence").alias("sentence"), F.pandas_udf(_held, "array<boolean>")("all", "s.sentence").alias("covered"))
    return both.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.sentence", "f.covered")


_OTHER = re.compile("[^0-9a-zа-яё]+")  # what alphanumeric_key leaves out


def _key(text: str) -> str:
    return _OTHER.sub("", text.lower())


def _keys(texts: pd.Series, contexts: pd.Series) -> pd.Series:
    """``alphanumeric_key`` of chunks and their contexts; Java's classes of Cyrillic are much slower than Python's."""
    return pd.Series(["".join(_key(x) for x in pair if x is not None) for pair in zip(texts, contexts, strict=True)], dtype=object)


def _held(wholes: pd.Series, sentences: pd.Series) -> pd.Series:
    """Which sentences' keys are in a text."""

    def one(whole: str | None, ss) -> list[bool]:
        out, at = [], 0
        for s in ss:
            key = None if s is None else _key(s)
            n = -1 if whole is None or key is None else whole.find(key, at)
            if n < 0 and at and key is not None:
                n = whole.find(key, 0, at + len(key))
            at = n if n >= 0 else at
            out.append(n >= 0)
        return out

    return pd.Series([one(w, ss) for w, ss in zip(wholes, sentences, strict=True)], dtype=object)


def word_recall(reference: Column, found: Column) -> Column:
    """Share of the reference's distinct words that occur in a text."""
    want = F.array_distinct(tokens(reference))
    return F.try_divide(F.size(F.array_intersect(want, tokens(found))).cast("double"), F.size(want))


def retrieval_metrics(references: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: best and joint word recall, hits at 0.5 and 0.7, whether its document was found.

    ``references``: query_id, reference, source_file; ``hits``: query_id, text, source_file.
    """
    both = references.join(hits.select("query_id", "text", F.col("source_file").alias("_found")), "query_id", "left")
    texts = F.concat_ws(" ", F.collect_list("text"))
    per = both.groupBy("query_id", "reference").agg(F.coalesce(F.max(word_recall(F.col("reference"), F.col("text"))), F.lit(0.0)).alias("recall_best"), texts.alias("_all"), F.coalesce(F.bool_or(F.col("_found") == F.col("source_file")), F.lit(False)).alias("doc_hit"))
    return per.select("query_id", "recall_best", F.coalesce(word_recall(F.col("reference"), F.col("_all")), F.lit(0.0)).alias("recall_union"), (F.col("recall_best") >= 0.5).alias("hit_50"), (F.col("recall_best") >= 0.7).alias("hit_70"), "doc_hit")


def character_error_rate(reference: Column, found: Column) -> Column:
    return F.try_divide(F.levenshtein(reference, found).cast("double"), F.length(reference))


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """``query_id, faithfulness``: share of statements (query_id, supported) that are supported."""
    return verdicts.groupBy("query_id").agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"))


def correctness(verdicts: DataFrame) -> DataFrame:
    """``query_id, correctness``: tp / (tp + fn) of classified facts (query_id, kind)."""
    tp, fn = F.count_if(F.col("kind") == "tp"), F.count_if(F.col("kind") == "fn")
    return verdicts.groupBy("query_id").agg(F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0)).alias("correctness"))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """``query_id, precision``: average precision over passages (query_id, rank, useful)."""
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    useful = F.col("useful").cast("int")
    v = verdicts.withColumn("_p", F.sum(useful).over(so_far) / F.count(F.lit(1)).over(so_far))
    return v.groupBy("query_id").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("useful"), F.col("_p"))), F.sum(useful)), F.lit(0.0)).alias("precision"))


def trace_tree(traces: DataFrame) -> DataFrame:
    """Runs, rows, metrics and prompts (id, parent_id, name, payload) on one line each."""
    level = lambda n: traces.select(F.col("id").alias(f"id{n}"), F.col("parent_id").alias(f"up{n}"), F.col("name").alias(f"name{n}"), F.col("payload").alias(f"payload{n}"))
    t = level(0).where("up0 is null")
    for n in (1, 2, 3):
        t = t.join(level(n), F.col(f"up{n}") == F.col(f"id{n - 1}"))
    return t.select(F.col("id0").alias("run_id"), F.col("name1").alias("row"), F.col("name2").alias("metric"), F.col("name3").alias("prompt"), F.col("payload3").alias("payload"))


def topic_boundaries(sentences: DataFrame, percentile: float = 0.25) -> DataFrame:
    """Adds ``cut`` to sentences (doc_id, ord, vector): neighbours at or below the percentile of similarity."""
    from ..functions.vectors import cosine

    order = Window.partitionBy("doc_id").orderBy("ord")
    s = sentences.withColumn("_sim", cosine(F.col("vector"), F.lag("vector").over(order)))
    low = s.groupBy("doc_id").agg(F.expr(f"percentile(_sim, {percentile})").alias("_low"), F.count(F.lit(1)).alias("_n"))
    return s.join(low, "doc_id").withColumn("cut", F.coalesce((F.col("_sim") <= F.col("_low")) & (F.col("_n") >= 12), F.lit(False))).drop("_sim", "_low", "_n")
