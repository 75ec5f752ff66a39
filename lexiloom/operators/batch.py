"""Batch runs over question sets: validation, resume, failures, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_relative_path
from .answers import ERROR_MARK


def _found(df: DataFrame, rule: str, key: str, when, detail=None) -> DataFrame:
    return df.where(when).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def _each(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """``rule, key, detail`` of rows that break rules (rule, key, when, detail or nothing); ``df`` is computed once for all."""
    found = lambda rule, key, when, detail=None: F.when(when, F.struct(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail")))
    return df.select(F.explode(F.array_compact(F.array(*(found(*r) for r in rules)))).alias("v")).select("v.rule", "v.key", "v.detail")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def question_violations(questions: DataFrame, key: str = "row_index") -> DataFrame:
    """``rule, key, detail`` of what is wrong with a question set."""
    require_columns(questions, ["id", "question", "answer", "doc_ids"])
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    ids = questions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null")
    unsafe = F.exists("doc_ids", lambda p: ~F.coalesce(safe_relative_path(p), F.lit(False)))
    return _union(
        [_found(questions, f"blank_{c}", key, blank(c)) for c in ("id", "question", "answer")]
        + [
            _found(questions, "empty_doc_ids", key, F.coalesce(F.size("doc_ids") <= 0, F.lit(True))),
            _found(questions, "unsafe_path", key, F.coalesce(unsafe, F.lit(False)), F.array_join("doc_ids", ",")),
            ids.select(F.lit("duplicate_id").alias("rule"), F.col("id").cast("string").alias("key"), F.col("n").cast("string").alias("detail")),
        ]
    )


def run_violations(run: DataFrame) -> DataFrame:
    """``rule, key, detail`` of a run file: ids, answers and contexts."""
    require_columns(run, ["id", "question", "answer_model", "contexts", "answer"])
    ids = run.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null")
    return _union(
        [
            _found(run, "null_id", "id", F.col("id").isNull()),
            _found(run, "null_contexts", "id", F.col("contexts").isNull()),
            _found(run, "empty_answer", "id", F.coalesce(F.trim("answer_model") == "", F.lit(True))),
            ids.select(F.lit("duplicate_id").alias("rule"), F.col("id").cast("string").alias("key"), F.col("n").cast("string").alias("detail")),
        ]
    )


def context_violations(answers: DataFrame) -> DataFrame:
    """Ranks must be 1..n, texts not blank and metadata a JSON object."""
    ranks = F.transform("contexts", lambda c: c["rank"])
    blank = F.exists("contexts", lambda c: (F.trim(c["chunk_id"]) == "") | (F.trim(c["text"]) == "") | (F.trim(c["document_id"]) == ""))
    broken = F.exists("contexts", lambda c: F.json_object_keys(c["metadata_json"]).isNull())
    some = F.size("contexts") > 0
    return _union(
        [
            _found(answers, "context_ranks", "query_id", some & (ranks != F.sequence(F.lit(1), F.greatest(F.size("contexts"), F.lit(1))))),
            _found(answers, "blank_context_field", "query_id", some & blank),
            _found(answers, "metadata_not_object", "query_id", some & broken),
        ]
    )


def check(violations: DataFrame) -> None:
    """Raise with the first few violations, if there are any."""
    if found := violations.orderBy("rule", "key").limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: row {r.key} {r.detail}".strip() for r in found))


def pending(questions: DataFrame, done: DataFrame, parameters: str) -> DataFrame:
    """Rows without a checkpoint; a checkpoint made with other parameters is an error."""
    other = done.join(questions.select("row_index"), "row_index", "left_semi").where(F.col("parameters") != parameters)
    if (row := other.orderBy("row_index").first()) is not None:
        raise ValueError(f"checkpoint of row {row['row_index']} was made with other parameters")
    return questions.join(done, "row_index", "left_anti")


def stray_checkpoints(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Checkpoints of rows that the question set doesn't have."""
    return done.join(questions, "row_index", "left_anti")


def first_rows(questions: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by number."""
    return questions if n is None else questions.where(F.col("row_index") < n)


def mismatches(source: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """``row_index, column`` wherever a result doesn't repeat its source, rows missing on either side included."""
    both = source.select("row_index", F.struct(*columns).alias("s")).join(results.select("row_index", F.struct(*columns).alias("r")), "row_index", "full")
    bad = F.array_compact(F.array(*(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns)))
    return both.select("row_index", F.explode(F.when(F.col("s").isNull() | F.col("r").isNull(), F.array(F.lit("row"))).otherwise(bad)).alias("column"))


def totals(results: DataFrame) -> DataFrame:
    """``total, failed, answered`` of a run."""
    failed = F.col("answer").startswith(ERROR_MARK)
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), F.count_if(~failed).alias("answered"))


def dataset_fingerprint(questions: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """``sha256`` of a question set in row order.

    Each row is its canonical JSON and a line feed.  Lines are digested in
    blocks of ``block_rows`` by ``row_index``, and the blocks' hexadecimal
    digests, joined, once more: one definition at every size, and no task holds
    the whole set.
    """
    line = F.concat(F.to_json(F.struct("answer", "doc_ids", "id", "question")), F.lit("\n"))
    blocks = questions.select(F.floor(F.col("row_index") / block_rows).alias("b"), F.struct("row_index", line.alias("j")).alias("r"))
    digests = blocks.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["j"]), ""), 256).alias("d"))
    both = digests.agg(F.sort_array(F.collect_list(F.struct("b", "d"))).alias("all"))
    return both.select(F.sha2(F.array_join(F.transform("all", lambda x: x["d"]), ""), 256).alias("sha256"))


def positions(records: DataFrame) -> DataFrame:
    """Records' documents by position: ``id, pos, doc_id``."""
    return records.select("id", F.posexplode("doc_ids").alias("pos", "doc_id"))


def adjacent_duplicates(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Rows that repeat the one before them."""
    w = Window.partitionBy(group).orderBy(order)
    same = F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w))
    return rows.withColumn("_same", same).where("_same").drop("_same")


def upload_fingerprint(files: DataFrame) -> DataFrame:
    """``sha256`` over names and contents of files (ord, name, content) in order."""
    each = F.struct("ord", F.sha2(F.concat(F.encode("name", "utf-8"), F.lit(b"\x00"), F.col("content")), 256).alias("d"))
    return files.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["d"]), ""), 256).alias("sha256"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn by a hash of their key: the same rows at every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)
