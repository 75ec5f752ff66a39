import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import answers
from lexiloom.session import ChunkSettings, SearchSettings, settings_from
from lexiloom.sources import files, sinks


def test_settings_from_text():
    s = settings_from(SearchSettings, {"X_TOP_K": " 7 ", "X_MIN_COSINE": "0.5", "X_RERANK": "Yes", "X_DIVERSIFY": "no", "X_RRF_K": ""}, "X_")
    assert (s.top_k, s.min_cosine, s.rerank, s.diversify, s.rrf_k) == (7, 0.5, True, False, 60)
    with pytest.raises(ValueError, match="X_TOP_K"):
        settings_from(SearchSettings, {"X_TOP_K": "many"}, "X_")
    assert settings_from(SearchSettings, {"X_TOP_K": "many"}, "X_", lenient=True).top_k == 5
    assert settings_from(ChunkSettings, {"MAX_TOKENS": "40", "FORMULAS": "context"}) == ChunkSettings(max_tokens=40, formulas="context")


def test_documents_are_fetched_and_parsed_once(spark):
    stored = spark.createDataFrame([("d/caf\u00e9.txt", "Some text here."), ("d/b.md", "# Head\n\nbody")], "path string, content string")
    records = spark.createDataFrame([(1, ["d/cafe\u0301.txt", "d/b.md"]), (2, ["d/b.md"])], "id long, doc_ids array<string>")
    found = files.fetched(records, stored)
    assert sorted((r.id, r.pos, r.path) for r in found.collect()) == [(1, 0, "d/caf\u00e9.txt"), (1, 1, "d/b.md"), (2, 0, "d/b.md")]
    blocks = files.parsed_once(found, stored)
    assert sorted((r.id, r.source_file, r.type) for r in blocks.collect()) == [(1, "b.md", "heading"), (1, "b.md", "text"), (1, "caf\u00e9.txt", "text"), (2, "b.md", "heading"), (2, "b.md", "text")]
    with pytest.raises(Exception, match="no such document: d/x"):
        files.fetched(spark.createDataFrame([(1, ["d/x"])], records.schema), stored).collect()


def test_question_numbers_follow_the_file(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("q"), F.lit("x").alias("question")).coalesce(1).write.parquet(str(tmp_path / "q.parquet"))
    rows = files.read_questions(spark, str(tmp_path / "q.parquet")).collect()
    assert len(rows) == 500 and all(r.row_index == r.q for r in rows)
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"q": i}) + "\n" for i in range(50)))
    assert all(r.row_index == r.q for r in files.read_questions(spark, str(tmp_path / "q.jsonl")).collect())


def test_run_manifest(spark, tmp_path):
    q = spark.createDataFrame([(0, "a", "q?", "x", ["d"]), (1, "b", "r?", "y", ["e"])], "row_index long, id string, question string, answer string, doc_ids array<string>")
    results = spark.createDataFrame([("fine",), ("[PIPELINE_ERROR] ValueError: no",)], "answer string")
    sinks.write_run_manifest(spark, str(tmp_path / "m"), q, results, resumed=1, top_k=5, model="m")
    m = json.loads(next((tmp_path / "m").glob("*.json")).read_text())
    assert m["dataset"]["selected_rows"] == 2 and len(m["dataset"]["records_sha256"]) == 64
    assert m["result"] == {"total_count": 2, "processed_count": 1, "resumed_count": 1, "failed_count": 1}
    assert json.loads(m["generation"]) == {"model": "m", "top_k": "5"}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_run_manifest(spark, str(tmp_path / "m"), q, results)


def test_both_context_forms(spark):
    p = spark.createDataFrame([(1, 1, 0.5, "f.txt", "text one"), (1, 2, 0.25, None, "text two")], "query_id long, rank int, score double, source_file string, passage string")
    assert answers.contexts(p).first().context.startswith("[Источник 1 | source_file=f.txt]\ntext one\n\n[Источник 2 |")
    assert answers.contexts(p, "v1").first().context == "[Chunk 1 | score=0.5 | metadata: source_file=f.txt]\ntext one\n\n[Chunk 2 | score=0.25 | metadata: ]\ntext two"


def test_medians_are_exact(spark):
    import random
    from statistics import median

    from lexiloom.operators.evaluation import medians, metric_report

    rng = random.Random(5)
    sets = {"one": [3.0], "two": [1.0, 4.0], "even": [rng.random() for _ in range(20_000)], "odd": [float(rng.randrange(7)) for _ in range(20_001)], "ties": [2.0] * 500 + [9.0] * 500, "skew": [rng.expovariate(1) ** 5 for _ in range(3333)]}
    rows = [(m, x) for m, xs in sets.items() for x in xs] + [("one", None), ("none", None)]
    got = {r.metric: r.median for r in medians(spark.createDataFrame(rows, "metric string, v double").repartition(5)).collect()}
    assert got.keys() == sets.keys() and all(abs(got[m] - median(xs)) < 1e-12 for m, xs in sets.items())
    empty = metric_report(spark.createDataFrame([("x", None)], "answer string, m double"), ["m"]).first()
    assert metric_report(spark.createDataFrame([], "answer string, m double"), ["m"]).first().n_examples == 0
    assert empty.n_examples == 1 and empty.median is None and empty["mean"] is None
