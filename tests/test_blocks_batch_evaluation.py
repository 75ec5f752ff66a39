import pytest
from pyspark.sql import functions as F

from lexiloom.operators import batch, blocks, evaluation
from lexiloom.sources import sinks
from lexiloom.streaming.ingest import chunk_stream

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_two_columns(spark):
    rows = [(1, n, 1, ((n % 2) * 300.0, n // 2 * 50.0, (n % 2) * 300.0 + 250, n // 2 * 50.0 + 40)) for n in range(8)]
    rows += [(2, n, 1, (0.0, n * 50.0, 500.0, n * 50.0 + 40)) for n in range(8)] + [(3, 0, 1, None)] + [(3, n, 1, ((n % 2) * 300.0, n * 9.0, 250.0, 9.0)) for n in range(1, 8)]
    df = spark.createDataFrame(rows, f"doc_id int, ord int, page_number int, bbox {BOX}")
    out = blocks.reorder_columns(df).orderBy("doc_id", "reading_ord").collect()
    assert [r.ord for r in out if r.doc_id == 1] == [0, 2, 4, 6, 1, 3, 5, 7]
    assert [r.ord for r in out if r.doc_id == 2] == list(range(8)) and [r.ord for r in out if r.doc_id == 3] == list(range(8))


def test_merge_and_titles(spark):
    rows = [(1, 0, "heading", "Contents", 1, None, None), (1, 1, "heading", "Real title", 1, None, None), (1, 2, "list", "a", 1, None, "g"), (1, 3, "list", "b", 1, None, "g"), (1, 4, "text", "see (", 1, None, "i"), (1, 5, "text", "x", 1, None, "i"), (1, 6, "text", ").", 1, None, "i"), (1, 7, "text", "alone", 1, None, None)]
    df = spark.createDataFrame(rows, f"doc_id int, ord int, type string, text string, page_number int, bbox {BOX}, group_id string")
    out = blocks.merge_adjacent(df).orderBy("ord").collect()
    assert [r.text for r in out] == ["Contents", "Real title", "- a\n- b", "see (x).", "alone"]
    cut = spark.createDataFrame([(1, 0, "heading", "Models (group", 1, None, None), (1, 1, "heading", "states) of", 1, None, None), (1, 2, "heading", "Matter", 1, None, None), (1, 3, "heading", "Next", 1, None, None)], df.schema)
    assert [r.text for r in blocks.merge_adjacent(cut).orderBy("ord").collect()] == ["Models (group states) of Matter", "Next"]
    assert blocks.document_titles(df).first().title == "Real title"
    assert blocks.heading_titles(df).first().title == "Contents"
    assert blocks.stamp_blocks(df.withColumn("has_image", F.lit(False))).orderBy("ord").first().block_id == "block-1"
    assert blocks.to_markdown(df.withColumn("level", F.lit(2))).first().markdown.startswith("## Contents\n\n## Real title")


@pytest.mark.parametrize(
    "text,ink,lines,want",
    [
        ("", 0.5, 3, (False, "empty_on_inked_page")), ("[no text]", 0.0, 3, (True, "")), ("I cannot read this", 0.1, 3, (False, "refusal")), ("same\n" * 5, 0.1, 3, (False, "repetition_loop")),
        ("日本語テキスト", 0.1, 3, (False, "foreign_script")), ("short", 0.1, 20, (False, "short_transcript")), ("good text here", 0.1, 3, (True, "")),
    ],
)
def test_page_transcripts(spark, text, ink, lines, want):
    r = spark.range(1).select(blocks.check_page_transcript(F.lit(text), F.lit(ink), F.lit(lines)).alias("c")).first().c
    assert (r.ok, r.reason) == want and r.retryable == (want[1] == "short_transcript")


@pytest.mark.parametrize(
    "text,want",
    [("", (False, "empty")), ("The image shows", (False, "prose")), ("x = {y", (True, "unbalanced")), ("{" * 9, (False, "unbalanced")), ("x + y = z", (True, "")), ("abcdefgh ijklmnop qrstu " * 9, (False, "loop")), (" ".join("abcdefghijklmnop"[i : i + 3] for i in range(14)), (False, "not_a_formula")), ("a=b " * 600, (False, "too_long"))],
)
def test_formula_transcripts(spark, text, want):
    r = spark.range(1).select(blocks.check_formula_transcript(F.lit(text), F.lit("formula")).alias("c")).first().c
    assert (r.ok, r.reason) == want


def test_tables_and_figures(spark):
    good, bad = "| a | b |\n| --- | --- |\n| 1 | 2 |", "| a |\n| --- |\n| 1 |"
    f = lambda e: spark.range(1).select(e).first()[0]
    assert not f(blocks.is_degenerate_table(F.lit(good))) and f(blocks.is_degenerate_table(F.lit(bad))) and f(blocks.is_degenerate_table(F.lit("")))
    assert f(blocks.is_degenerate_table(F.lit("| a | b |\n| --- | --- |\n| 1 | |\n| | 2 |\n| | 3 |"))) is False
    assert f(blocks.is_better_table(F.lit(bad), F.lit(good))) and not f(blocks.is_better_table(F.lit(good), F.lit(bad)))
    figures = spark.createDataFrame([(1, n, "figure", (0.0, 0.0, float(n), 1.0)) for n in range(50)], f"doc_id int, ord int, type string, bbox {BOX}")
    pages = spark.createDataFrame([(1, 60)], "doc_id int, total_pages int")
    assert sorted(r.ord for r in blocks.figures_to_describe(figures, pages).collect()) == list(range(35, 50))


def test_ocr(spark):
    pages = spark.createDataFrame([(1, 1, 5, 1, 0.1), (1, 2, 90, 0, 0.5), (1, 3, 500, 3, 0.9), (2, 1, 500, 0, 0.0)], "doc_id int, page_number int, char_count int, image_count int, image_area_ratio double")
    out = {r.doc_id: r for r in blocks.ocr_policy(blocks.ocr_routing(pages)).collect()}
    assert out[1].ocr_pages == [1, 2] and out[1].full_scan and out[1].use_ocr and not out[2].any_ocr
    b = spark.createDataFrame([(1, 0, 1, "old"), (1, 1, 2, "keep")], "doc_id int, ord int, page_number int, text string")
    t = spark.createDataFrame([(1, 0, 1, "new")], "doc_id int, ord int, page_number int, text string")
    assert [r.text for r in blocks.merge_transcripts(b, t).orderBy("ord").collect()] == ["new", "keep"]


def test_question_rules(spark):
    rows = [(0, "a", "q", "x", ["d/1"]), (1, "a", " ", "x", []), (2, "b", "q", None, ["../x"])]
    df = spark.createDataFrame(rows, "row_index int, id string, question string, answer string, doc_ids array<string>")
    got = sorted((r.rule, r.key) for r in batch.question_violations(df).collect())
    assert got == [("blank_answer", "2"), ("blank_question", "1"), ("duplicate_id", "a"), ("empty_doc_ids", "1"), ("unsafe_path", "2")]
    with pytest.raises(ValueError, match="blank_answer"):
        batch.check(batch.question_violations(df))
    with pytest.raises(ValueError, match="missing"):
        batch.question_violations(df.drop("answer"))
    ctx = spark.createDataFrame([(1, [(1, "c", "d", "t", "{}")]), (2, [(2, "c", "d", " ", "[]")])], "query_id int, contexts array<struct<rank:int,chunk_id:string,document_id:string,text:string,metadata_json:string>>")
    assert sorted((r.rule, r.key) for r in batch.context_violations(ctx).collect()) == [("blank_context_field", "2"), ("context_ranks", "2"), ("metadata_not_object", "2")]


def test_resume(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "row_index int")
    done = spark.createDataFrame([(1, "p"), (9, "p")], "row_index int, parameters string")
    assert sorted(r.row_index for r in batch.pending(q, done, "p").collect()) == [0, 2, 3]
    assert [r.row_index for r in batch.stray_checkpoints(q, done).collect()] == [9]
    with pytest.raises(ValueError):
        batch.pending(q, done, "other")
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "row_index int, v string")
    b = spark.createDataFrame([(0, "x"), (1, "z"), (3, "w")], "row_index int, v string")
    assert sorted((r.row_index, r.column) for r in batch.mismatches(a, b, ["v"]).collect()) == [(1, "v"), (2, "row"), (3, "row")]
    assert batch.totals(spark.createDataFrame([("ok",), ("[PIPELINE_ERROR] x",)], "answer string")).first() == (2, 1, 1)


def test_reports(spark):
    df = spark.createDataFrame([(0.5, "no data"), (1.0, "fine"), (None, None)], "m double, answer string")
    r = evaluation.metric_report(df, ["m"], "NO DATA").first()
    assert (r.n_examples, r.n_negative, r["mean"], r["median"], r["min"], r["max"], r.mean_on_negative) == (3, 1, 0.75, 0.75, 0.5, 1.0, 0.5)
    cost = evaluation.usage_cost(spark.createDataFrame([("m", 2000, 500, 1000)], "model string, input_tokens int, cached_tokens int, output_tokens int"), ["model"]).first().cost
    assert cost == pytest.approx(1.5 * 0.3 + 0.5 * 0.5 + 0.075)
    v = spark.createDataFrame([("q", 1, True), ("q", 2, False), ("q", 3, True)], "query_id string, rank int, useful boolean")
    assert evaluation.context_precision(v).first().precision == pytest.approx((1 + 2 / 3) / 2)
    k = spark.createDataFrame([("q", "tp"), ("q", "fn"), ("q", "fp")], "query_id string, kind string")
    assert evaluation.correctness(k).first().correctness == 0.5


def test_audits_and_coverage(spark):
    chunks = spark.createDataFrame([("d", 1, "c1", "One two three four five six.", None, "f", [], ["text"]), ("d", 2, "c2", "tiny", None, "", [], ["text"]), ("d", 3, "c3", "", None, "f", [], ["text"])], "doc_id string, chunk_index int, chunk_id string, text string, context string, source_file string, heading_path array<string>, block_types array<string>")
    got = {(r.rule, r.key) for r in evaluation.chunk_audit(chunks, 20).collect()}
    assert got == {("empty_chunk", "c3"), ("chunk_over_budget", "c1"), ("chunk_without_content", "c2"), ("chunk_without_source_file", "c2")}
    s = spark.createDataFrame([("d", "one, TWO three four five six"), ("d", "missing words here"), ("e", "x")], "doc_id string, sentence string")
    assert sorted((r.sentence[:3], r.covered) for r in evaluation.coverage(s, chunks).collect()) == [("mis", False), ("one", True), ("x", False)]
    f = {r.rule: r.n for r in evaluation.findings(evaluation.chunk_audit(chunks, 20)).collect()}
    assert f["empty_chunk"] == 1
    h = spark.createDataFrame([(1, "one two", "f"), (1, "three", "g")], "query_id int, text string, source_file string")
    ref = spark.createDataFrame([(1, "one two three four", "f")], "query_id int, reference string, source_file string")
    r = evaluation.retrieval_metrics(ref, h).first()
    assert (r.recall_best, r.recall_union, r.hit_50, r.hit_70, r.doc_hit) == (0.5, 0.75, True, False, True)


def test_sinks_and_stream(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", "beta")], "chunk_id string, text string")
    sinks.write_index(chunks, str(tmp_path / "index"))
    stored, posts, terms = sinks.read_index(spark, str(tmp_path / "index"))
    assert stored.count() == 2 and posts.count() == 3 and {r.term: r.df for r in terms.collect()} == {"alpha": 1, "beta": 2}
    docs = spark.createDataFrame([(1, "Hello streaming world.", "s")], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    q = chunk_stream(spark, str(tmp_path / "in"), "doc_id long, text string, source string", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Hello streaming world."]
    a = spark.createDataFrame([("1", "q", "a", ["d"], "m", [])], sinks.ANSWER_SCHEMA)
    sinks.write_answers(a, str(tmp_path / "answers"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_answers(a, str(tmp_path / "answers"))
