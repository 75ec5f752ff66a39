"""Steps whose cost must grow no faster than their input, and results at odd places."""

import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import numbers, text
from lexiloom.operators import blocks, evaluation
from lexiloom.plans import catalogue


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_of_two_abbreviations_the_second_may_end_a_sentence(spark):
    """As in the query's SQL, where a blank belongs to one abbreviation only."""
    rows = spark.createDataFrame([("la no. No. El fin no. Si",), ("e.g. A b. С",)], "c string")
    assert [r[0] for r in rows.select(text.sentences(F.col("c"), chained=False)).collect()] == [["la no. No.", "El fin no. Si"], ["e.g. A b.", "С"]]
    assert rows.select(text.sentences(F.col("c"))).first()[0] == ["la no. No. El fin no. Si"]


def test_the_query_of_sentences_says_what_its_sql_says(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "la no. No. El fin no. Si"), (2, "См. рис. 5. Далее"), (3, "no. No. no. No. A")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(catalogue.oracle_sql()["sentences"]).fetchall()
    assert sorted(tuple(r) for r in catalogue.queries()["sentences"](spark, str(tmp_path)).collect()) == sorted(want)


def test_long_tables_are_drawn_in_time_that_grows_with_their_rows(spark):
    """1,500 rows took longer than 100 seconds: each row asked all others which columns are empty."""
    rows = spark.range(1500).select(F.array(F.col("id").cast("string"), F.lit(""), F.lit("x")).alias("r")).groupBy().agg(F.sort_array(F.collect_list("r")).alias("g"))
    start = time.time()
    got = rows.select(numbers.table_to_markdown(F.col("g")).alias("m")).select("m", blocks.is_degenerate_table(F.col("m")).alias("d"), F.size(numbers.markdown_rows(F.col("m"))).alias("n")).first()
    assert time.time() - start < 60
    assert got.m.split("\n")[:3] == ["| 0 | x |", "| --- | --- |", "| 1 | x |"] and not got.d and got.n == 1500
    none = spark.createDataFrame([(None,), ([],), ([["", ""]],), ([["a"], ["", "b"], [None]],)], "g array<array<string>>")
    assert [r[0] for r in none.select(numbers.table_to_markdown(F.col("g"))).collect()] == ["", "", "", "| a |  |\n| --- | --- |\n|  | b |"]
    assert none.select(numbers.table_to_markdown(F.col("g"), header=False)).collect()[3][0] == "| col1 | col2 |\n| --- | --- |\n| a |  |\n|  | b |"


def test_a_transcript_is_stripped_once(spark):
    d = spark.createDataFrame([("x",)], "t string")
    page = optimised(d.select(blocks.check_page_transcript(F.col("t"), F.lit(0.02), F.lit(10)).alias("v")))
    assert page.count("\\n?```") == 1
    formula = optimised(d.select(blocks.check_formula_transcript(F.col("t"), F.lit("formula")).alias("v")))
    assert formula.count("coalesce(t#") == 1


@pytest.mark.parametrize("name", ["chunk_audit", "block_audit", "coverage"])
def test_texts_are_parsed_once(spark, name):
    """Every rule parsed all texts again."""
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["chunk_pages", "legacy_chunks"])
def test_pages_are_chunked_where_they_lie(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "hashpartitioning" not in plan


def test_chunks_of_pages_are_those_of_their_blocks(spark):
    from lexiloom.operators import chunking
    from lexiloom.sources import files

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame([(-1, "u", None), (-2, None, ""), (-3, "u", "<p>x y")], "page_id long, url string, html string"))
    parsed = files.text_blocks(pages, "page_id", "html", "url", "html")
    for strategy in ("structured", "legacy"):
        want = sorted(map(str, chunking.chunk_documents(parsed, strategy=strategy).collect()))
        assert sorted(map(str, chunking.chunk_texts(pages, "page_id", "html", "url", "html", strategy=strategy).collect())) == want


def test_sentences_out_of_order_are_found(spark):
    chunks = spark.createDataFrame([("d", 2, "Gamma delta.", None), ("d", 1, "Alpha", "beta Ёж"), ("e", 1, None, "x")], "doc_id string, chunk_index int, text string, context string")
    asked = [("d", "GAMMA"), ("d", "alpha beta"), ("d", "ёж, gamma"), ("d", "delta alpha"), ("d", None), ("d", "..."), ("f", "alpha"), ("e", "X")]
    found = evaluation.coverage(spark.createDataFrame(asked, "doc_id string, sentence string"), chunks).collect()
    assert {(r.doc_id, r.sentence): r.covered for r in found} == {a: a not in (("d", "delta alpha"), ("d", None), ("f", "alpha")) for a in asked}


def test_equal_chunks_are_counted_and_findings_repeat(spark):
    rows = [("d", "c1", "same words in this chunk", "f"), ("d", "c1", "tiny", ""), ("d", "c1", " same words in this chunk ", "f"), ("d", "c1", "tiny", ""), ("e", "c9", "same words in this chunk", "f")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, source_file string").withColumn("heading_path", F.array().cast("array<string>")).withColumn("block_types", F.array(F.lit("text")))
    got = sorted(tuple(r) for r in evaluation.chunk_audit(chunks, 100).collect())
    assert got == [("chunk_without_content", "c1", "tiny")] * 2 + [("chunk_without_source_file", "c1", "")] * 2 + [("duplicate_chunk", "d", "x2")] * 2
