import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import batch, blocks, vision
from lexiloom.sources import files, pdf


class Reader:
    def read(self, content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"label": "page_header", "text": "h", "page_number": 1}, {"label": "section_header", "text": "Title", "level": 1, "page_number": 1}, {"label": "list_item", "text": "a", "page_number": 1, "group_id": "g"}, {"label": "list_item", "text": "b", "page_number": 1, "group_id": "g"}]


class Plain:
    def read(self, content):
        return [{"text": "fallback", "page_number": 1}]


def test_pdf(spark):
    df = spark.createDataFrame([("1", "a.pdf", b"good"), ("2", "b.pdf", b"bad")], "doc_id string, source_file string, content binary")
    items = pdf.read_items(df, Reader(), Plain())
    assert [(r.type, r.text, r.block_id) for r in pdf.blocks_from_items(items).orderBy("doc_id", "ord").collect()] == [("heading", "Title", "block-1"), ("list", "- a\n- b", "block-2"), ("text", "fallback", "block-1")]
    assert [r.text for r in pdf.flat_pages(items).orderBy("doc_id").collect()] == ["h\nTitle\na\nb", "fallback"]
    with pytest.raises(Exception, match="broken"):
        pdf.read_items(df, Reader()).collect()


class Eye:
    def describe_image(self, image, prompt):
        if image == b"x":
            raise RuntimeError("blind")
        return image.decode() * 3


def test_vision(spark):
    rows = [(1, 1, "formula", b"a+b=c "), (1, 2, "formula", b"a+b=c "), (1, 3, "formula", b"x"), (1, 4, "formula", None)]
    regions = spark.createDataFrame(rows, "doc_id int, ord int, kind string, image binary")
    cache = spark.createDataFrame([], "key string, transcript string")
    found, fresh = vision.enrich_formulas(regions, cache, Eye(), "read")
    assert sorted(r.ord for r in found.collect()) == [1, 2] and fresh.count() == 1
    pages = spark.createDataFrame([(1, 1, b"text of a page. ", 0.1, 2), (1, 2, b"x", 0.1, 2)], "doc_id int, page_number int, image binary, ink double, text_lines int")
    out = {r.page_number: r.engine for r in vision.transcribe_pages(pages, Eye(), "read").collect()}
    assert out == {1: "model", 2: "empty_on_inked_page"}
    assert {r.engine: r.n for r in vision.outcome_counts(vision.transcribe_pages(pages, Eye(), "read", Eye())).collect()} == {"model": 1, "local": 1}
    page = np.full((40, 50), 255)
    page[5:8], page[20:22] = 0, 0
    assert vision.ink_ratio(page) == pytest.approx(5 / 40) and vision.text_line_count(page) == 2
    boxes = spark.createDataFrame([(1, 1, 21, 5, "c"), (1, 1, 1, 90, "b"), (1, 1, 3, 2, "a")], "doc_id int, page_number int, top int, left int, text string")
    assert vision.ordered_detections(boxes).first().text == "a b c"


def test_small_ones(spark, tmp_path):
    spark.createDataFrame([("a", "q")], "id string, question string").write.json(str(tmp_path / "q"))
    assert files.read_questions(spark, str(tmp_path / "q")).first().row_index == 0
    f = spark.createDataFrame([(0, "n", b"1"), (1, "m", b"2")], "ord int, name string, content binary")
    assert batch.upload_fingerprint(f).first() == batch.upload_fingerprint(f.orderBy(F.desc("ord"))).first()
    assert batch.sampled(spark.range(100), "id", 5, 3).count() == 5
    df = spark.createDataFrame([(["cats", "run"], {"cats": "cat"})], "w array<string>, m map<string,string>")
    assert df.select(text.lemmatised(F.col("w"), F.col("m")).alias("x")).first().x == ["cat", "run"]
    b = spark.createDataFrame([(1, 0, "heading", "A", 1), (1, 1, "heading", "B", 2), (1, 2, "text", "t", None)], "doc_id int, ord int, type string, text string, level int")
    assert blocks.to_markdown(b, toc=True).first().markdown == "- A\n  - B\n\n# A\n\n## B\n\nt"
