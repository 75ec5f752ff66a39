import pytest
from pyspark.sql import functions as F

from lexiloom.functions import numbers, text, vectors


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_clean_text(spark):
    assert values(spark, text.clean_text, ["a \t b\r\n  c\x07 \n", " \xa0\xa0x", "", None]) == ["a b\nc", "x", "", None]


def test_bullets_and_headings(spark):
    assert values(spark, text.strip_bullet, ["• item", "  - x", "o y", "only"]) == ["item", "x", "y", "only"]
    assert values(spark, lambda c: text.heading_level(c, 9), ["1.2.3 Scope", "1. Intro", "Глава 2", "Chapter 3", "IV. Results", "1.2.3.4.5.6.7 x", "plain"]) == [3, 1, 1, 1, 1, 6, 9]
    assert values(spark, text.looks_like_heading, ["A title:", "A sentence.", "two\nlines", "x" * 121, " ".join("w" * 17), "ok", ""]) == [True, False, False, False, False, True, False]
    assert values(spark, text.clamped_level, ["3", "9", "-1", "x", None]) == [3, 6, 1, 1, 1]


def test_search_tokens(spark):
    assert values(spark, text.normalize_for_search, ["Ёлка 3.14 it's re-do, A_b", "1,000.5 x"]) == ["елка 3.14 it's re-do a_b", "1,000.5 x"]
    assert values(spark, text.comparison_key, ["  Hello,_World! "]) == ["hello world"]
    assert values(spark, text.alphanumeric_key, ["Ab-1 ё!"]) == ["ab1ё"]


def test_sentences(spark):
    assert values(spark, text.sentences, ["One, e.g. this. Two! then same? Three…\nFour"]) == [["One, e.g. this.", "Two! then same?", "Three…", "Four"]]
    assert values(spark, text.sentences, ["См. рис. 5. Далее"]) == [["См. рис. 5.", "Далее"]]


def test_repair_and_paths(spark):
    assert values(spark, text.repair_hyphenation, ["обыкновен- ных при- виле- гий", "well-known", "so­ft"]) == ["обыкновенных привилегий", "well-known", "soft"]
    assert values(spark, text.safe_relative_path, ["a/b.txt", "/a", "a/../b", "a//b", "a\\b", ".", "", None]) == [True] + [False] * 7


def test_variants_and_phrases(spark):
    raw = "Here are some:\n1. What is X?\n- \"what is x\"\n2) Define X\nthe question\n" + "y" * 700
    assert values(spark, lambda c: text.parse_variants(c, F.lit("The question?"), 5), [raw]) == [["What is X?", "Define X"]]
    assert values(spark, text.quoted_phrases, ['say «Big Red» and "one" or "two words"']) == [["big red", "two words"]]
    assert values(spark, text.without_quotes, ['find "two words" now']) == ["find   now"]


def test_transcripts(spark):
    good = "\n".join(f"[00:{i:02d}] words" for i in range(12))
    assert values(spark, text.is_transcript, [good, "a\nb", good[:20]]) == [True, False, False]
    assert values(spark, text.strip_fences, ["```md\n| a |\n```", "plain"]) == ["| a |", "plain"]


def test_numbers(spark):
    assert values(spark, numbers.parse_number, ["1 234,5", "1,000.5", "x", "", "-3", "1_0", "nan"]) == [1234.5, None, None, None, -3.0, None, None]
    assert values(spark, numbers.grouped, [1234567.0, 12.5], "double") == ["1 234 567", "12.50"]
    assert values(spark, lambda c: numbers.format_cell(c, "double"), [3.0, 0.25, 1234567.5, 0.00001234, None], "double") == ["3", "0.25", "1.23457e+06", "1.234e-05", ""]
    assert values(spark, numbers.looks_like_date, ["2024-01-02", "1.2.2024", "abc"]) == [True, True, False]


def test_tables(spark):
    rows = [[["a", "b", ""], ["1", "2"], ["", ""], ["3", "", None]]]
    md = values(spark, numbers.table_to_markdown, rows, "array<array<string>>")[0]
    assert md == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |"
    assert values(spark, lambda c: numbers.table_to_markdown(c, False), [[["1", "2"]]], "array<array<string>>") == ["| col1 | col2 |\n| --- | --- |\n| 1 | 2 |"]
    assert values(spark, numbers.markdown_rows, [md]) == [[["a", "b"], ["1", "2"], ["3", ""]]]
    items = [[(0, "x", True), (1, "y", False), (0, "1. z", True), (0, "w", True)]]
    assert values(spark, numbers.list_to_markdown, items, "array<struct<indent:int,text:string,ordered:boolean>>") == ["1. x\n  - y\n1. z\n4. w"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_search_text_is_composed(spark):
    import unicodedata

    words = ["été", "Ёлка", "йод", "Việt", "naïve", "Ångström", "ώρα", "plain", "日本"]
    rows = [(unicodedata.normalize(form, w),) for w in words for form in ("NFC", "NFD")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.normalize_for_search(F.col("t"))).collect()]
    assert got[0::2] == got[1::2] and got[0] == "été" and got[2] == "елка" and all(unicodedata.is_normalized("NFC", w) for w in got)
