import random

import pytest

from lexiloom.operators import chunking as c
from lexiloom.operators import sections, tables
from lexiloom.session import ChunkSettings


def block(n, text, kind="text", level=None):
    return c.Block(f"block-{n}", text, kind, level)


def stack_paths(levels):
    out, stack = [], []
    for n, lv in enumerate(levels):
        if lv is not None:
            while stack and stack[-1][0] >= lv:
                stack.pop()
            out.append(([t for _, t in stack], f"h{n}"))
            stack.append((lv, f"h{n}"))
        else:
            out.append(out[-1] if out else ([], None))
    return out


def test_section_paths_follow_the_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for d in range(40):
        levels = [rng.choice([None, 1, 2, 3, 4]) for _ in range(rng.randint(1, 25))]
        for n, lv in enumerate(levels):
            rows.append((d, n, "heading" if lv else "text", f"h{n}", lv))
        want |= {(d, n): p for n, p in enumerate(stack_paths(levels))}
    df = spark.createDataFrame(rows, "doc_id int, ord int, type string, text string, level int")
    got = {(r.doc_id, r.ord): (list(r.path), r.heading) for r in sections.section_paths(df).collect()}
    assert got == want


def test_running_headers_and_toc(spark):
    rows = [(1, 0, "heading", "Top", 1, 1, "b0"), (1, 1, "text", "x", None, 1, "b1"), (1, 2, "heading", "Run", 2, 2, "b2"), (1, 3, "heading", "Run", 2, 3, "b3"), (1, 4, "text", "y", None, 3, "b4")]
    df = spark.createDataFrame(rows, "doc_id int, ord int, type string, text string, level int, page_number int, block_id string")
    assert [r.title for r in sections.running_headers(df).collect()] == ["Run"]
    assert [(t.title, t.level, t.page) for t in sections.table_of_contents(df).first().toc] == [("Top", 1, 1), ("Run", 2, 2), ("Run", 2, 3)]


def test_chunks_fit_and_cover(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(n))
    blocks = [block(0, "Title", "heading", 1)]
    for n in range(1, 60):
        blocks.append(block(n, f"Part {n}", "heading", rng.randint(1, 4)) if n % 7 == 0 else block(n, words(rng.choice([3, 40, 300])).capitalize()))
    for settings in (ChunkSettings(), ChunkSettings(200, 20), ChunkSettings(120, 0)):
        pieces = c.chunk_blocks(blocks, settings, "Title")
        assert pieces and all(len(p.text) <= settings.max_chars and any(x.isalnum() for x in p.text) for p in pieces)
        joined = " ".join(p.text for p in pieces)
        assert all(b.body[:30] in joined for b in blocks if b.type == "text")
        assert all(len(p.context) <= settings.parent_chars for p in pieces)


def test_sections_are_packed_to_the_minimum():
    blocks = [block(0, "A", "heading", 1), block(1, "x" * 100), block(2, "B", "heading", 1), block(3, "y" * 100), block(4, "C", "heading", 1), block(5, "z" * 400), block(6, "D", "heading", 1), block(7, "w" * 10)]
    pieces = c.chunk_blocks(blocks, ChunkSettings(), None)
    assert [len(p.blocks) for p in pieces] == [6, 2]


def test_headings_alone_are_kept_as_a_last_resort():
    assert [p.text for p in c.chunk_blocks([block(0, "Same", "heading", 1), block(1, "Same", "heading", 1)], ChunkSettings())]


def test_breadcrumbs():
    assert c.breadcrumb("Doc", ["Doc", "A"], 1000) == "Doc > A"
    assert c.breadcrumb("x" * 100, ["A"], 1000) == "x" * 79 + "… > A"
    assert c.breadcrumb("Outer title", ["Middle part", "Inner"], 60) == "Inner"


def test_sentences_lines_and_words():
    text = "One two three. Four five six! Seven eight nine? Ten."
    parts = c.pack_sentences(text, 35, 16)
    assert parts == ["One two three. Four five six!", "Four five six! Seven eight nine?", "Ten."] or all(len(p) <= 37 for p in parts)
    assert c.pack_lines("a\n\nb\nc", 3, 0, False) == ["a\nb", "c"]
    assert c.hard_split("aa bb cc", 5, 0) == ["aa bb", "cc"]
    assert c.hard_split("x" * 10, 4, 1) == ["xxxx", "xxxx", "xxxx", "x"]


def table(n, wide=False):
    names = ["id", "name", "a very long column name that takes a lot of room"] if wide else ["id", "name", "value"]
    return "| " + " | ".join(names) + " |\n| --- | --- | --- |\n" + "\n".join(f"| {i} | n{i} | {i * 3} |" for i in range(1, n + 1))


def test_table_split_repeats_or_shortens_the_header():
    parts = c.split_table("Cap\n" + table(60), 400)
    assert all(p.startswith("Cap\n| id | name | value |") and len(p) <= 400 for p in parts)
    assert sum(p.count("\n| ") - 2 for p in parts) + len(parts) * 0 >= 60 - len(parts)
    short = c.split_table(table(60, True), 200)
    assert all("…" in p.split("\n")[0] and len(p) <= 200 for p in short)
    rows = [r for p in parts for r in p.split("\n")[3:]]
    assert rows == [f"| {i} | n{i} | {i * 3} |" for i in range(1, 61)]


def test_records_profile_and_parents():
    blocks = [block(0, "H", "heading", 1), block(1, table(5), "table")]
    pieces = c.chunk_blocks(blocks, ChunkSettings(), "Doc")
    rows = [p for p in pieces if p.representation == "row"]
    assert [p.row for p in rows] == [1, 2, 3, 4, 5] and "id: 1; name: n1; value: 3" in rows[0].text and "| id |" in rows[0].context
    profile = next(p for p in pieces if p.representation == "profile")
    assert "value: min 3 (n1); max 15 (n5); sum 45; mean 9" in profile.text and "id: min" not in profile.text
    assert c.parent_window(["a" * 10, "b" * 10, "c" * 10], 1, 2, "H", 30) == "H\n\n" + "a" * 10 + "\n\n" + "b" * 10


def test_profile_rules():
    assert tables.profile_text(["a"], [["1"], ["2"]]) == ""
    rows = [["x", "1,5"], ["y", "2,5"], ["x", "10"]]
    out = tables.profile_text(["k", ""], rows)
    assert "col2: min 1.50 (x); max 10 (x); sum 14; mean 4.67" in out and "k: 2 values: x (2), y (1)" in out and "col2 by k: x 11.50, y 2.50" in out


def test_formulas_and_strategies(spark):
    blocks = [block(0, "E = mc^2", "formula"), block(1, "some prose text here")]
    assert "mc" not in " ".join(p.text for p in c.chunk_blocks(blocks, ChunkSettings(formulas="context")))
    assert "mc" in " ".join(p.text for p in c.chunk_blocks(blocks, ChunkSettings()))
    rows = [("d", n, f"block-{n}", t, "text", None, None, "s") for n, t in enumerate(["hello world one", "bye"])]
    df = spark.createDataFrame(rows, "doc_id string, ord int, block_id string, text string, type string, level int, page_number int, source_file string")
    for strategy in ("structured", "legacy"):
        out = c.chunk_documents(df, strategy=strategy).collect()
        assert out[0].chunk_id == "block-0-chunk-1" and out[0].block_types == ["text"] and "hello" in out[0].text
    with pytest.raises(ValueError):
        ChunkSettings(100, 100)


def words(text):
    return text.split()


def in_tokens(limit=None, window=20):
    return c.token_budget(ChunkSettings(max_tokens=limit), c.token_counter(words), window)


def prose(*texts):
    return [c.Block(f"b{i}", t, "text") for i, t in enumerate(texts)]


def test_token_budgets():
    numbered = prose(" ".join(f"item{i}" for i in range(70)))
    for budget in (in_tokens(), in_tokens(9)):
        pieces = c.chunk_blocks(numbered, ChunkSettings(), None, budget)
        assert len(pieces) > 1 and all(len(words(p.text)) <= budget.limit for p in pieces)
        assert {w for p in pieces for w in words(p.text)} == set(words(numbered[0].text))
    assert in_tokens().overlap == 2 and in_tokens(9).limit == 9 and in_tokens(9).minimum == 3


def test_no_chunk_exceeds_the_token_budget():
    wide = "| " + " | ".join(f"cell {i}" for i in range(50)) + " |"
    blocks = [c.Block("h", "Findings", "heading", 1), c.Block("t", "| x | y |\n| - | - |\n" + wide + "\n" + wide, "table"), *prose("y=" + "*".join(f"b{i}" for i in range(150)), "v" * 3000, " ".join(f"n{i}" for i in range(150)))]
    pieces = c.chunk_blocks(blocks, ChunkSettings(), "Findings", in_tokens())
    assert pieces and max(len(words(p.text)) for p in pieces) <= 20


def test_windows_shrink_until_they_fit():
    b = c.Budget(10, 3, 2, lambda t: sum(3 if x == "#" else 1 for x in t), 3)
    text = "a" * 40 + "#" * 20
    out = b.windows(text, "p ")
    assert all(b.size(w) <= 10 and w.startswith("p ") for w in out)
    assert c.Budget(4, 1, 1).windows("abcdefghij") == ["abcd", "defg", "ghij", "j"]


def test_a_tokenizer_file_sets_the_budget():
    import public_tokenizers

    s = ChunkSettings(tokenizer=public_tokenizers.path("word_bpe_49k.json"), max_tokens=30)
    size, _ = c._tokenizer(s.tokenizer)
    pieces = c.chunk_blocks(prose("Some plain words are here, and more. " * 30), s)
    assert len(pieces) > 3 and all(size(p.text) <= 30 for p in pieces)


def test_topics_cut_long_texts():
    text = " ".join(f"Sentence number {i} is here." for i in range(20))
    out = c.pack_sentences(text, 120, 30, topics=lambda found: {10}, minimum=20)
    assert any(p.startswith("Sentence number 10 ") for p in out) and not any("number 9 " in p and "number 10 " in p for p in out)
    assert c.pack_sentences(text, 400, 0, topics=lambda found: 1 / 0) == c.pack_sentences(text, 400, 0)  # too short to ask


def test_the_context_of_a_piece_holds_all_its_blocks():
    blocks = [c.Block("h", "Head", "heading", 1), *prose(*[f"{i} " + "x" * 300 for i in range(12)])]
    pieces = c.chunk_blocks(blocks, ChunkSettings(parent_chars=1500), None)
    assert len(pieces) > 3 and all(b.body in p.context for p in pieces if p.context for b in p.blocks)


def test_workbooks_get_no_second_profile():
    t = [c.Block("t", table(8), "table")]
    kinds = lambda rows: {r[11] for r in rows}
    assert "profile" in kinds(c._chunk_rows("d", "a.md", t, ChunkSettings(), "structured"))
    assert "profile" not in kinds(c._chunk_rows("d", "a.xlsx", t, ChunkSettings(), "structured"))


def test_texts_are_chunked_where_they_lie(spark):
    from lexiloom.sources import files

    rows = [(i, f"TITLE NUMBER {i}\n\n" + "A sentence that is long enough to count. " * (i * 7), f"s{i}") for i in range(12)] + [(90, None, "s"), (91, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = c.chunk_texts(docs, "doc_id", "text", "source")
    other = c.chunk_documents(files.text_blocks(docs, "doc_id", "text", "source"))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
