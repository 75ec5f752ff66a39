import io
import zipfile

import pytest

from lexiloom.sources import files, html, markdown, office, plain


def test_decoding():
    assert plain.decode("Привет, мир".encode("cp1251")) == "Привет, мир"
    assert plain.decode("﻿x".encode()) == "x"
    assert plain.decode("é".encode("utf-16")) == "é"
    assert plain.decode(b"") == ""


def test_transcript():
    lines = ["🎬 Title: My talk", "Channel: me"] + [f"[00:{i:02d}] " + "word " * 9 + "end." for i in range(30)] + ["dropped"]
    out = plain.parse_text("\n".join(lines))
    assert out[0][:3] == ("heading", "My talk", 1) and out[1][1] == "Title: My talk\nChannel: me"
    body = [b for b in out if b[3].get("time_start")]
    assert [b[3]["time_start"] for b in body] == ["00:00", "00:14", "00:28"] and len(body[0][1].split()) == 140
    assert "dropped" not in " ".join(b[1] for b in out)


def test_prose():
    out = plain.parse_text("INTRODUCTION\n\nFirst line\nwrapped here.\n\n* CHAPTER NAME *\n\n1.2 Scope\n\nMore text follows here.\n\nTitle\n=====\nx y z.")
    assert [(b[0], b[1]) for b in out] == [("heading", "INTRODUCTION"), ("text", "First line wrapped here."), ("heading", "CHAPTER NAME"), ("heading", "1.2 Scope"), ("text", "More text follows here."), ("text", "Title"), ("text", "x y z.")]
    assert [b[2] for b in out if b[0] == "heading"] == [1, 1, 2]
    assert plain.parse_text("a\nb", "legacy") == [("text", "a\nb", None, {})]
    assert plain.parse_text(" \n\n") == [("text", "", None, {})] and plain.parse_text("", "legacy") == []


def test_wrapped_books():
    out = plain.parse_text(
        "B. Author. A book about rivers and lakes\n----------------------------------------------\n *** THE SEAS ***\nAmber\n"
        "   Amber is what the sea brings up after a long storm,\nand people have looked for it on the shore\nsince there were people there.\n"
        "   In winter it is seldom found, as the ice\nkeeps the waves away from the land.\nKelp\n\tKelp grows where the water is cold.\nNote: this line holds a key.\n"
    )
    assert [(b[1], b[2]) for b in out if b[0] == "heading"] == [("B. Author. A book about rivers and lakes", 2), ("THE SEAS", 1), ("Amber", 2), ("Kelp", 2)][-3:]
    texts = [b[1] for b in out if b[0] == "text"]
    assert "Amber is what the sea brings up after a long storm, and people have looked for it on the shore since there were people there." in texts
    assert any(t.startswith("In winter it is seldom found") for t in texts) and any(t.startswith("Kelp grows") for t in texts)


def test_what_isnt_a_heading():
    body = "\n\n" + "Body text that is clearly longer than forty characters, as it should be."
    kinds = lambda line: plain.parse_text(line + body)[0][:1] + plain.parse_text(line + body)[0][2:3]
    assert kinds("Some seven words of a short line") == ("text", None)
    assert kinds("One two three four five six") == ("heading", 2)
    assert kinds("Key: value") == kinds("It ends here.") == kinds("lower case") == kinds("With a colon:") == ("text", None)
    assert kinds("3.1.4 A numbered one") == ("heading", 3) and kinds("CHAPTER TWO") == ("heading", 1) and kinds("* starred *") == ("heading", 1)


def test_transcripts_without_sentence_ends():
    lines = [f"{i:02d}:00 " + "word " * 30 for i in range(12)]
    sizes = [len(b[1].split()) for b in plain.parse_text("\n".join(lines))]
    assert sizes == [210, 150]  # a caption is never cut: seven reach 210


def test_markdown():
    text = "---\ntitle: Doc\nx: y\n---\n# One #\nSetext\n---\npara\nmore <b>x</b>\n\n- a\n  - b\n1. c\n\n```py\n# not heading\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![alt](u.png)\n## Two `x`"
    out = markdown.parse_markdown(text)
    assert [(b[0], b[1], b[2]) for b in out] == [
        ("heading", "Doc", 1), ("heading", "One", 1), ("heading", "Setext", 2), ("text", "para more x", None), ("list", "- a\n  - b\n1. c", None),
        ("code", "# not heading", None), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", None), ("figure", "alt", None), ("heading", "Two x", 2),
    ]


def test_html():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav>menu</nav><h1>Head &amp; x</h1>
    <p><b>bold<br><p>second</p><ul><li>a<ul><li>b</li></ul><li>c</ul><ol><li>n</ol>
    <table><tr><th colspan=2>H</th></tr><tr><td rowspan="2">r</td><td>1</td></tr><tr><td>2|x</td></tr></table><pre>code
  kept</pre><img alt="pic"><div>tail</div></body>"""
    out = html.parse_html(page)
    kinds = [(b[0], b[1]) for b in out]
    assert kinds[0] == ("heading", "Head & x") and ("text", "bold") in kinds and ("text", "second") in kinds
    assert ("list", "- a\n  - b\n- c") in kinds and ("list", "1. n") in kinds and ("code", "code\n  kept") in kinds
    assert ("table", "| H | H |\n| --- | --- |\n| r | 1 |\n| r | 2\\|x |") in kinds
    assert not any("menu" in t or "var" in t for _, t in kinds)
    assert html.parse_html('<table><tr><td colspan="9999">x</td></tr></table>')[0][1].count("x") == html.MAX_SPAN
    assert html.parse_html("just text") == [("text", "just text", None, {})]


def package(**parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return raw.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(text, props=""):
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


def test_docx():
    num = '<w:pPr><w:numPr><w:ilvl w:val="{}"/><w:numId w:val="1"/></w:numPr></w:pPr>'
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr>{run("Results")}</w:p><w:p>{run("Plain text with a note")}<w:r><w:footnoteReference w:id="5"/></w:r></w:p>'
        f'<w:p>{num.format(0)}{run("first")}</w:p><w:p>{num.format(1)}{run("nested")}</w:p><w:p>{num.format(0)}{run("second")}</w:p>'
        f'<w:tbl><w:tr><w:tc><w:p>{run("a")}</w:p></w:tc><w:tc><w:p>{run("b")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run("1")}</w:p></w:tc><w:tc><w:p>{run("2")}</w:p></w:tc></w:tr></w:tbl>'
    )
    data = package(**{
        "word__document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word__styles.xml": f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word__footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="5"><w:p>{run("The note")}</w:p></w:footnote></w:footnotes>',
        "word__numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>'
        f'<w:lvl w:ilvl="1"><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
    })
    out = [(b[0], b[1]) for b in office.parse_docx(data)]
    assert out == [("heading", "Results"), ("text", "Plain text with a note"), ("text", "The note"), ("list", "3. first\n  3.i) nested\n4. second"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |")]


def test_numerals():
    assert [office.roman(n) for n in (4, 9, 14, 1999)] == ["IV", "IX", "XIV", "MCMXCIX"]
    assert [office.letters(n) for n in (1, 26, 27)] == ["a", "z", "aa"]


S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def sheet(rows, more=""):
    cell = lambda r, k, v: f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{r}"><v>{v}</v></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, k, v) for k, v in enumerate(vs) if v is not None) + "</row>" for r, vs in rows.items())
    return f"<worksheet {S}><sheetData>{body}</sheetData>{more}</worksheet>"


def test_xlsx():
    rows = {1: ["Name", "Age"], 2: ["Ann", 30], 3: ["Bob", 41], 4: ["Cy", 25.5], 6: ["A note that is long enough to be one"], 8: ["k", "v"], 9: ["x", 1]}
    data = package(**{
        "xl__workbook.xml": f'<workbook {S} {R}><sheets><sheet name="People" r:id="r1"/></sheets></workbook>',
        "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'.replace("__", "/"),
        "xl__worksheets__sheet1.xml": sheet(rows),
    })
    out = office.parse_xlsx(data)
    assert [b[0] for b in out] == ["heading", "table", "text", "text", "table"]
    assert out[1][1] == "| Name | Age |\n| --- | --- |\n| Ann | 30 |\n| Bob | 41 |\n| Cy | 25.5 |"
    assert "Age: min 25.50 (Cy); max 41 (Bob)" in out[2][1] and out[3][1].startswith("A note")
    parted = [["k", "v"], ["x", "1"], ["", ""], ["2", "3"], ["", ""], ["other", "head"]]
    assert [len(r) for r in office._rejoined(office._regions(parted))] == [3, 1]
    assert office._date_text(45000.5) == "2023-03-15 12:00" and office._date_text(45000) == "2023-03-15"


def test_pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    shape = lambda y, text, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in text)}</p:txBody></p:sp>'
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{shape(900000, ['one', 'two'])}{shape(0, ['The title'], '<p:ph type=\"title\"/>')}</p:spTree></p:cSld></p:sld>"
    out = office.parse_pptx(package(**{"ppt__slides__slide1.xml": slide}))
    assert [(b[0], b[1], b[3]["page_number"]) for b in out] == [("heading", "The title", 1), ("list", "- one\n- two", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello there world.")
    (tmp_path / "b.md").write_text("# T\n\nbody")
    (tmp_path / "c.HTML").write_text("<h1>X</h1><p>y")
    out = files.read_files(spark, str(tmp_path)).orderBy("source_file", "ord").collect()
    assert [(r.source_file, r.ord, r.block_id, r.type, r.text) for r in out] == [("a.txt", 1, "block-1", "text", "Hello there world."), ("b.md", 1, "block-1", "heading", "T"), ("b.md", 2, "block-2", "text", "body"), ("c.HTML", 1, "block-1", "heading", "X"), ("c.HTML", 2, "block-2", "text", "y")]
    with pytest.raises(files.UnsupportedFile):
        files.parse("x", "exe")
    recs = spark.createDataFrame([("q", ["café.txt", "no.txt"])], "id string, doc_ids array<string>")
    have = spark.createDataFrame([("café.txt",)], "path string")
    assert [(r.pos, r.path, r.matches) for r in files.match_documents(recs, have).orderBy("pos").collect()] == [(0, "café.txt", 1), (1, None, 0)]


def test_run_files(spark, tmp_path):
    rows = [("1", "q", "m", [("t", 1)], "a")]
    spark.createDataFrame(rows, "id string, question string, answer_model string, contexts array<struct<text:string,rank:int>>, answer string").write.parquet(str(tmp_path / "r.parquet"))
    assert files.read_run(spark, str(tmp_path / "r.parquet")).first().contexts == ["t"]
    with pytest.raises(ValueError):
        files.read_run(spark, "x.csv")
