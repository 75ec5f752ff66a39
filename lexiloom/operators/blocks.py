"""Relational post-processing of block streams (doc_id, ord, type, text, page_number, bbox, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import markdown_rows
from ..functions.text import let, repair_hyphenation, strip, strip_fences
from ..functions.vectors import bbox_area

# Labels, titles, patterns and thresholds that results depend on.
LABELS = {
    "title": "heading", "section_header": "heading", "table": "table", "document_index": "table", "picture": "figure",
    "chart": "figure", "formula": "formula", "code": "code", "list_item": "list",
}
DROPPED_LABELS = ("page_header", "page_footer")
GENERIC_TITLES = (
    "оглавление", "содержание", "введение", "аннотация", "приложение", "список литературы",
    "table of contents", "contents", "introduction", "abstract", "appendix", "references", "index",
)
REFUSAL = r"(?iU)^(i (?:cannot|can't|am unable)|sorry|unable to|as an ai|извин|я не мог|не могу)"
PROSE = (
    r"(?iU)^(the (image|formula|picture|equation)\b|this (image|is a|appears)|"
    r"на (изображени|рисунке|картинке)|(это|здесь) (изображ|формула|показан)|"
    r"i see\b|изображена?\b)"
)
OPEN_HEADING = r"(?iU)[,(\-–—:;/]\s*$|\b(и|или|the|of|and|for|по|для|в|на|с)\s*$"
CJK = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
MATH = r"[\\^_={}∑∫±≤≥×÷·√∞→αβγδθλμπσφω]|\d\s*[+\-*/=]\s*\d"
TEXT_INK, MIN_LINES, CHARS_PER_LINE, SHORT_SHARE = 0.015, 8, 30, 0.3
MAX_REPEATED_LINES, MAX_REPEATS, MAX_BRACES, MAX_TRANSCRIPT = 4, 6, 6, 2000
MIN_BLOCKS, MIN_ALTERNATIONS, FULL_WIDTH = 6, 4, 0.65
OCR_FEW_CHARS, OCR_SOME_CHARS, OCR_IMAGE_SHARE, OCR_FULL_SCAN = 20, 100, 0.45, 0.6
MAX_EMPTY_CELLS = 0.5
FIGURES_PER_PAGE, FIGURES_LEAST, FIGURES_MOST = 0.25, 8, 32
# End of fixed values.


def stamp_blocks(blocks: DataFrame, prefix: str = "block") -> DataFrame:
    """Running ids per document; blocks without text are left out unless they have an image."""
    kept = blocks.where((strip(F.col("text")) != "") | F.coalesce(F.col("has_image"), F.lit(False)))
    return kept.withColumn("block_id", F.concat(F.lit(prefix + "-"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("string")))


def map_labels(items: DataFrame, label: str = "label") -> DataFrame:
    """Layout labels as block types; page headers and footers go."""
    kind = F.lit("text")
    for name, to in LABELS.items():
        kind = F.when(F.col(label) == name, to).otherwise(kind)
    return items.where(~F.col(label).isin(*DROPPED_LABELS)).withColumn("type", kind)


def reorder_columns(blocks: DataFrame) -> DataFrame:
    """Pages that clearly have two columns are read left, then right.

    A document with a block that has no geometry is left alone.  Adds
    ``reading_ord``.
    """
    doc, page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page_number")
    in_order = page.orderBy("ord")
    b = blocks.withColumn("_geo", F.every(F.col("bbox").isNotNull() & F.col("page_number").isNotNull()).over(doc))
    b = b.withColumn("_x0", F.min("bbox.x0").over(page)).withColumn("_x1", F.max("bbox.x1").over(page))
    b = b.withColumn("_side", ((F.col("bbox.x0") + F.col("bbox.x1")) / 2 > (F.col("_x0") + F.col("_x1")) / 2).cast("int"))
    b = b.withColumn("_turn", (F.col("_side") != F.lag("_side").over(in_order)).cast("int"))
    wide = F.max((F.col("bbox.x1") - F.col("bbox.x0") >= FULL_WIDTH * (F.col("_x1") - F.col("_x0"))).cast("int")).over(page) == 1
    two = F.col("_geo") & (F.count(F.lit(1)).over(page) >= MIN_BLOCKS) & ~wide & (F.min("_side").over(page) != F.max("_side").over(page)) & (F.sum("_turn").over(page) >= MIN_ALTERNATIONS)
    b = b.withColumn("_two", F.coalesce(two, F.lit(False))).withColumn("_first", F.min("ord").over(page))
    key = F.when(F.col("_two"), F.struct(F.col("_first").alias("p"), F.col("_side").alias("s"), F.col("bbox.y0").alias("y"), F.col("bbox.x0").alias("x"), F.col("ord").alias("o")))
    key = key.otherwise(F.struct(F.col("ord").alias("p"), F.lit(0).alias("s"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.col("ord").alias("o")))
    b = b.withColumn("_key", key).withColumn("reading_ord", F.row_number().over(doc.orderBy("_key")))
    return b.drop("_geo", "_x0", "_x1", "_side", "_turn", "_two", "_first", "_key")


def merge_adjacent(blocks: DataFrame) -> DataFrame:
    """Neighbouring list items of one group, inline fragments of one paragraph, and the lines of a heading that was cut become one block.

    ``group_id`` is the group an item came from; null groups merge only lists.
    A heading goes on if its first line ends in a mark or a word that can't end
    it, or the next begins in lower case or with a closing mark.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    was = lambda c: F.lag(c).over(order)
    same = (F.col("type") == was("type")) & F.coalesce(F.col("page_number") == was("page_number"), F.lit(True))
    group = F.col("group_id").eqNullSafe(was("group_id"))
    goes_on = was("text").rlike(OPEN_HEADING) | F.col("text").rlike(r"^[\p{Ll})»,;]")
    pieces = (F.col("type") == "list") | ((F.col("type") == "text") & F.col("group_id").isNotNull())
    joins = same & ((group & pieces) | ((F.col("type") == "heading") & goes_on))
    run = F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = blocks.withColumn("text", repair_hyphenation(F.col("text"))).withColumn("_run", run)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    merged = b.groupBy("doc_id", "_run").agg(
        F.min("ord").alias("ord"), F.min("type").alias("type"), F.min("page_number").alias("page_number"), parts.alias("_parts"),
        F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"),
        F.count(F.lit(1)).alias("item_count"),
    )
    listed = F.array_join(F.transform("_parts", lambda x: F.concat(F.lit("- "), x)), "\n")
    joined = F.regexp_replace(F.regexp_replace(F.array_join("_parts", " "), r"([(«]) ", "$1"), r" ([,.;:)»])", "$1")
    return merged.withColumn("text", F.when(F.col("type") == "list", listed).when(F.col("item_count") > 1, joined).otherwise(F.element_at("_parts", 1))).drop("_run", "_parts")


def document_titles(blocks: DataFrame, first: int = 12, longest: int = 200) -> DataFrame:
    """``doc_id, title``: the first telling heading among the first blocks; long ones only if there is no other."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    title = strip(F.regexp_replace("text", r"(?U)\s+", " "))
    named = (title != "") & ~F.lower(F.btrim(title, F.lit(" .:"))).isin(*GENERIC_TITLES)
    good = blocks.withColumn("_nth", nth).where((F.col("_nth") <= first) & (F.col("type") == "heading") & named)
    return good.groupBy("doc_id").agg(F.min(F.struct((F.length(title) > longest).alias("long"), "ord", F.left(title, F.lit(longest)).alias("title"))).alias("t")).select("doc_id", F.col("t.title").alias("title"))


def heading_titles(blocks: DataFrame, metadata_title: str | None = None) -> DataFrame:
    """``doc_id, title``: the stored title, else the first heading with text."""
    title = F.when(F.col("type") == "heading", F.nullif(strip(F.col("text")), F.lit("")))
    aggs = [F.min(F.when(title.isNotNull(), F.struct("ord", title.alias("t")))).alias("h")]
    stored = F.lit(None).cast("string")
    if metadata_title:
        aggs.append(F.max(F.nullif(strip(F.col(metadata_title)), F.lit(""))).alias("m"))
        stored = F.col("m")
    return blocks.groupBy("doc_id").agg(*aggs).select("doc_id", F.coalesce(stored, F.col("h.t")).alias("title"))


def needs_ocr(chars: Column, images: Column, image_share: Column) -> Column:
    return ((chars < OCR_FEW_CHARS) & (images > 0)) | ((chars < OCR_SOME_CHARS) & (image_share >= OCR_IMAGE_SHARE))


def ocr_routing(pages: DataFrame) -> DataFrame:
    """Page statistics (doc_id, page_number, char_count, image_count, image_area_ratio) rolled up per document."""
    p = pages.withColumn("_ocr", needs_ocr(F.col("char_count"), F.col("image_count"), F.col("image_area_ratio")))
    return p.groupBy("doc_id").agg(
        F.bool_or("_ocr").alias("any_ocr"), F.sort_array(F.collect_list(F.when(F.col("_ocr"), F.col("page_number")))).alias("ocr_pages"), F.avg(F.col("_ocr").cast("double")).alias("ocr_ratio")
    ).withColumn("full_scan", F.col("ocr_ratio") >= OCR_FULL_SCAN)


def ocr_policy(routed: DataFrame, mode: str = "auto") -> DataFrame:
    """Which documents are read by OCR: ``auto`` follows the routing, ``on`` and ``off`` don't."""
    if mode not in ("auto", "on", "off"):
        raise ValueError("mode must be auto, on or off")
    return routed.withColumn("use_ocr", {"auto": F.col("any_ocr"), "on": F.lit(True), "off": F.lit(False)}[mode])


def merge_transcripts(blocks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Blocks of transcribed pages are replaced by the transcripts; pages stay in order."""
    kept = blocks.join(transcripts.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    union = kept.unionByName(transcripts, allowMissingColumns=True)
    return union.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "ord")))


def _longest_run(lines: Column) -> Column:
    """Most equal lines in a row."""
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(lines, zero, step, lambda s: s["best"])


def _verdict(ok: bool, reason: str = "", retry: bool = False) -> Column:
    return F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"), F.lit(retry).alias("retryable"))


def check_page_transcript(text: Column, ink: Column, text_lines: Column, no_text: str = "[no text]") -> Column:
    """Struct (ok, reason, retryable): may a page's transcript be trusted?"""

    def check(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n", -1), strip), lambda x: x != "")
        letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
        cjk = F.length(F.regexp_replace(t, r"[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]+", ""))
        foreign = F.when(t.rlike(CJK), let(letters, lambda n: (n > 0) & (cjk > 0.05 * n))).otherwise(F.lit(False))
        short = (text_lines >= MIN_LINES) & (F.length(t) < SHORT_SHARE * text_lines * CHARS_PER_LINE)
        none = (t == "") | F.lower(F.left(t, F.lit(len(no_text)))).startswith(no_text)
        return (
            F.when(none & (ink >= TEXT_INK), _verdict(False, "empty_on_inked_page"))
            .when(none, _verdict(True))
            .when(t.rlike(REFUSAL), _verdict(False, "refusal"))
            .when(_longest_run(lines) > MAX_REPEATED_LINES, _verdict(False, "repetition_loop"))
            .when(foreign, _verdict(False, "foreign_script"))
            .when(F.coalesce(short, F.lit(False)), _verdict(False, "short_transcript", True))
            .otherwise(_verdict(True))
        )

    return let(strip(strip_fences(F.coalesce(text, F.lit("")))), check)


def check_formula_transcript(text: Column, kind: Column) -> Column:
    """Struct (ok, reason, retryable) for the transcript of one formula or code region, already cleaned."""
    formula = kind == "formula"

    def check(t: Column) -> Column:
        lines = F.filter(F.transform(F.split(t, "\n", -1), strip), lambda x: x != "")
        piece = strip(F.substring(t, 1, 24))
        times = let(piece, lambda p: F.when(F.length(p) >= 8, (F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).otherwise(1))
        loops = let(lines, lambda x: let(_longest_run(x), lambda run: F.when((F.size(x) > 1) & (run > 1), run).otherwise(times)))
        count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
        braces = F.abs(count("{") - count("}"))
        words = F.size(F.regexp_extract_all(t, F.lit(r"(?U)[^\W\d_]{2,}"), F.lit(0)))
        return (
            F.when(t == "", _verdict(False, "empty"))
            .when(t.rlike(REFUSAL), _verdict(False, "refusal"))
            .when(t.rlike(PROSE), _verdict(False, "prose"))
            .when(F.length(t) > MAX_TRANSCRIPT, _verdict(False, "too_long"))
            .when(loops > MAX_REPEATS, _verdict(False, "loop"))
            .when(formula & (braces > MAX_BRACES), _verdict(False, "unbalanced", True))
            .when(formula & (braces > 0), _verdict(True, "unbalanced", True))
            .when(formula & ~t.rlike(MATH) & (words > 12), _verdict(False, "not_a_formula"))
            .otherwise(_verdict(True))
        )

    return let(strip(F.coalesce(text, F.lit(""))), check)


def is_degenerate_table(text: Column) -> Column:
    """A table without a usable grid: under two rows or columns, or mostly empty."""
    def few(rows: Column, body: Column) -> Column:
        columns = F.array_max(F.transform(rows, F.size))
        empty = F.size(F.filter(body, lambda v: v == ""))
        return (F.size(rows) < 2) | (columns < 2) | ((F.size(body) > 0) & (empty > MAX_EMPTY_CELLS * F.size(body)))

    return let(markdown_rows(text), lambda rows: let(F.flatten(F.slice(rows, 2, 1 << 30)), lambda body: few(rows, body)))


def is_better_table(original: Column, candidate: Column) -> Column:
    """A re-read table counts only if it is sound and has more columns, or as many and more rows."""
    shape = lambda t: F.struct(F.coalesce(F.array_max(F.transform(markdown_rows(t), F.size)), F.lit(0)).alias("c"), F.size(markdown_rows(t)).alias("r"))
    return ~is_degenerate_table(candidate) & (shape(candidate) > shape(original))


def repair_candidates(blocks: DataFrame, per_document: int = 6, least_area: float = 8000.0) -> DataFrame:
    """Degenerate tables worth reading again, the first of each document."""
    bad = blocks.where((F.col("type") == "table") & is_degenerate_table(F.col("text")) & (bbox_area(F.col("bbox")) >= least_area))
    return bad.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_nth") <= per_document).drop("_nth")


def figures_to_describe(blocks: DataFrame, pages: DataFrame, least_area: float = 0.0) -> DataFrame:
    """The largest figures of each document, a quarter of its pages but 8 to 32; ``pages``: doc_id, total_pages."""
    budget = F.greatest(F.lit(FIGURES_LEAST), F.least(F.lit(FIGURES_MOST), F.floor(F.col("total_pages") * FIGURES_PER_PAGE).cast("int")))
    area = bbox_area(F.col("bbox"))
    figures = blocks.where((F.col("type") == "figure") & (area >= least_area)).join(pages, "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.desc(area), F.asc("ord"))
    return figures.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= budget).drop("_nth", "total_pages")


def slide_order(shapes: DataFrame, row_height: int = 300_000) -> DataFrame:
    """Shapes of slides (doc_id, slide, top, left) in reading order: rows of a height, then from the left."""
    order = Window.partitionBy("doc_id", "slide").orderBy(F.floor(F.col("top") / row_height), "left")
    return shapes.withColumn("ord", F.row_number().over(order))


def slide_titles(shapes: DataFrame, slide_height: int, top_share: float = 0.45, longest: int = 120) -> DataFrame:
    """``doc_id, slide, title``: the title placeholder, else the largest short text near the top."""
    text = strip(F.col("text"))
    fits = shapes.where((text != "") & (F.col("is_title") | ((F.col("top") <= top_share * slide_height) & (F.length(text) <= longest))))
    best = F.min(F.struct((~F.col("is_title")).alias("p"), (-F.coalesce("font_size", F.lit(0.0))).alias("f"), "top", text.alias("title")))
    return fits.groupBy("doc_id", "slide").agg(best.alias("b")).select("doc_id", "slide", F.col("b.title").alias("title"))


def to_markdown(blocks: DataFrame, toc: bool = False) -> DataFrame:
    """``doc_id, markdown`` of whole documents, under a list of their headings if ``toc``."""
    text = strip(F.col("text"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))
    md = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(F.col("type") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("type") == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .otherwise(text)
    )
    parts = F.sort_array(F.collect_list(F.when(text != "", F.struct("ord", md.alias("md")))))
    body = F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n")
    entry = F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- "), text)
    listed = F.sort_array(F.collect_list(F.when((F.col("type") == "heading") & (text != ""), F.struct("ord", entry.alias("e")))))
    head = F.array_join(F.transform(listed, lambda x: x["e"]), "\n")
    return blocks.groupBy("doc_id").agg((F.concat_ws("\n\n", F.nullif(head, F.lit("")), body) if toc else body).alias("markdown"))


def to_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def block_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
