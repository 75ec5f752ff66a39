"""Numbers and cells of tables as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed value: what counts as a date in a cell.
DATE = r"^\s*(\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?|\d{1,2}[./]\d{1,2}[./]\d{2,4})\s*$"


def parse_number(c: Column) -> Column:
    """A cell's number: blanks dropped, a single comma without a dot is the decimal point; else null."""
    s = F.regexp_replace(c, "[ \\xa0\\u202f]", "")
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    s = F.when((commas == 1) & ~F.contains(s, F.lit(".")), F.replace(s, F.lit(","), F.lit("."))).otherwise(s)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def looks_like_date(c: Column) -> Column:
    return c.rlike(DATE)


def grouped(c: Column) -> Column:
    """Whole numbers with blanks between thousands, others with two decimals."""
    whole = c == F.floor(c)
    return F.translate(F.when(whole, F.format_number(c, 0)).otherwise(F.format_number(c, 2)), ",", " ")


def format_cell(c: Column, kind: str) -> Column:
    """A typed value as the text of a table cell."""
    if kind == "boolean":
        s = F.when(c, "true").otherwise("false")
    elif kind in ("double", "float"):
        d = c.cast("double")
        size = F.abs(d)
        six = F.regexp_replace(F.format_string("%.6f", F.bround(d, 6)), r"\.?0+$", "")
        exact = F.when(d == F.floor(d), F.format_string("%.0f", d))
        s = exact.when((size >= 1e6) | (size < 1e-4), F.regexp_replace(F.format_string("%.5e", d), r"\.?0+e", "e")).otherwise(six)
    elif kind == "date":
        s = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        midnight = F.date_trunc("day", c) == c
        s = F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))
    else:
        s = c.cast("string")
    s = F.replace(F.when(c.isNull(), "").otherwise(s), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def table_to_markdown(rows: Column, header: bool = True) -> Column:
    """``array<array<string>>`` as a Markdown table.

    Empty rows and columns empty throughout are dropped and ragged rows padded;
    without a header the columns are named ``col1`` and so on.
    """
    some = lambda r: F.exists(r, lambda v: F.trim(v) != "")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def drawn(padded: Column, live: Column) -> Column:
        names = F.transform(live, lambda _, i: F.concat(F.lit("col"), (i + 1).cast("string")))
        rule = line(F.transform(live, lambda _: F.lit("---")))
        lines = F.transform(padded, lambda r: line(F.transform(live, lambda i: r[i])))
        return let(lines, lambda x: F.array_join(F.concat(F.array(x[0], rule), F.slice(x, 2, 1 << 30)) if header else F.concat(F.array(line(names), rule), x), "\n"))

    def table(full: Column) -> Column:
        pad = lambda width: F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        live = lambda padded, width: F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(padded, lambda r: F.trim(r[i]) != ""))
        of = lambda width: let(pad(width), lambda padded: let(live(padded, width), lambda some_: drawn(padded, some_)))
        return F.when(F.size(full) > 0, let(F.array_max(F.transform(full, F.size)), of)).otherwise("")

    # each step is computed once, not again for every row and cell
    return let(F.filter(F.transform(rows, lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit("")))), some), table)


def list_to_markdown(items: Column) -> Column:
    """``array<struct<indent,text,ordered>>`` as a Markdown list; ``n.`` counts all items."""

    def line(x: Column, i: Column) -> Column:
        marked = x["text"].rlike(r"^\s*(\d+[.)]|[a-zа-я][.)]|[-*•])\s")
        mark = F.when(marked, "").when(x["ordered"] & (x["indent"] == 0), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- ")
        return F.concat(F.repeat(F.lit("  "), x["indent"]), mark, x["text"])

    return F.array_join(F.transform(items, line), "\n")


def markdown_rows(text: Column) -> Column:
    """Cells of a Markdown table's rows; rule rows and empty rows are left out."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.contains(s, F.lit("|")))
    cells = F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|", -1), lambda v: F.trim(v)))
    return F.filter(cells, lambda r: F.exists(r, lambda v: v != "") & F.exists(r, lambda v: ~v.rlike("^:?-+:?$") & (v != "")))
