"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
BULLETS = r"(?U)^\s*(?:[-•●○◦▪▫■□➢➤►▶✓✔\-–—*·]|o)\s+"
NUMBERED = r"(?U)^\s*(\d+(?:\.\d+)*)[.)]?\s+\S"
TOP_LEVEL = r"(?iU)^\s*(глава|раздел|часть|chapter|part|лекция|lecture|тема|topic|модуль|module)\b"
ROMAN = r"(?U)^\s*[IVXLC]+[.)]\s+\S"
WORDS = r"(?U)\d+(?:[.,]\d+)+|\w+(?:[-'’]\w+)*"
TIMESTAMP = r"(?U)^\s*\[?(\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?\]?\s*(-->.*)?\s*"
HYPHEN_BREAK = r"(?U)([^\W\d_]{2,})[-‐]\s+([^\W\d_]{2,})"
ABBREVIATIONS = (
    r"(?iU)\b(т|т\.е|т\.к|т\.д|т\.п|др|пр|см|стр|рис|табл|гл|п|пп|ст|г|гг|в|вв|тыс|млн|млрд|руб|коп"
    r"|им|напр|ул|д|корп|e\.g|i\.e|etc|vs|fig|no|approx|dr|mr|mrs|ms|prof|vol|pp)\.\s"
)
SENTENCE_END = r"(?U)(?<=[.!?…])\s+(?=[^\sa-zа-яё])|\n+"
MOJIBAKE = r"[ÐÑ][\x80-\xbf]|[Ã][\x80-\xbf]{2}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
TABLE_RULE = r"(?U)\|\s*-+\s*\|"
VARIANT_PREFIX = r"(?U)^\s*(?:[-*•]|\d+[.)]|[a-zA-Zа-яА-Я][.)])\s*"
QUOTES = "\"'«»“”„‘’`"
EMOJI_PREFIX = r"(?U)^[^\w\s\"'«(\[#*_-]+\s*"
SPACING_RUN = r"(\\(?:qquad|quad|;|:|,|!))(?:\s*\\(?:qquad|quad|;|:|,|!)){2,}"
MARKS = "[\\u0300-\\u036f]"
# End of fixed values.

_SPACE = "[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x85\\xa0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def in_python(pattern: str) -> re.Pattern:
    """One of the patterns above for Python, whose classes are Unicode's without being asked."""
    return re.compile(re.sub(r"^\(\?i?U\)", "", pattern), re.IGNORECASE if pattern.startswith("(?iU)") else 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """Control characters out, line ends unified, runs of blanks collapsed, lines trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, "[ \\t\\xa0]{2,}", " ")
    return strip(F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n"))


def strip_bullet(c: Column) -> Column:
    return F.regexp_replace(c, BULLETS, "")


def heading_level(c: Column, default: int | None = None) -> Column:
    """Level by numbering: ``1.2.3 X`` is 3 (6 at most), chapters and Roman numbers 1."""
    depth = F.size(F.split(F.regexp_extract(c, NUMBERED, 1), r"\."))
    return F.when(c.rlike(NUMBERED), F.least(depth, F.lit(6))).when(c.rlike(TOP_LEVEL) | c.rlike(ROMAN), 1).otherwise(F.lit(default).cast("int"))


def clamped_level(c: Column, default: int = 1) -> Column:
    """A stored level brought into 1 to 6; what isn't a number is ``default``."""
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(c.try_cast("int"), F.lit(default))))


def looks_like_heading(c: Column, max_chars: int = 120) -> Column:
    """One short line of at most 16 words that doesn't end a sentence (a colon may)."""
    s = strip(c)
    words = F.size(F.regexp_extract_all(s, F.lit(r"(?U)\S+"), F.lit(0)))
    return (F.length(s) > 0) & (F.length(s) <= max_chars) & ~F.contains(s, F.lit("\n")) & ~s.rlike("[.!?;,]$") & (words <= 16)


def fold_yo(c: Column) -> Column:
    return F.translate(c, "ёЁ", "еЕ")


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str]]:
    """(letter and mark, composed letter) of Latin, Greek and Cyrillic, those with fewer marks first."""
    blocks = [range(0xC0, 0x250), range(0x370, 0x500), range(0x1E00, 0x2000)]
    pairs = [(chr(i), unicodedata.decomposition(chr(i)).split()) for r in blocks for i in r]
    known = [("".join(chr(int(x, 16)) for x in d), c) for c, d in pairs if len(d) == 2 and not d[0].startswith("<")]
    return sorted((p for p in known if unicodedata.normalize("NFC", p[0]) == p[1]), key=lambda p: (len(unicodedata.normalize("NFD", p[1])), p))


def composed(c: Column) -> Column:
    """Letters and the marks after them as one letter, as in NFC; only texts with such marks are touched."""
    pairs = F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in _compositions()])), "array<struct<a:string,b:string>>")
    whole = F.aggregate(pairs, c, lambda t, p: F.replace(t, p["a"], p["b"]))
    return F.when(c.rlike(MARKS), whole).otherwise(c)


def tokens(c: Column) -> Column:
    """Search tokens of the composed text in order: numbers with separators, words with hyphens and apostrophes, lower case."""
    return F.regexp_extract_all(F.lower(fold_yo(composed(c))), F.lit(WORDS), F.lit(0))


def normalize_for_search(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def lemmatised(words: Column, lemmas: Column) -> Column:
    """Tokens with the lemma that a map column has for them; others stay."""
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(lemmas, w), w))


def comparison_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", " "))


def alphanumeric_key(c: Column) -> Column:
    """Letters and digits only, for containment tests."""
    return F.regexp_replace(F.lower(c), "[^0-9a-zа-яё]+", "")


def repair_hyphenation(c: Column) -> Column:
    """Words cut at line ends joined again; two passes reach chains."""
    c = F.replace(c, F.lit("­"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, HYPHEN_BREAK, "$1$2"), HYPHEN_BREAK, "$1$2")


def sentences(c: Column, chained: bool = True) -> Column:
    """Sentences; a blank after an abbreviation is none of their borders.

    ``chained``: of abbreviations that one blank parts each counts.  Without
    it the blank belongs to the first, and the second may end a sentence.
    """
    if chained:
        glued = F.regexp_replace(c, ABBREVIATIONS, "$1. ")
    else:
        glued = F.regexp_replace(c, ABBREVIATIONS.replace(r"\b(", r"(^|[^\p{L}\p{N}\p{M}_])("), "$1$2. ")
    parts = F.transform(F.split(glued, SENTENCE_END.replace("\\s+(", "[\\s&&[^\\xa0]]+("), -1), lambda s: strip(F.replace(s, F.lit(" "), F.lit(" "))))
    return F.filter(parts, lambda s: s != "")


def is_transcript(c: Column) -> Column:
    """At least 10 lines with text, 6 in 10 of which begin with a time stamp."""
    lines = F.filter(F.split(c, "\n", -1), lambda x: strip(x) != "")
    stamped = F.filter(lines, lambda x: x.rlike(TIMESTAMP))
    return (F.size(lines) >= 10) & (F.size(stamped) >= 0.6 * F.size(lines))


def strip_fences(c: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?s)^```[\w-]*\s*\n", ""), r"\n?```\s*$", ""))


def strip_emoji_prefix(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI_PREFIX, "")


def collapse_latex_spacing(c: Column) -> Column:
    return F.regexp_replace(c, SPACING_RUN, "$1")


def safe_relative_path(c: Column) -> Column:
    """A relative POSIX path without empty, ``.`` or ``..`` parts."""
    parts = F.split(c, "/", -1)
    return c.isNotNull() & ~c.startswith("/") & ~F.contains(c, F.lit("\\")) & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def quoted_phrases(c: Column) -> Column:
    """Normalised phrases of two words or more that stand in quotation marks."""
    found = F.regexp_extract_all(c, F.lit('["«“„]([^"«»“”„]+)["»”“]'), F.lit(1))
    return F.filter(F.transform(found, normalize_for_search), lambda p: F.contains(p, F.lit(" ")))


def without_quotes(c: Column) -> Column:
    return strip(F.regexp_replace(c, '["«“„][^"«»“”„]+["»”“]', " "))


def parse_variants(raw: Column, question: Column, limit: int = 8, max_chars: int = 600) -> Column:
    """Distinct formulations, one a line of a model's answer, that aren't chatter or the question."""
    lines = F.transform(F.split(raw, "\n", -1), lambda s: F.regexp_replace(F.trim(F.btrim(F.trim(F.regexp_replace(s, VARIANT_PREFIX, "")), F.lit(QUOTES))), r"(?U)\s+", " "))
    low = lambda s: F.lower(s)
    good = F.filter(lines, lambda s: (s != "") & (F.length(s) <= max_chars) & ~s.endswith(":") & ~low(s).startswith("here are") & ~low(s).startswith("вот "))
    keyed = F.filter(F.transform(good, lambda s: F.struct(comparison_key(s).alias("k"), s.alias("s"))), lambda x: (x["k"] != "") & (x["k"] != comparison_key(question)))
    first = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1)
    return F.slice(F.transform(first, lambda x: x["s"]), 1, limit)
