"""Bytes to text, and plain text to blocks.

Each parser is a function from one document's text to a list of
(type, text, level, extra) tuples; :mod:`lexiloom.sources.files` runs them over
files in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from ..functions.text import NUMBERED, ROMAN, TIMESTAMP, TOP_LEVEL, in_python

Parsed = tuple[str, str, int | None, dict]

# Encodings tried in order, and patterns and limits of plain text.
ENCODINGS = ("utf-8-sig", "utf-16", "cp1251", "koi8-r", "cp866", "latin-1")
_RULE = re.compile(r"^\s*[-=_*~]{4,}\s*$")
_STARRED = re.compile(r"^\s*\*+\s*(.+?)\s*\*+\s*$")
_KEY_VALUE = re.compile(r"^\s*[^\w\s]{0,3}\s*[\w .()/-]{2,40}:\s+\S")
_ENDS = re.compile(r"[.!?…]\s*$")
_LETTER = re.compile(r"[^\W\d_]")
TITLE_KEYS = ("title:", "название:", "тема:")
OPENERS = "[(\"'«"
WORDS_PER_BLOCK, MOST_WORDS = 140, 210
TITLE_CHARS, NAME_CHARS, NUMBERED_WORDS, NAME_WORDS, BODY_CHARS, INDENT, TAB = 90, 60, 12, 6, 40, 2, 4
# End of fixed values.

_STAMP, _NUMBERED, _TOP, _ROMAN = map(in_python, (TIMESTAMP, NUMBERED, TOP_LEVEL, ROMAN))


def decode(data: bytes) -> str:
    """Text of a file of unknown encoding."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for name in ENCODINGS:
        try:
            text = data.decode(name)
        except UnicodeError:
            continue
        head = text[:2000]
        if name != "utf-16" or (head and sum(c.isprintable() or c in "\r\n\t" for c in head) > 0.95 * len(head)):
            return text
    return data.decode("utf-8", "replace")


def heading_level(text: str, default: int | None = None) -> int | None:
    if m := _NUMBERED.match(text):
        return min(6, m[1].count(".") + 1)
    return 1 if _TOP.match(text) or _ROMAN.match(text) else default


def is_transcript(lines: list[str]) -> bool:
    some = [x for x in lines if x.strip()]
    return len(some) >= 10 and sum(bool(_STAMP.match(x)) for x in some) >= 0.6 * len(some)


def _bare(line: str) -> str:
    """A header line without the signs before its first letter, digit or bracket; as it is if nothing is left."""
    first = next((i for i, c in enumerate(line) if c.isalnum() or c in OPENERS), len(line))
    return line[first:] or line


def parse_transcript(lines: list[str]) -> list[Parsed]:
    """A title, what stands before the captions, and captions joined to blocks.

    A block ends with the caption that brings it to 140 words and ends a
    sentence, or to 210 words; it carries its first time stamp.
    """
    header: list[str] = []
    out: list[Parsed] = []
    words: list[str] = []
    start = None
    for line in filter(str.strip, lines):
        m = _STAMP.match(line)
        said = line[m.end() :].split() if m else []
        if not m and start is None and not out:
            header.append(_bare(line.strip()))
        if not said:
            continue
        if start is None:
            start = m[0].strip().strip("[]").split("-->")[0].strip()
        words += said
        if len(words) >= MOST_WORDS or len(words) >= WORDS_PER_BLOCK and _ENDS.search(words[-1]):
            out.append(("text", " ".join(words), None, {"time_start": start}))
            words, start = [], None
    if words:
        out.append(("text", " ".join(words), None, {"time_start": start}))
    front: list[Parsed] = [("text", "\n".join(header), None, {"transcript_header": True})] if header else []
    title = next((h.partition(":")[2].strip() for h in header if h.lower().startswith(TITLE_KEYS)), "")
    return ([("heading", title, 1, {})] if title else []) + front + out


@dataclass(frozen=True)
class _Line:
    """A line, and what the rules ask of it."""

    raw: str

    @cached_property
    def text(self) -> str:
        return self.raw.strip()

    @cached_property
    def indented(self) -> bool:
        return bool(self.text) and len(self.raw) - len(self.raw.lstrip()) >= INDENT

    @cached_property
    def ends(self) -> bool:
        return bool(_ENDS.search(self.text))

    @cached_property
    def starred(self) -> str | None:
        m = _STARRED.match(self.text)
        return " ".join(m[1].split()) if m and _LETTER.search(m[1]) else None

    @cached_property
    def rule(self) -> bool:
        return bool(_RULE.match(self.raw))


_NOTHING = _Line("")


class _Prose:
    """Headings and paragraphs of wrapped text."""

    def __init__(self, lines: list[str]):
        self.lines = [_Line(x) for x in lines]

    def _near(self, at: int) -> _Line:
        return self.lines[at] if 0 <= at < len(self.lines) else _NOTHING

    def _stands_alone(self, at: int, body: bool = False) -> bool:
        """After a break, a title or a finished paragraph, and before body text (``body``: it must come)."""
        last, following = self._near(at - 1), self._near(at + 1)
        title_above = _STARRED.match(last.raw) or (len(last.text) <= NAME_CHARS and not last.ends)
        if not (not last.text or last.rule or title_above or (last.ends and following.indented)):
            return False
        if following.text:
            return len(following.text) > BODY_CHARS or following.indented
        return not body or any(self._near(at + n).text for n in (1, 2, 3))

    def heading(self, at: int) -> tuple[str, int] | None:
        """Title and level of a line that is a heading: starred, in capitals, numbered, or a short name over body text."""
        line = self.lines[at]
        text = line.text
        if line.starred:
            return line.starred, 1
        short = len(text) <= TITLE_CHARS
        numbered = heading_level(text) if short and (not line.ends or text.endswith(":")) else None
        capitals = short and len(_LETTER.findall(text)) > 2 and text.upper() == text and text[-1] not in ".,;"
        if capitals and self._stands_alone(at):
            return text, numbered or 1
        words = len(text.split())
        if numbered and words <= NUMBERED_WORDS and self._stands_alone(at):
            return text, numbered
        name = len(text) <= NAME_CHARS and words <= NAME_WORDS and not text[0].islower() and text[-1] not in ".,;:!?"
        if name and _LETTER.search(text) and not _KEY_VALUE.match(text) and self._stands_alone(at, body=True):
            return text, 2
        return None

    def blocks(self) -> list[Parsed]:
        out: list[Parsed] = []
        held: list[str] = []

        def close() -> None:
            if held:
                out.append(("text", " ".join(" ".join(held).split()), None, {}))
                held.clear()

        for at, line in enumerate(self.lines):
            if not line.text or _RULE.match(line.text):
                close()
            elif found := self.heading(at):
                close()
                out.append(("heading", *found, {}))
            else:
                if line.indented and not self._near(at - 1).indented:
                    close()  # an indented line after a flush one opens a paragraph
                held.append(line.text)
        close()
        return out


def parse_prose(lines: list[str]) -> list[Parsed]:
    """Paragraphs with wrapped lines joined, between headings."""
    return _Prose(lines).blocks()


def parse_text(text: str, profile: str = "structured") -> list[Parsed]:
    """Blocks of a plain text; one without any block is one empty block."""
    if profile == "legacy":
        return [("text", text.strip(), None, {})] if text.strip() else []
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " " * TAB).split("\n")]
    return (parse_transcript(lines) if is_transcript(lines) else parse_prose(lines)) or [("text", text.strip(), None, {})]
