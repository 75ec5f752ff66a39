"""Markdown to blocks: a line grammar tried in a fixed order."""

from __future__ import annotations

import re

from .plain import Parsed

# The line grammar.
_ATX = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_SETEXT = (re.compile(r"^={3,}\s*$"), re.compile(r"^-{3,}\s*$"))
_FENCE = re.compile(r"^\s*(```+|~~~+)\s*([\w+-]*)")
_TAG = re.compile(r"<[^>]+>")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
_IMAGE = re.compile(r"^\s*!\[([^\]]*)\]\(([^)]*)\)\s*$")
_INLINE = re.compile(r"(\*\*|__|`)")
FRONT_MATTER_KEYS, FRONT_MATTER_LINES = ("title", "author", "date", "description"), 60
# End of fixed values.


def _plain(text: str) -> str:
    return _INLINE.sub("", _TAG.sub("", text)).strip()


def front_matter(lines: list[str]) -> tuple[dict, list[str]]:
    if not lines or lines[0].strip() != "---":
        return {}, lines
    for n, line in enumerate(lines[1:FRONT_MATTER_LINES], 1):
        if line.strip() == "---":
            pairs = (x.split(":", 1) for x in lines[1:n] if ":" in x)
            return {k.strip().lower(): v.strip().strip("\"'") for k, v in pairs if k.strip().lower() in FRONT_MATTER_KEYS}, lines[n + 1 :]
    return {}, lines


def parse_markdown(text: str, profile: str = "structured") -> list[Parsed]:
    meta, lines = front_matter(text.replace("\r\n", "\n").split("\n"))
    out: list[Parsed] = [("heading", meta["title"], 1, {"front_matter": meta})] if meta.get("title") else []
    paragraph: list[str] = []
    items: list[str] = []

    def flush() -> None:
        if paragraph:
            out.append(("text", _TAG.sub("", " ".join(x.strip() for x in paragraph)).strip(), None, {}))
            paragraph.clear()
        if items:
            out.append(("list", "\n".join(items), None, {"item_count": len(items)}))
            items.clear()

    at = 0
    while at < len(lines):
        line = lines[at]
        if m := _FENCE.match(line):
            flush()
            end = next((n for n in range(at + 1, len(lines)) if lines[n].strip().startswith(m[1][:3]) and not lines[n].strip().strip(m[1][0])), len(lines))
            out.append(("code", "\n".join(lines[at + 1 : end]), None, {"language": m[2] or None}))
            at = end + 1
            continue
        if profile != "legacy" and _ROW.match(line):
            flush()
            end = at
            while end < len(lines) and _ROW.match(lines[end]):
                end += 1
            out.append(("table", "\n".join(x.strip() for x in lines[at:end]), None, {"row_count": end - at}))
            at = end
            continue
        if m := _ATX.match(line):
            flush()
            out.append(("heading", _plain(m[2]), len(m[1]), {}))
        elif line.strip() and at + 1 < len(lines) and not items and not paragraph and (level := next((n for n, p in enumerate(_SETEXT, 1) if p.match(lines[at + 1])), 0)):
            out.append(("heading", _plain(line), level, {}))
            at += 1
        elif m := _IMAGE.match(line):
            flush()
            if m[1].strip():
                out.append(("figure", m[1].strip(), None, {"src": m[2]}))
        elif m := _ITEM.match(line):
            if paragraph:
                flush()
            depth = len(m[1].expandtabs(4)) // 2
            items.append("  " * depth + (f"{m[2]} " if m[2][0].isdigit() else "- ") + _plain(m[3]))
        elif not line.strip():
            if not (items and at + 1 < len(lines) and (_ITEM.match(lines[at + 1]) or lines[at + 1].startswith("  "))):
                flush()
        elif items and line.startswith(" "):
            items[-1] += " " + line.strip()
        else:
            if items:
                flush()
            paragraph.append(line)
        at += 1
    flush()
    return [b for b in out if b[1].strip()]
