"""HTML to blocks, on the standard library's tokenizer.

Open elements form a stack; an end tag closes down to its match and is ignored
without one, and a paragraph or list item gives way to the next block element.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .plain import Parsed

# Element classes and the cap on spans.
DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "ul",
}
MAX_SPAN = 40
# End of fixed values.

_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self, keep_lines: bool = False) -> str:
        parts = []
        for c in self.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag not in DROPPED:
                parts.append(c.text(keep_lines) + ("" if keep_lines or c.tag not in BLOCKS else " "))
        return "".join(parts)

    def find_all(self, *tags: str):
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag in tags:
                    yield c
                yield from c.find_all(*tags)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("root")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.stack[-1].tag == "p":
            self.stack.pop()
        if tag == "li" and self.stack[-1].tag == "li":
            self.stack.pop()
        node = _Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for n in range(len(self.stack) - 1, 0, -1):
            if self.stack[n].tag == tag:
                del self.stack[n:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _squeezed(text: str) -> str:
    return "\n".join(x for x in (_SPACE.sub(" ", line).strip() for line in text.split("\n")) if x)


def _span(cell: _Node, name: str) -> int:
    value = str(cell.attrs.get(name) or "1").strip()
    return min(MAX_SPAN, max(1, int(value))) if value.isdigit() else 1


def table_grid(table: _Node) -> list[list[str]]:
    """Cells with spans expanded; a spanning value stands in each of its places."""
    grid: list[dict[int, str]] = []
    for r, row in enumerate(table.find_all("tr")):
        while len(grid) <= r:
            grid.append({})
        c = 0
        for cell in (x for x in row.children if isinstance(x, _Node) and x.tag in ("td", "th")):
            while c in grid[r]:
                c += 1
            value = _SPACE.sub(" ", cell.text()).strip().replace("|", "\\|")
            for dr in range(_span(cell, "rowspan")):
                while len(grid) <= r + dr:
                    grid.append({})
                for dc in range(_span(cell, "colspan")):
                    grid[r + dr][c + dc] = value
            c += _span(cell, "colspan")
    width = max((max(row) + 1 for row in grid if row), default=0)
    return [[row.get(i, "") for i in range(width)] for row in grid if any(row.values())]


def markdown_table(grid: list[list[str]]) -> str:
    rows = [r for r in grid if any(v.strip() for v in r)]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    live = [i for i in range(width) if any(r[i].strip() for r in rows)]
    lines = ["| " + " | ".join(r[i] for i in live) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in live) + " |", *lines[1:]]) if lines else ""


def _items(node: _Node, depth: int = 0) -> list[str]:
    out, n = [], 0
    for li in (c for c in node.children if isinstance(c, _Node) and c.tag == "li"):
        n += 1
        own = _Node("li")
        own.children = [c for c in li.children if not (isinstance(c, _Node) and c.tag in ("ul", "ol"))]
        if text := _SPACE.sub(" ", own.text()).strip():
            out.append("  " * depth + (f"{n}. " if node.tag == "ol" and depth == 0 else "- ") + text)
        for c in li.children:
            if isinstance(c, _Node) and c.tag in ("ul", "ol"):
                out += _items(c, depth + 1)
    return out


def parse_html(text: str, profile: str = "structured") -> list[Parsed]:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    out: list[Parsed] = []
    title = next((_SPACE.sub(" ", t.text()).strip() for t in tree.root.find_all("title")), "")
    if profile == "legacy":
        flat = _squeezed(tree.root.text())
        return [("text", flat, None, {"title": title})] if flat else []
    pending: list[str] = []

    def flush() -> None:
        if flat := _squeezed("".join(pending)):
            out.append(("text", flat, None, {}))
        pending.clear()

    def walk(node: _Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                pending.append(c)
                continue
            if c.tag in DROPPED or c.tag in ("head", "title"):
                continue
            if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                flush()
                if flat := _SPACE.sub(" ", c.text()).strip():
                    out.append(("heading", flat, int(c.tag[1]), {}))
            elif c.tag in ("ul", "ol"):
                flush()
                if items := _items(c):
                    out.append(("list", "\n".join(items), None, {"item_count": len(items)}))
            elif c.tag == "table":
                flush()
                if md := markdown_table(table_grid(c)):
                    out.append(("table", md, None, {}))
            elif c.tag == "pre":
                flush()
                if c.text(True).strip():
                    out.append(("code", c.text(True).strip("\n"), None, {}))
            elif c.tag == "img":
                if (c.attrs.get("alt") or "").strip():
                    out.append(("figure", c.attrs["alt"].strip(), None, {"src": c.attrs.get("src")}))
            elif c.tag == "br":
                pending.append("\n")
            elif c.tag in BLOCKS:
                flush()
                walk(c)
                flush()
            else:
                walk(c)

    walk(tree.root)
    flush()
    if not out and (flat := _squeezed(tree.root.text())):
        out = [("text", flat, None, {})]
    return out
