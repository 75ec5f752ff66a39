"""Office Open XML (DOCX, XLSX, PPTX) to blocks, on zipfile and ElementTree."""

from __future__ import annotations

import datetime as dt
import io
import re
import statistics
import zipfile
from xml.etree import ElementTree as ET

from .html import markdown_table
from .plain import Parsed, heading_level

# Names, limits and formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
MAX_ROWS, MAX_COLUMNS = 5000, 60
NOTE_ROWS, NOTE_CHARS = 3, 25
SLIDE_ROW = 300_000
CODE_FONTS = ("courier", "consolas", "mono", "menlo")
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47}
# End of fixed values.


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, _, name = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    return {} if root is None else {x.get("Id"): x.get("Target") for x in root}


# --- DOCX -------------------------------------------------------------------


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        times, n = divmod(n, value)
        out += sign * times
    return out


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


class Numbering:
    """Counters of numbered paragraphs, replayed in document order."""

    def __init__(self, root=None):
        self.levels: dict[str, dict[int, tuple[str, str, int]]] = {}
        self.counts: dict[str, dict[int, int]] = {}
        if root is None:
            return
        abstract = {}
        for a in root.iter(W + "abstractNum"):
            levels = {}
            for lv in a.iter(W + "lvl"):
                value = lambda tag, d, lv=lv: (lv.find(W + tag).get(W + "val") if lv.find(W + tag) is not None else d)
                levels[int(lv.get(W + "ilvl"))] = (value("numFmt", "decimal"), value("lvlText", ""), int(value("start", "1")))
            abstract[a.get(W + "abstractNumId")] = levels
        for num in root.iter(W + "num"):
            levels = dict(abstract.get(num.find(W + "abstractNumId").get(W + "val"), {}))
            for o in num.iter(W + "lvlOverride"):
                n, start = int(o.get(W + "ilvl")), o.find(W + "startOverride")
                if start is not None and n in levels:
                    levels[n] = (*levels[n][:2], int(start.get(W + "val")))
            self.levels[num.get(W + "numId")] = levels

    def label(self, num: str, level: int) -> str:
        """Advance the counter of a paragraph and return its visible label; bullets have none."""
        levels = self.levels.get(num)
        if not levels or level not in levels:
            return ""
        counts = self.counts.setdefault(num, {})
        counts[level] = counts.get(level, levels[level][2] - 1) + 1
        for deeper in [n for n in counts if n > level]:
            del counts[deeper]
        kind, pattern, _ = levels[level]
        if kind in ("bullet", "none"):
            return ""

        def shown(m: re.Match) -> str:
            n = int(m[1]) - 1
            value, fmt = counts.get(n, levels[n][2] if n in levels else 1), levels.get(n, ("decimal",))[0]
            if fmt.endswith("Letter"):
                return letters(value).upper() if fmt.startswith("upper") else letters(value)
            if fmt.endswith("Roman"):
                return roman(value) if fmt.startswith("upper") else roman(value).lower()
            return str(value)

        return re.sub(r"%(\d)", shown, pattern)


def _math_text(node) -> str:
    return "".join(t.text or "" for t in node.iter(M + "t")).strip()


def _paragraph_text(p, links: dict[str, str]) -> str:
    out = []
    for node in p:
        if node.tag == W + "hyperlink":
            text, target = "".join(t.text or "" for t in node.iter(W + "t")), links.get(node.get(R + "id"), "")
            out.append(f"{text} ({target})" if target.startswith("http") and target not in text else text)
        elif node.tag in (M + "oMath", M + "oMathPara"):
            if math := _math_text(node):
                out.append(f"${math}$")
        elif node.tag == W + "r":
            for x in node:
                out.append({W + "t": x.text or "", W + "tab": "\t", W + "br": "\n", W + "noBreakHyphen": "-"}.get(x.tag, ""))
        elif node.tag in (W + "ins", W + "smartTag", W + "sdt"):
            out += [t.text or "" for t in node.iter(W + "t")]
    return "".join(out).strip()


def parse_docx(data: bytes, profile: str = "structured") -> list[Parsed]:
    z = zipfile.ZipFile(io.BytesIO(data))
    body = _xml(z, "word/document.xml").find(W + "body")
    links, numbering = _rels(z, "word/document.xml"), Numbering(_xml(z, "word/numbering.xml"))
    names = {}
    if (styles := _xml(z, "word/styles.xml")) is not None:
        for s in styles.iter(W + "style"):
            outline, name = s.find(f"{W}pPr/{W}outlineLvl"), s.find(W + "name")
            names[s.get(W + "styleId")] = ((name.get(W + "val") if name is not None else "").lower(), None if outline is None else int(outline.get(W + "val")) + 1)
    notes = {}
    for kind in ("footnote", "endnote"):
        if (root := _xml(z, f"word/{kind}s.xml")) is not None:
            for n in root.iter(W + kind):
                if text := " ".join(_paragraph_text(p, {}) for p in n.iter(W + "p")).strip():
                    notes[kind, n.get(W + "id")] = text
    sizes = [int(s.get(W + "val")) for r in body.iter(W + "r") for s in r.findall(f"{W}rPr/{W}sz") if "".join(t.text or "" for t in r.iter(W + "t")).strip()]
    usual = statistics.median(sizes) if sizes else 22
    out: list[Parsed] = []
    items: list[str] = []

    def flush() -> None:
        if items:
            out.append(("list", "\n".join(items), None, {"item_count": len(items)}))
            items.clear()

    def level_of(p, text: str) -> int | None:
        style = p.find(f"{W}pPr/{W}pStyle")
        name, outline = names.get(style.get(W + "val"), (style.get(W + "val").lower(), None)) if style is not None else ("", None)
        if m := re.match(r"(?:heading|заголовок)\s*(\d)", name):
            return min(6, int(m[1]))
        if name == "title":
            return 1
        own = p.find(f"{W}pPr/{W}outlineLvl")
        if outline or own is not None:
            return min(6, outline or int(own.get(W + "val")) + 1)
        runs = [r for r in p.iter(W + "r") if "".join(t.text or "" for t in r.iter(W + "t")).strip()]
        bold = bool(runs) and all(r.find(f"{W}rPr/{W}b") is not None for r in runs)
        large = bool(runs) and all(any(int(s.get(W + "val")) >= usual + 4 for s in r.findall(f"{W}rPr/{W}sz")) for r in runs)
        short = len(text) <= 120 and len(text.split()) <= 16 and text[-1:] not in ".!?;,"
        return heading_level(text, 2) if short and (large or (bold and len(text) <= 80)) else None

    def walk(node) -> None:
        for x in node:
            if x.tag == W + "p":
                paragraph(x)
            elif x.tag == W + "tbl":
                flush()
                grid, nested = [], []
                for row in x.findall(W + "tr"):
                    cells = []
                    for cell in row.findall(W + "tc"):
                        nested += cell.findall(W + "tbl")
                        text = " ".join(t for t in (_paragraph_text(p, links) for p in cell.findall(W + "p")) if t)
                        span = cell.find(f"{W}tcPr/{W}gridSpan")
                        cells += [text.replace("|", "\\|")] * (int(span.get(W + "val")) if span is not None else 1)
                    grid.append(cells)
                if md := markdown_table(grid):
                    out.append(("table", md, None, {}))
                for t in nested:
                    walk([t])
            elif x.tag == W + "sdt" and (content := x.find(W + "sdtContent")) is not None:
                walk(content)

    def paragraph(p) -> None:
        text = _paragraph_text(p, links)
        num = p.find(f"{W}pPr/{W}numPr")
        label, depth = "", 0
        if num is not None and num.find(W + "numId") is not None:
            level = num.find(W + "ilvl")
            depth = int(level.get(W + "val")) if level is not None else 0
            label = numbering.label(num.find(W + "numId").get(W + "val"), depth)
        refs = [notes.get((kind, r.get(W + "id"))) for kind in ("footnote", "endnote") for r in p.iter(f"{W}{kind}Reference")]
        boxes = list(dict.fromkeys(t for b in p.iter(W + "txbxContent") for q in b.iter(W + "p") if (t := _paragraph_text(q, links))))
        if text:
            maths = [m for m in p.iter(M + "oMath")]
            fonts = [f.get(W + "ascii", "").lower() for f in p.iter(W + "rFonts")]
            level = level_of(p, text)
            if level is not None:
                flush()
                out.append(("heading", f"{label} {text}".strip(), level, {}))
            elif num is not None:
                items.append("  " * depth + (f"{label} " if label else "- ") + text)
            elif maths and text == "".join(f"${_math_text(m)}$" for m in maths if _math_text(m)):
                flush()
                out.append(("formula", " ".join(_math_text(m) for m in maths), None, {}))
            elif fonts and all(any(c in f for c in CODE_FONTS) for f in fonts):
                flush()
                if out and out[-1][0] == "code":
                    out[-1] = ("code", out[-1][1] + "\n" + text, None, {})
                else:
                    out.append(("code", text, None, {}))
            elif re.match(r"(?i)(table|таблица)\s+\d", text) and out and out[-1][0] == "table" and not items:
                out[-1] = ("table", text + "\n" + out[-1][1], None, {"caption": text})
            else:
                flush()
                out.append(("text", text, None, {}))
        for extra in [*boxes, *(r for r in refs if r)]:
            flush()
            out.append(("text", extra, None, {"note": extra in refs}))

    walk(body)
    flush()
    return out


# --- XLSX -------------------------------------------------------------------


def _number_text(v: float) -> str:
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return f"{v:.6g}" if abs(v) >= 1e6 or abs(v) < 1e-4 else str(round(v, 6))


def _date_text(days: float) -> str:
    t = dt.datetime(1899, 12, 30) + dt.timedelta(days=days)
    return t.strftime("%Y-%m-%d") if t.time() == dt.time() else t.strftime("%Y-%m-%d %H:%M")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_grids(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cell texts) of each sheet, merged ranges filled."""
    z = zipfile.ZipFile(io.BytesIO(data))
    book, links = _xml(z, "xl/workbook.xml"), _rels(z, "xl/workbook.xml")
    shared = []
    if (root := _xml(z, "xl/sharedStrings.xml")) is not None:
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in root.findall(S + "si")]
    dates: set[int] = set()
    if (styles := _xml(z, "xl/styles.xml")) is not None:
        own = {int(f.get("numFmtId")) for f in styles.iter(S + "numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
        dates = {n for n, xf in enumerate(styles.find(S + "cellXfs") or []) if int(xf.get("numFmtId", 0)) in own | DATE_FORMATS}
    out = []
    for sheet in book.iter(S + "sheet"):
        target = links[sheet.get(R + "id")].lstrip("/")
        root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
        cells: dict[tuple[int, int], str] = {}
        for c in root.iter(S + "c"):
            ref = c.get("r")
            r, k = int(re.search(r"\d+", ref)[0]) - 1, _column(ref)
            if r >= MAX_ROWS or k >= MAX_COLUMNS:
                continue
            v, kind = c.find(S + "v"), c.get("t", "n")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(S + "t"))
            elif v is None or v.text is None:
                continue
            elif kind == "s":
                value = shared[int(v.text)]
            elif kind == "b":
                value = "true" if v.text == "1" else "false"
            elif kind == "n":
                value = _date_text(float(v.text)) if int(c.get("s", 0)) in dates else _number_text(float(v.text))
            else:
                value = v.text
            cells[r, k] = re.sub(r"\s+", " ", value).strip().replace("|", "\\|")
        for m in root.iter(S + "mergeCell"):
            a, _, b = m.get("ref").partition(":")
            (r0, c0), (r1, c1) = ((int(re.search(r"\d+", x)[0]) - 1, _column(x)) for x in (a, b or a))
            for r in range(r0, min(r1, MAX_ROWS - 1) + 1):
                for k in range(c0, min(c1, MAX_COLUMNS - 1) + 1):
                    cells.setdefault((r, k), cells.get((r0, c0), ""))
        rows, width = max((r for r, _ in cells), default=-1) + 1, max((k for _, k in cells), default=-1) + 1
        out.append((sheet.get("name"), [[cells.get((r, k), "") for k in range(width)] for r in range(rows)]))
    return out


def _regions(grid: list[list[str]]) -> list[list[list[str]]]:
    out: list[list[list[str]]] = [[]]
    for row in grid:
        if any(row):
            out[-1].append(row)
        elif out[-1]:
            out.append([])
    return [r for r in out if r]


def _rejoined(regions: list[list[list[str]]]) -> list[list[list[str]]]:
    """Regions in which a table that a blank row parted is whole again: data rows as wide as the table before them."""
    out: list[list[list[str]]] = []
    for region in regions:
        first = [v for v in region[0] if v]
        data = sum(map(_is_number, first)) >= 0.5 * len(first)
        if out and data and len(out[-1]) > 1 and sum(map(bool, out[-1][0])) == len(first):
            out[-1] = out[-1] + region
        else:
            out.append(region)
    return out


def _is_number(v: str) -> bool:
    return bool(re.match(r"[+-]?[\d\s ]+([.,]\d+)?$", v))


def _header(region: list[list[str]]) -> list[list[str]]:
    """A region with its header in one row; two header rows are joined."""
    share = lambda r: sum(map(_is_number, filter(None, r))) / max(1, sum(map(bool, r)))
    if len(region) > 2 and share(region[0]) < 0.5 and share(region[1]) < 0.5 and share(region[2]) >= 0.5:
        return [[" ".join(dict.fromkeys(x for x in pair if x)) for pair in zip(region[0], region[1], strict=True)], *region[2:]]
    if share(region[0]) < 0.5:
        return region
    return [[f"col{i + 1}" for i in range(len(region[0]))], *region]


def parse_xlsx(data: bytes, profile: str = "structured") -> list[Parsed]:
    from ..operators.tables import profile_text

    sheets = sheet_grids(data)
    if profile == "legacy":
        return [("table", "\n".join("\t".join(r) for r in g if any(r)), None, {"sheet": n}) for n, g in sheets if any(any(r) for r in g)]
    out: list[Parsed] = []
    if len(sheets) > 1:
        out.append(("text", "\n".join(f"{n}: {sum(map(any, g))} rows" for n, g in sheets), None, {"overview": True}))
    for name, grid in sheets:
        out.append(("heading", name, 1, {"sheet": name}))
        for region in _rejoined(_regions(grid)):
            distinct = [list(dict.fromkeys(v for v in r if v)) for r in region]
            if len(region) <= NOTE_ROWS and all(len(d) == 1 and len(d[0]) >= NOTE_CHARS for d in distinct):
                out.append(("text", "\n".join(d[0] for d in distinct), None, {"sheet": name}))
                continue
            live = [i for i in range(len(region[0])) if any(r[i] for r in region)]
            rows = _header([[r[i] for i in live] for r in region])
            out.append(("table", markdown_table(rows), None, {"sheet": name, "row_count": len(rows) - 1}))
            if profile_ := profile_text(rows[0], rows[1:]):
                out.append(("text", profile_, None, {"sheet": name, "representation": "profile"}))
    return out


# --- PPTX -------------------------------------------------------------------


def parse_pptx(data: bytes, profile: str = "structured") -> list[Parsed]:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out: list[Parsed] = []
    for number, name in enumerate(slides, 1):
        root, where = _xml(z, name), {"page_number": number}
        shapes = []
        for sp in root.iter():
            if sp.tag not in (P + "sp", P + "graphicFrame", P + "pic"):
                continue
            off = next(sp.iter(A + "off"), None)
            shapes.append((int(off.get("y")) // SLIDE_ROW if off is not None else 0, int(off.get("x")) if off is not None else 0, len(shapes), sp))
        title, body = None, []
        for _, _, _, sp in sorted(shapes, key=lambda s: s[:3]):
            ph = next(sp.iter(P + "ph"), None)
            lines = []
            for p in sp.iter(A + "p"):
                if text := "".join(t.text or "" for t in p.iter(A + "t")).strip():
                    pr = p.find(A + "pPr")
                    lines.append((int(pr.get("lvl", 0)) if pr is not None else 0, text))
            if sp.tag == P + "graphicFrame":
                grid = [["".join(t.text or "" for t in c.iter(A + "t")).strip().replace("|", "\\|") for c in r.findall(A + "tc")] for r in sp.iter(A + "tr")]
                if md := markdown_table(grid):
                    body.append(("table", md, None, where))
            elif ph is not None and ph.get("type") in ("title", "ctrTitle") and lines and title is None:
                title = " ".join(t for _, t in lines)
            elif ph is not None and ph.get("type") in ("sldNum", "ftr", "dt"):
                continue
            elif len(lines) > 1:
                body.append(("list", "\n".join("  " * n + "- " + t for n, t in lines), None, where))
            elif lines:
                body.append(("text", lines[0][1], None, where))
            elif sp.tag == P + "pic":
                about = next(sp.iter(P + "cNvPr"), None)
                if about is not None and (about.get("descr") or "").strip():
                    body.append(("figure", about.get("descr").strip(), None, where))
        if profile == "legacy":
            flat = "\n".join([title or "", *(b[1] for b in body)]).strip()
            out += [("text", flat, None, where)] if flat else []
            continue
        if title is None and body and body[0][0] == "text" and len(body[0][1]) <= 120:
            title, body = body[0][1], body[1:]
        out += ([("heading", title, 2, where)] if title else []) + body
        note = next((_xml(z, "ppt/" + t.lstrip("./")) for t in _rels(z, name).values() if "notesSlide" in (t or "")), None)
        if note is not None:
            said = [" ".join(t.text or "" for t in sp.iter(A + "t")).strip() for sp in note.iter(P + "sp") if any(ph.get("type") == "body" for ph in sp.iter(P + "ph"))]
            if text := "\n".join(filter(None, said)):
                out.append(("text", text, None, where | {"notes": True}))
    return out
