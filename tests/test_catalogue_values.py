"""Queries that SQL can't express, held against plain Python over the tables they read."""

import html as entities
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from lexiloom.operators import answers
from lexiloom.plans import catalogue
from lexiloom.session import ChunkSettings

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "pages", "benchmark")}


@pytest.fixture(scope="module")
def page_blocks(spark):
    found = defaultdict(list)
    for r in sorted(rows(spark, "html_blocks"), key=lambda r: (r.doc_id, r.ord)):
        found[r.doc_id].append(r)
    return found


@pytest.fixture(scope="module")
def chunks(spark):
    return sorted(rows(spark, "chunk_documents"), key=lambda r: (r.doc_id, r.chunk_index))


class Words(HTMLParser):
    """The words a browser would show, in order."""

    def __init__(self):
        super().__init__()
        self.hidden, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "title", "button")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "title", "button") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.found += re.findall(r"\w+", entities.unescape(data))


def test_html_blocks_hold_the_shown_words(tables, page_blocks):
    whole = 0
    for page in tables["pages"]:
        w = Words()
        w.feed(page.html or "")
        got = Counter(x for b in page_blocks[str(page.page_id)] for x in re.findall(r"\w+", b.text))
        missing = Counter(w.found) - got
        whole += not missing
        assert sum(missing.values()) <= 0.1 * len(w.found)
    assert whole > 0.9 * len(tables["pages"])
    levels = [b.level for bs in page_blocks.values() for b in bs if b.type == "heading"]
    assert levels and set(levels) <= set(range(1, 7))


def test_titles_contents_and_markdown_of_pages(spark, page_blocks):
    generic = {"introduction", "contents", "abstract", "appendix", "references", "index", "table of contents"}
    titles = {r.doc_id: r.title for r in rows(spark, "document_titles")}
    contents = {r.doc_id: [(e.title, e.level, e.block_id) for e in r.toc] for r in rows(spark, "table_of_contents")}
    markdown = {r.doc_id: r.markdown for r in rows(spark, "documents_as_markdown")}
    for doc, blocks in page_blocks.items():
        heads = [b for b in blocks if b.type == "heading"]
        early = [b.text.strip() for b in blocks[:12] if b.type == "heading" and b.text.strip() and b.text.strip(" .:").lower() not in generic]
        assert titles.get(doc) == (next((t for t in early if len(t) <= 200), early[0][:200]) if early else None)
        assert contents.get(doc, []) == [(b.text.strip(), min(6, max(1, b.level or 1)), b.block_id) for b in heads]
        shown = lambda b: "#" * b.level + " " + b.text.strip() if b.type == "heading" else f"```\n{b.text}\n```" if b.type == "code" else b.text.strip()
        assert markdown[doc] == "\n\n".join(shown(b) for b in blocks if b.text.strip())


def test_text_and_markdown_blocks_keep_every_word(spark, tables):
    for name in ("text_blocks", "chunk_documents"):
        held = defaultdict(Counter)
        for r in rows(spark, name):
            held[r.doc_id].update(re.findall(r"[^\W_]+", r.text))
        for d in tables["documents"]:
            want = Counter(re.findall(r"[^\W_]+", d.text or ""))
            assert not want - held[str(d.doc_id)], (name, d.doc_id)


def test_chunks_respect_their_budget_and_order(chunks):
    by = defaultdict(list)
    for c in chunks:
        by[c.doc_id].append(c)
        assert len(c.text) <= ChunkSettings().max_chars and re.search(r"\w", c.text)
        assert c.context is None or len(c.context) >= len(c.text.split("\n\n", 1)[-1])
    assert all([c.chunk_index for c in cs] == list(range(1, len(cs) + 1)) for cs in by.values())


def test_legacy_chunks_hold_the_same_words(spark, page_blocks):
    old = defaultdict(set)
    for r in rows(spark, "legacy_chunks"):
        assert len(r.text.split("\n\n", 1)[-1]) <= ChunkSettings().max_chars
        old[r.doc_id].update(re.findall(r"[^\W_]{3,}", r.text))
    for doc, blocks in page_blocks.items():
        want = {w for b in blocks for w in re.findall(r"[^\W_]{3,}", b.text)}
        assert len(want - old[doc]) <= 0.05 * len(want)


def test_audits_and_coverage(spark, tables, page_blocks, chunks):
    found = {r.rule: r.n for r in rows(spark, "chunk_audit")}
    same = Counter((c.doc_id, c.text.strip()) for c in chunks)
    body = lambda c: c.text[len(" > ".join(c.heading_path)) :].strip(" >\n") if c.heading_path and c.text.startswith(" > ".join(c.heading_path)) else c.text
    want = Counter(duplicate_chunk=sum(n > 1 for n in same.values()), chunk_without_content=sum(len(body(c)) < 15 for c in chunks), chunk_without_source_file=sum(not c.source_file for c in chunks))
    assert found == {k: n for k, n in want.items() if n}
    blocks = [(a, b) for bs in page_blocks.values() for a, b in zip([None, *bs], bs)]
    repeats = sum(a is not None and b.text.strip() != "" and (a.type, a.text.strip()) == (b.type, b.text.strip()) for a, b in blocks)
    assert {r.rule: r.n for r in rows(spark, "block_audit")}.get("duplicate_adjacent_block", 0) == repeats
    key = lambda s: re.sub(r"[^0-9a-zа-яё]+", "", s.lower())
    whole = defaultdict(str)
    for c in chunks:
        whole[c.doc_id] += key(" ".join(x for x in (c.text, c.context) if x is not None))
    seen = defaultdict(list)
    for d in tables["documents"]:
        for s in re.split(r"(?<=[.!?])\s+|\n+", re.sub(r"\[\d{1,2}:\d{2}(?::\d{2})?\]", " ", d.text or "")):
            if len(s.split(" ")) >= 6 and len(re.split(r"\s+", s.strip(" "))) >= 6 and len(s.strip(" ")) < 300:
                seen[d.lang].append(key(s) in whole[str(d.doc_id)])
    got = {r.lang: (r.n, round(r.covered, 9)) for r in rows(spark, "coverage")}
    assert got == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in seen.items()}


def words(text):
    return re.findall(r"\d+(?:[.,]\d+)+|\w+(?:[-'’]\w+)*", text.replace("ё", "е").replace("Ё", "Е").lower())


def test_hybrid_search_is_its_stages_in_plain_python(spark, tables, chunks):
    encoder = answers.HashingEncoder()
    docs = [(f"{c.doc_id}/{c.chunk_id}", c.text, c.source_file, c.context or c.text) for c in chunks]
    bags = [Counter(words(t)) for _, t, _, _ in docs]
    n, mean = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags) / sum(bool(b) for b in bags)
    df = Counter(w for b in bags for w in b)
    vectors = [[float(x) for x in v] for v in encoder.encode([t for _, t, _, _ in docs])]
    got = defaultdict(list)
    for r in sorted(rows(spark, "hybrid_search"), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.chunk_id, round(r.score, 7)))
    for q in tables["benchmark"][:8]:
        bm = {}
        for (i, *_), b in zip(docs, bags):
            hit = [w for w in set(words(q.text)) if b[w]]
            if hit:
                size = sum(b.values())
                bm[i] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in hit)
        v = encoder.encode([q.text])[0]
        norm = lambda x: math.sqrt(sum(a * a for a in x)) or 1.0
        cos = {i: sum(a * b for a, b in zip(v, u)) / norm(v) / norm(u) for (i, *_), u in zip(docs, vectors)}
        top = lambda s: sorted(s, key=lambda i: (-s[i], i))[:20]
        score, seen = defaultdict(float), {}
        for n_list, hits in enumerate([top(bm), top({i: s for i, s in cos.items() if s > 0.25})]):
            for rank, i in enumerate(hits, 1):
                score[i] += 1 / (60 + rank)
                seen.setdefault(i, (n_list, rank))
        order = sorted(score, key=lambda i: (-round(score[i], 12), seen[i], i))[:20]
        source, passage = {i: s for i, _, s, _ in docs}, {i: p for i, _, _, p in docs}
        firsts = [i for k, i in enumerate(order) if source[i] not in {source[j] for j in order[:k]}][:5]
        order = [*firsts, *(i for i in order if i not in firsts)]
        unique = [i for k, i in enumerate(order) if passage[i] not in {passage[j] for j in order[:k]}][:5]
        assert [s for _, s in got[q.item_id]] == [round(score[i], 7) for i in unique]
        assert {i for i, _ in got[q.item_id]} == set(unique)
