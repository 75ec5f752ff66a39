import hashlib
import random
from collections import defaultdict

import pytest

from lexiloom.llm.exact_dedup import digest_runs, exact_dedup, merge_runs
from lexiloom.llm.line_dedup import keep_bitmaps, line_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, max(x for x in groups[t or ""] if x is not None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 5 + [f"t{rng.randrange(40)}", None, ""])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    out = exact_dedup(df).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out) and len(out) == 400


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_rounds_merge_all_runs(spark, bits):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(200)], "doc_id long, text string").repartition(13)
    merged = merge_runs(digest_runs(df), 13, "min", bits).collect()
    assert len(merged) == 7 and sum(r._n for r in merged) == 200
    assert sorted(r._keep._id for r in merged) == list(range(7))


def test_exact_dedup_odd_cases(odd_documents, no_documents):
    out = exact_dedup(odd_documents).collect()
    assert len(out) == odd_documents.count()
    fox = [r for r in out if r.doc_id in (1, 2)]
    assert [r.keep_id for r in fox] == [2, 2, 2] and sum(r.kept for r in fox) == 1 and fox[0].group_size == 3
    assert {(r.doc_id, r.keep_id, r.kept) for r in out if r.doc_id in (3, 4)} == {(3, 4, False), (4, 4, True)}
    assert [r for r in out if r.doc_id is None][0].kept
    assert exact_dedup(no_documents).count() == 0


def lines_brute(rows, least=40, docs=5):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(strip).translate(low)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != i)]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    pool = [f"Line number {k} of the pool that Is long enough to count é" for k in range(12)] + ["short", "", "  ", "z" * 39, "z" * 40, "Y" * 40]
    rows = []
    for i in range(120):
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r"]) for x in rng.choices(pool, k=rng.randrange(0, 150))]
        rows.append((i, "\n".join(lines) if i % 17 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = lines_brute(rows)
    got = {r.doc_id: (r.text or "", r._lx_lines, r._lx_dropped) for r in line_dedup(df).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 1000


def test_bitmaps_are_sparse_and_right(spark):
    hot = "a line that is certainly longer than forty code points"
    rows = [(i, "\n".join(["own " + str(i)] * 130 + [hot] + ["tail"])) for i in range(6)]
    maps = keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r._id for r in maps) == [0, 1, 2, 3, 4]
    assert [(w.word, w.bits) for w in maps[0].keep_bitmap] == [(2, ~(1 << 2))] and maps[0].n_dropped == 1


def test_line_dedup_odd_cases(odd_documents, no_documents):
    out = line_dedup(odd_documents)
    assert out.columns[: len(odd_documents.columns)] == odd_documents.columns
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in odd_documents.collect())))
    assert {r._lx_lines for r in out.where("doc_id = 3").collect()} == {1}
    assert line_dedup(no_documents).count() == 0


def test_line_dedup_counts_ids_once_and_keeps_all_columns(spark):
    line = "a line that is well over forty characters long, as it must be"
    rows = [(1, line, "keep me", 7), (1, line + "\nx", "me too", 8), (1, line, "keep me", 9), (2, line, "a", 1), (3, line, "b", 2), (4, "y\n" + line, "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _lx_key string, _lx_dropped long")
    out = line_dedup(df).collect()
    assert sorted(tuple(r)[:4] for r in out) == sorted(rows)  # four ids, so no line goes, and no value is lost
    assert out[0].__fields__ == ["doc_id", "text", "_lx_key", "_lx_dropped", "_lx_lines", "_lx_dropped_"]
    more = line_dedup(spark.createDataFrame([*rows, (5, line, "d", 4)], df.schema)).collect()
    assert {(r.doc_id, r.text) for r in more} == {(1, ""), (1, "x"), (2, ""), (3, ""), (4, "y"), (5, line)}
    assert sorted((r._lx_key, r._lx_dropped) for r in more) == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("keep me", 7), ("keep me", 9), ("me too", 8)]
