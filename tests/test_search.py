import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import answers, search
from lexiloom.session import SearchSettings

DOCS = [(1, "alpha beta beta gamma"), (2, "beta delta"), (3, "epsilon zeta zeta zeta"), (4, "alpha alpha beta epsilon")]


def test_bm25_formula(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    q = spark.createDataFrame([(7, "alpha beta unknown")], "q long, text string")
    got = {r.id: r.score for r in search.bm25(q, search.index_of(docs, "id", "text"), "q", "text").collect()}
    bags = {i: re.findall(r"\w+", t) for i, t in DOCS}
    avg = sum(map(len, bags.values())) / 4
    for i, words in bags.items():
        want = 0.0
        for term in ("alpha", "beta"):
            df, tf = sum(term in w for w in bags.values()), Counter(words)[term]
            want += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        assert got.get(i, 0.0) == pytest.approx(want)


def hits(spark, rows, extra=""):
    return spark.createDataFrame(rows, "query_id int, id int, score double, rank int" + extra)


def test_fusion_and_ties(spark):
    a, b = hits(spark, [(1, 10, 9.0, 1), (1, 11, 8.0, 2)]), hits(spark, [(1, 12, 5.0, 1), (1, 10, 4.0, 2)])
    out = search.fuse([a, b]).orderBy("rank").collect()
    assert [r.id for r in out] == [10, 12, 11] and out[0].score == pytest.approx(1 / 61 + 1 / 62)
    tied = search.fuse([a, hits(spark, [(1, 13, 5.0, 1)])]).orderBy("rank").collect()
    assert [r.id for r in tied] == [10, 13, 11]
    assert [r.id for r in search.fuse([a, b], weights=[0.1, 1.0]).orderBy("rank").collect()][0] == 10


def test_diversify_and_unique(spark):
    h = hits(spark, [(1, i, 1.0 - i / 10, i, d, p) for i, d, p in [(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "c", "z"), (5, "b", "w")]], ", doc string, passage string")
    assert [r.id for r in search.diversify(h, "doc", 5).orderBy("rank").collect()] == [1, 3, 4, 2, 5]
    assert [r.id for r in search.diversify(h, "doc", 2).orderBy("rank").collect()] == [1, 3, 2, 4, 5]
    assert [(r.id, r.rank) for r in search.unique_passages(h, "passage", 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (4, 3)]


def test_phrases_and_blend(spark):
    texts = spark.createDataFrame([(1, "red big"), (2, "a big red box"), (3, "none")], "id int, text string")
    q = spark.createDataFrame([(1, 'find "Big Red"')], "query_id int, text string")
    h = hits(spark, [(1, 1, 3.0, 1), (1, 2, 2.0, 2), (1, 3, 1.0, 3)])
    assert [r.id for r in search.prefer_phrases(h, q, texts, "query_id", "text", "id", "text").orderBy("rank").collect()] == [2, 1, 3]
    scored = h.withColumn("rs", F.when(F.col("id") == 3, 9.0).otherwise(1.0))
    assert [r.id for r in search.blend(scored, "rs", 0.0).orderBy("rank").collect()] == [3, 1, 2]
    out = search.blend(scored, "rs", 0.6).orderBy("rank").collect()
    assert [r.id for r in out] == [1, 3, 2] and out[0].score == pytest.approx(0.6)


def test_hybrid_search_end_to_end(spark):
    rows = [("c1", "planets orbit the sun", "a.txt", None), ("c2", "planets orbit the sun", "b.txt", None), ("c3", "cooking pasta at home", "b.txt", "big passage"), ("c4", "pasta with planets", "c.txt", "big passage")]
    encoder = answers.HashingEncoder(32)
    chunks = answers.encoded(spark.createDataFrame(rows, "chunk_id string, text string, source_file string, context string"), "text", encoder)
    q = spark.createDataFrame([(1, 0, "planets sun"), (1, 1, "orbit"), (2, 0, "pasta"), (3, 0, "   "), (4, 0, "nothingmatches")], "query_id int, formulation int, text string")
    qv = answers.encoded(q, "text", encoder).select("query_id", "formulation", "vector")
    out = search.search(q, chunks, SearchSettings(top_k=3), qv).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} <= {1, 2, 4}
    first = [r for r in out if r.query_id == 1]
    assert first[0].chunk_id in ("c1", "c2") and len([r for r in first if r.chunk_id in ("c1", "c2")]) == 1
    assert [r.chunk_id for r in out if r.query_id == 2][0] in ("c3", "c4") and sum(r.chunk_id in ("c3", "c4") for r in out if r.query_id == 2) == 1
    one = search.search(q, chunks, SearchSettings(top_k=3), source="c.txt").collect()
    assert {r.chunk_id for r in one} == {"c4"}


def test_phrase_is_required(spark):
    docs = spark.createDataFrame([(1, "big red car"), (2, "red big car car")], "id int, text string")
    q = spark.createDataFrame([(1, '"big red" car'), (2, "car")], "q int, text string")
    out = search.lexical(q, docs, "q", "text", "id", "text").collect()
    assert {(r.query_id, r.id) for r in out} == {(1, 1), (2, 1), (2, 2)}


def test_settings():
    assert SearchSettings().pool == 20 and SearchSettings(rerank=True).pool == 30 and SearchSettings(diversify=False, unique=False).pool == 5
    with pytest.raises(ValueError):
        SearchSettings(rerank_blend=2)


class Model:
    def __init__(self, says):
        self.says = says

    def generate(self, prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return self.says


def test_answers(spark):
    h = spark.createDataFrame([(1, "c1", "t1", "f.txt", None, 0.5, 1), (1, "c2", "t2", "f.txt", "t1", 0.4, 2), (3, "c3", "boom", "f.txt", None, 0.1, 1)], "query_id int, chunk_id string, text string, source_file string, context string, score double, rank int")
    q = spark.createDataFrame([(1, "q?"), (2, "other"), (3, "x")], "query_id int, text string")
    out = {r.query_id: r for r in answers.answer(q, h, Model("yes")).collect()}
    assert out[1].answer == "yes" and len(out[1].contexts) == 1 and out[1].contexts[0].rank == 1
    assert out[2].answer == answers.NO_CONTEXT and out[2].contexts is None
    assert out[3].answer.startswith("[PIPELINE_ERROR] RuntimeError: no")
    got = answers.formulations(q, Model("1. one way\n2. q\n3. another"), "mixed", 3).where("query_id = 1").orderBy("formulation").collect()
    assert [r.text for r in got] == ["q?", "one way", "another", "1. one way 2. q 3. another"]
    assert answers.formulations(spark.createDataFrame([(1, "boom")], "query_id int, text string"), Model("x")).count() == 1
    head = answers.contexts(answers.select_passages(h.where("query_id = 1"))).first().context
    assert head == "[Источник 1 | source_file=f.txt]\nt1"


def test_cached_calls(spark):
    req = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, prompt string")
    cache = spark.createDataFrame([], "key string, answer string")
    out, fresh = answers.cached_calls(req, cache, Model("r"))
    assert out.count() == 3 and fresh.count() == 2
    assert answers.cached_calls(req, fresh, Model("other"))[1].count() == 0


def test_stored_index_and_upper_bounds_change_nothing(spark, tmp_path):
    import random

    from lexiloom.sources import sinks

    rng = random.Random(3)
    rare = [f"r{i}" for i in range(300)]
    text = lambda: " ".join(rng.choices(["the", "of", "and", "in"], k=rng.randrange(1, 40)) + rng.choices(rare, k=rng.randrange(0, 12)))
    docs = spark.createDataFrame([(i, text(), f"s{i % 3}") for i in range(400)] + [(900, None, "s"), (901, "", "s")], "id long, text string, source string")
    queries = spark.createDataFrame([(i, text()) for i in range(25)] + [(50, "the of"), (51, "nowhere"), (52, ""), (53, "r1 r2 the")], "q long, text string")
    sinks.write_postings(docs, str(tmp_path / "i"), "id", "text")
    index = sinks.stored_index(spark, str(tmp_path / "i"))

    def best(hits, depth=7):
        return sorted((r.query_id, r.rank, r.id, round(r.score, 8)) for r in search.ranked(hits.withColumn("score", F.round("score", 9)), depth).collect())

    plain = best(search.bm25(queries, search.index_of(docs, "id", "text"), "q", "text"))
    assert best(search.bm25_top(queries, index, "q", "text", 7, outright=0)) == plain and len(plain) > 150
    assert best(search.bm25_top(queries, index, "q", "text", 7)) == plain
    assert best(search.bm25_top(queries, index, "q", "text", 7, common=0.0, outright=0)) == plain
    one = docs.where("source = 's1'").select("id")
    narrowed = best(search.bm25(queries, index, "q", "text").join(one, "id", "left_semi"))
    assert best(search.bm25_top(queries, index.within(one), "q", "text", 7, outright=0)) == narrowed
    chunks = docs.select(F.col("id").cast("string").alias("chunk_id"), "text", F.col("source").alias("source_file"), F.lit(None).cast("string").alias("context"))
    asked = queries.select(F.col("q").alias("query_id"), F.lit(0).alias("formulation"), "text")
    sinks.write_index(chunks, str(tmp_path / "c"))
    stored = sinks.stored_index(spark, str(tmp_path / "c"))
    for source in (None, "s1"):
        a, b = (sorted((r.query_id, r.rank, r.chunk_id) for r in search.search(asked, chunks, source=source, index=i).collect()) for i in (None, stored))
        if source is None:
            assert a == b
        else:
            assert {q for q, _, _ in a} == {q for q, _, _ in b}  # statistics of the corpus, not of the source


def test_dense_in_blocks_is_exhaustive(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8)).round(1)
    rows = [(i, base[i % 60].tolist()) for i in range(300)] + [(900, [0.0] * 8), (901, None)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    asked = [(i, 0, (base[i] * 3).tolist()) for i in range(25)] + [(70, 1, [0.0] * 8), (71, 0, None)]
    queries = spark.createDataFrame(asked, "q long, f int, qv array<float>").select(F.struct("q", "f").alias("key"), "qv")
    want = []
    for q, f, qv in asked:
        if qv is None or not any(qv):
            continue
        scores = {i: float(np.dot(np.float32(qv).astype(float), np.float32(v).astype(float)) / np.linalg.norm(np.float32(qv).astype(float)) / np.linalg.norm(np.float32(v).astype(float))) for i, v in rows if v and any(v)}
        hits = sorted((i for i, s in scores.items() if s > 0.25), key=lambda i: (-round(scores[i], 9), i))[:7]
        want += [(q, f, n, i) for n, i in enumerate(hits, 1)]
    for size in (1, 2000, 1 << 20):
        found = search.dense(queries, vectors, "key", "qv", "id", "v", 7, block_bytes=size).withColumn("score", F.round("score", 9))
        assert sorted((r.query_id.q, r.query_id.f, r["rank"], r.id) for r in search.ranked(found, 7).collect()) == sorted(want)
    assert search.dense(queries.where("false"), vectors, "key", "qv", "id", "v", 7).count() == 0
