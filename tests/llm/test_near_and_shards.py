import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from lexiloom.llm import near_dedup as nd
from lexiloom.llm._common import checkpoint
from lexiloom.llm.components import connected_components
from lexiloom.llm.sharding import shard


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    for top in (1, 6, 300):
        items = rng.integers(0, 2**63, 300).astype(np.uint64)
        a = rng.integers(0, top + 1, 300)
        b = np.where(rng.random(300) < 0.7, a, rng.integers(0, top + 1, 300))
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = nd.bag_minhash(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        assert abs((s[0] == s[1]).mean() - j) < 4 * (j * (1 - j) / 4096) ** 0.5 + 1e-9


def test_signature_depends_on_the_multiset_alone():
    items = np.arange(1, 50, dtype=np.uint64)
    w = np.arange(1, 50)
    alone = nd.bag_minhash(np.zeros(49, int), items, w, 1, 64)
    order = np.random.default_rng(0).permutation(49)
    both = nd.bag_minhash(np.concatenate([np.zeros(49, int), np.ones(49, int)]), np.concatenate([items[order], items]), np.concatenate([w[order], w]), 2, 64)
    assert (both[0] == alone[0]).all() and (both[1] == alone[0]).all()


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute_classes(rows):
    bags = {i: bag(t) for i, t in rows}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in rows:
        for j, u in rows:
            if i < j and (similarity(bags[i], bags[j]) >= 0.8 if bags[i] and bags[j] else not bags[i] and not bags[j] and (t or "") == (u or "")):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in rows}


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(800)]
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base).upper() + "."))
    chain = rng.choices(vocabulary, k=300)
    for step in range(12):  # each is near its neighbours, the ends are apart
        rows.append((len(rows), " ".join(chain)))
        chain = chain[25:] + rng.choices(vocabulary, k=25)
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "!!!"), (len(rows) + 3, "one two"), (len(rows) + 4, "One, two")]
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in out} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in out)


def test_near_dedup_odd_cases(odd_documents, no_documents):
    out = nd.near_dedup(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert {r.class_id for r in out if r.doc_id in (1, 2)} == {1}
    assert {r.class_id for r in out if r.doc_id in (3, 4)} == {3}
    kept = nd.keep_one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9]
    assert nd.near_dedup(no_documents).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5000, 5000), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shards(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard, r.page].append(r)
    return out


@pytest.mark.parametrize("limit", [10**9, 5000, 700])
def test_sharding_limits_and_prefixes(spark, limit):
    rng = random.Random(8)
    rows = [(i, "x" * rng.choice([0, 5, 100, 600])) for i in range(600)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit).collect()
    assert sorted(r.doc_id for r in out) == list(range(600))
    found = shards(out)
    for (bits, page), part in found.items():
        assert sum(r.n_bytes for r in part) == part[0].shard_bytes <= limit and page == 0 and len(bits) == part[0].depth
    names = sorted({b for b, _ in found})
    assert not any(b.startswith(a) for a in names for b in names if a != b)  # a prefix code
    by_parent = Counter(n[:-1] for n in names if n)
    sums = {n: sum(r.n_bytes for (b, _), p in found.items() for r in p if b.startswith(n)) for n in by_parent}
    assert all(s > limit for s in sums.values())  # only oversized buckets were split


def test_sharding_overflow(spark):
    rows = [(1, "same" * 10)] * 50 + [(2, "y" * 5000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()
    assert len(out) == 51
    for part in shards(out).values():
        assert sum(r.n_bytes for r in part) <= 200 or len(part) == 1


def test_sharding_odd_cases(odd_documents, no_documents):
    out = shard(odd_documents, 50_000).collect()
    assert len(out) == odd_documents.count()
    assert shard(no_documents, 100).count() == 0
    with pytest.raises(ValueError):
        shard(no_documents, 0)


def test_a_crowd_that_shares_a_passage(spark):
    """Documents about a common passage, none near another but where planted; the centre lacks what they share."""
    rng = random.Random(11)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = words(60)
    rows = []
    for size in [3, 4, 5, 6, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 25, 30] * 6:
        own = words(size)
        cut = rng.randrange(size + 1)
        rows.append((len(rows), " ".join(own[:cut] + passage + own[cut:])))
    for _ in range(20):  # near pairs whose common part is rare
        own = words(40) + passage
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:-2] + words(2)))]
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in out}
    assert got == want


def test_one_row_of_each_class_stays_where_ids_repeat(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(5, long, "a"), (5, long, "a"), (5, long + " end", "b"), (7, long, "c"), (5, other, "d"), (3, other + " end", "e"), (9, other, "f"), (None, "alone here", "g")]
    kept = nd.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, h string"))
    out = sorted((r.doc_id or 0, r.text.split()[0]) for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "h"] and out == [(0, "alone"), (3, "v0"), (5, "w0")]


def test_sharding_pages_are_numbered_alike(spark):
    rows = [(1, "same" * 10)] * 500 + [(i, f"t{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = shard(docs, 400).collect()
    assert len(out) == 550
    pages = Counter((r.shard, r.page) for r in out if r.n_bytes == 40)
    assert sorted(pages.values()) == [10] * 50  # no half-empty pages
    assert all(sum(r.n_bytes for r in part) == part[0].shard_bytes <= 400 for part in shards(out).values())


def grid_of_passages(side=12, planted=6):
    """Documents about a common body, each with one passage of either kind; only the planted ones share both with another."""
    rng = random.Random(0)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    body, mark = words(180), words(5)
    first, second = [words(4) for _ in range(side)], [words(4) for _ in range(side)]
    text = lambda i, j, own: " ".join(body + mark + first[i] + mark + second[j] + mark + words(own) + mark)
    # the smallest documents, around which stars go first, are near none
    rows = [text(i, j, 19 if i == j < planted else 18) for i in range(side) for j in range(side)] + [text(i, i, 19) for i in range(planted)]
    return list(enumerate(rows))


def test_near_pairs_that_meet_only_in_crowds(spark):
    rows = grid_of_passages()
    want = brute_classes(rows)
    assert len(set(want.values())) == 144
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in out} == want


def test_the_pipeline_keeps_one_of_near_pairs_that_meet_only_in_crowds(spark):
    rows = grid_of_passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_classes(rows).values()))


def test_tiles_find_what_all_pairs_find(spark):
    """Tails that differ, alone and in crowds, in one tile and in many."""
    rng = random.Random(4)
    share, tails = 0.8 / 1.8, [rng.sample(range(40), 30) for _ in range(25)]
    rows = []
    for k in range(120):
        t = rng.randrange(25)
        rows.append((7, 0, b"%03d" % k, rng.randrange(31, 42), b"%03d" % k, 31, t, True, 120))
    places = spark.createDataFrame(rows, "e long, band int, key binary, n int, root binary, left int, tail long, small boolean, m long")
    common = lambda x, y: 1 + len(set(tails[x[6]]) & set(tails[y[6]]))
    near = lambda x, y: common(x, y) >= share * (x[3] + y[3])
    of = {r[2]: r for r in rows}

    def classes(pairs):
        up = {k: k for k in of}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            if near(of[a], of[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
        return {k: root(k) for k in of}

    want = classes([(a, b) for a in of for b in of if a < b])
    assert 1 < len(set(want.values())) < 120
    for tile in (512, 10, 3):
        pairs = nd._open(places, share - 1e-9, tile).collect()
        assert len({(r.a, r.b) for r in pairs}) < 120 * 25 and classes([(bytes(r.a), bytes(r.b)) for r in pairs]) == want


def test_a_checkpoint_lets_its_shuffle_files_go(spark):
    """Without a collection of the driver's garbage; the frame it was made from can be run again."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(setting, None)
    many = spark.range(20_000).selectExpr("id % 5000 AS k").groupBy("k").count()
    kept = checkpoint(many.join(many.where("k > 100").withColumnRenamed("count", "n"), "k"))
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(setting, None) == was
    assert kept.count() == 4899 and many.count() == 5000 and many.count() == 5000
