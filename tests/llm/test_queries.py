"""The registered queries on whole small tables, held against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lexiloom.llm.byte_bpe import load_ranks

SF = "/root/testdata/sf0.001"
#: More rows with labels, for the classifiers.
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1_scores_every_document_and_finds_held_out_toxic_ones(spark):
    out = rows(spark, "op1_toxicity", MORE)
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    lang = {r.doc_id: r.lang for r in docs}
    held = [(toxic[r.doc_id], r.score) for r in out if r.held_out and toxic.get(r.doc_id) is not None and lang[r.doc_id] == "en"]
    ranks = sum((a > b) + (a == b) / 2 for y, a in held if y for z, b in held if not z)
    assert ranks / (sum(y for y, _ in held) * sum(1 - y for y, _ in held)) > 0.9


def test_op3_is_the_library_s_encoding(spark, documents):
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = rows(spark, "op3_byte_bpe")
    assert sorted(r.doc_id for r in out) == sorted(documents)
    for r in out:
        ids = encoding.encode_ordinary(documents[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(documents[r.doc_id].encode()))


def test_op4_places_every_document_within_the_limit(spark, documents):
    from lexiloom.llm.queries import SHARD_BYTES

    out = rows(spark, "op4_sharding")
    assert sorted(r.doc_id for r in out) == sorted(documents)
    assert all(r.n_bytes == len(documents[r.doc_id].encode()) for r in out)
    total = Counter()
    for r in out:
        total[r.shard, r.page] += r.n_bytes
    assert all(total[r.shard, r.page] == r.shard_bytes <= SHARD_BYTES for r in out)


def test_op6_returns_what_was_stored(spark, documents):
    out = rows(spark, "op6_transport_stream")
    assert sorted(r.doc_id for r in out) == sorted(documents)
    for r in out:
        raw = documents[r.doc_id].encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-16:]))
        assert r.media_bytes % 188 == 0 and len(r.timestamps) == -(-len(padded) // (48 * 192)) and r.random_access and r.error is None


def test_op7_says_the_language_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    out = rows(spark, "op7_language_id", MORE)
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    known = [r for r in out if r.held_out and docs[r.doc_id].lang and re.search(r"[^\W\d_]", docs[r.doc_id].text or "")]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in known]) > 0.97


def test_op9_packs_the_library_s_tokens(spark, documents):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = rows(spark, "op9_packing")
    want = {}
    for doc, text in documents.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[doc, piece] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in out) // 2048) * 1.02 + 2


def bag(text):
    w = re.findall(r"\w+", text.lower())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else None


def test_op10_classes_are_those_of_all_pairs(spark, documents):
    bags = {i: bag(t) for i, t in documents.items()}
    up = {i: i for i in documents}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(documents)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = bags[i], bags[j]
            near = documents[i] == documents[j] if not a or not b else sum((a & b).values()) >= 0.8 * sum((a | b).values())
            if near:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    out = rows(spark, "op10_near_dedup")
    assert {r.doc_id: r.class_id for r in out} == {i: root(i) for i in ids}


def test_the_pipeline_runs_and_each_stage_takes_effect(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in out}
    assert kept and kept < {r.doc_id for r in docs.collect()}
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].__fields__)
    stage = dict(corpus_pipeline.STAGES)
    once = stage["near_dedup"](spark, docs, SF)
    assert once.columns == docs.columns and once.count() == len({r.class_id for r in rows(spark, "op10_near_dedup")})
