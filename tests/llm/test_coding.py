import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lexiloom.llm import packing, transport_stream
from lexiloom.llm.byte_bpe import BytePairCoder, coder, decode_documents, encode_documents, load_ranks

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(2)
    some = ["", " ", "\n", "a" * 4000, "ab" * 3000, "日本語 🎉", "don't we'll  x\t\x1cy", " lead", "trail ", "a\n\nb", "x \ny"]
    return some + ["".join(rng.choice("abcdeghinorst aéß'\n.,019🎉日") for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_byte_bpe_is_exact(reference):
    bpe = coder(RANKS, P.PATTERN)
    for t in texts():
        want = reference.encode_ordinary(t)
        assert bpe.encode(t) == want
        assert bpe.coded(t) == (" ".join(map(str, want)), t.encode())


def test_byte_bpe_documents(odd_documents, no_documents, reference):
    out = encode_documents(odd_documents, RANKS, P.PATTERN, with_ids=True)
    rows = {r.doc_id: r for r in out.collect()}
    for r in odd_documents.select("doc_id", "text").collect():
        ids = reference.encode_ordinary(r.text or "")
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids == ids
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode_documents(out, RANKS, P.PATTERN).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd_documents.select("doc_id", "text").collect())
    assert encode_documents(no_documents, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 9215, 9216, 9217, 9216 * 8, 9216 * 8 + 1, 300_000])
def test_transport_stream_round_trip(size):
    data = random.Random(size).randbytes(size)
    found = transport_stream.demux(transport_stream.mux(transport_stream.padded(data)))
    assert found.payload == transport_stream.padded(data) and len(found.payload) % 192 == 0 and found.payload
    assert found.breaks == found.crc_errors == 0 and found.stream_type == 6
    n = -(-len(found.payload) // transport_stream.PES_DATA)
    assert found.timestamps == [k * transport_stream.TICKS for k in range(n)] and len(found.random_access) == -(-n // 8)


def test_transport_stream_faults():
    stream = transport_stream.mux(transport_stream.padded(b"q" * 50_000))
    assert transport_stream.demux(stream[: 188 * 9] + stream[188 * 10 :]).breaks == 1
    broken = bytearray(stream)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        transport_stream.demux(bytes(broken))
    with pytest.raises(ValueError):
        transport_stream.demux(b"x" * 188)
    with pytest.raises(ValueError):
        transport_stream.demux(b"")


def test_media_column(odd_documents, no_documents):
    rows = {(r.doc_id, r.n_bytes): r for r in transport_stream.read_media(transport_stream.media_column(odd_documents)).collect()}
    for r in odd_documents.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = transport_stream.padded(raw)
        got = rows[r.doc_id, len(raw)]
        assert (got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert transport_stream.read_media(transport_stream.media_column(no_documents)).count() == 0


def test_word_tokens_are_exact():
    words = packing.word_tokens(WORDS)
    some = texts() + ["İstanbul ΣΑΣ <|endoftext|>", "é Å", "A,b.C! 123 ...", "x y z"]
    for t, ids in zip(some, words.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(odd_documents, no_documents):
    words = packing.word_tokens(WORDS)
    rows = packing.pack(odd_documents, WORDS, capacity=512).collect()
    check_places(rows, 512)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    want = defaultdict(list)
    for d in odd_documents.select("doc_id", "text").collect():
        ids = next(iter(words.encode([d.text or ""]))) + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[d.doc_id].append((k, at // 4, len(ids[at : at + 2048]) // 4, zlib.crc32(ids[at : at + 2048])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(no_documents, WORDS).count() == 0


def test_plan_uses_each_piece_once_and_packs_well():
    rng = np.random.default_rng(0)
    for n in (1, 10, 3000):
        counts = np.bincount(np.clip(rng.exponential(300, n).astype(int) + 1, 1, 1023), minlength=1025)
        used, sequences = np.zeros(1025, int), 0
        for lengths, many in packing.plan(counts, 1024):
            assert sum(lengths) <= 1024 and many > 0
            sequences += many
            for v in lengths:
                used[v] += many
        assert (used == counts).all()
        assert sequences <= -(-int((counts * np.arange(1025)).sum()) // 1024) * 1.02 + 1
    assert packing.plan(np.zeros(1025, int), 1024) == []


def test_damaged_streams_are_rows_with_an_error(spark):
    good = transport_stream.mux(transport_stream.padded(b"x" * 100_000))
    rows = [(1, 3, bytearray(good)), (2, 3, bytearray(b"short")), (3, 3, None), (4, 3, bytearray(b"\0" * 376)), (5, 3, bytearray(transport_stream.mux(transport_stream.padded(b"one table"))[188:]))]
    out = {r.doc_id: r for r in transport_stream.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert out[1].error is None and out[1].timestamps == [n * 3600 for n in range(len(out[1].timestamps))] and len(out[1].timestamps) > 9
    assert len(out[1].random_access) == 2 and out[1].continuity_breaks == 0 and str(out[1].random_access[1]) in out[1].feature
    assert all(out[i].error and out[i].payload_sha256 is None for i in (2, 3, 4, 5)) and out[2].media_bytes == 5 and out[3].media_sha256 is None


def test_another_pattern_is_not_cut_at_blanks():
    other = BytePairCoder(load_ranks(RANKS), r"[^\n]+|\n")
    for text in ("two words here, and more", "a b\nc d e", "x " * 50):
        line, decoded = other.coded(text)
        assert [int(i) for i in line.split()] == other.encode(text) and decoded.decode() == text


@pytest.mark.parametrize("top", [300, 680, 2047])
def test_plan_is_never_worse_than_best_fit(top):
    counts = np.bincount(np.random.default_rng(top).integers(1, top + 1, 3000), minlength=2049)
    out = packing.plan(counts, 2048)
    used = np.zeros(2049, int)
    for lengths, many in out:
        assert sum(lengths) <= 2048
        for v in lengths:
            used[v] += many
    assert (used == counts).all()
    assert sum(m for _, m in out) <= sum(m for _, m in packing._best_fit(counts.astype(np.int64), 2048))


def test_words_are_cached_without_the_marks_after_them(monkeypatch):
    """Runs of marks are tokens of their own, so words met with other marks are encoded once."""
    marks = ["", ".", "!!", "###", "$$$", ".%%%", ",&&&", "?!*", ":;", "...", "'", "!'s", "#a", "_", "_.", "\u0301.", ".\u0301", "=", "\u0338", "²!", "1.", ")", "<|endoftext|>"]
    some = [" ".join(w + m + after for m in marks) for w in ("word", "Größe", "ñandú", "λόγος", "日本", "x²", "don't", "7") for after in ("", "\n", " .", "\u0085", "\xa0", "\x1f")]
    words = packing.WordTokens(WORDS)
    for t, ids in zip(some, words.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
    for blank in ([], [""], ["", ""], [" \n"], ["\x1f"], ["\x1f", "", "a"]):
        assert list(words.encode(blank)) == [b"".join(words._encode([t])) for t in blank]
    assert {"word", "###", "$$$", ".%%%", ",&&&"} <= set(words.cache)
    assert not {"word###", "word$$$", "word.%%%", "word,&&&", "word!!"} & set(words.cache)
    # a full cache keeps its shortest words, as many as it may
    monkeypatch.setattr(packing, "_CACHE", 30)
    monkeypatch.setattr(packing, "_KEPT", 20)
    long = ["a" * n + f" b{n} " + "c" * (n % 7 + 1) for n in range(1, 100)]
    for t in long:
        assert np.frombuffer(next(words.encode([t])), "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(words.cache) <= 30
    next(words.encode(["c cc ccc"]))
    words._tidy()
    kept = max(map(len, words.cache))
    assert {"c", "cc", "ccc"} <= set(words.cache) and kept < 64 and 10 < len(words.cache) <= 20
