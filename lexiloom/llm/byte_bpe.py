"""Byte-level BPE encoding and decoding in linear time.

The bytes of every vocabulary entry, read as Latin-1, go into an Aho-Corasick
automaton.  A pre-token is encoded from left to right by its longest match; a
token is only put after another if BPE would leave that pair unmerged, which is
decided by undoing merges on both sides of the border and memoised.  If it
would not, the next shorter prefix token is tried, and a position from which
nothing fits is marked and never tried again.  The result is exactly that of
the merges.  Pre-tokens are independent, so their ids are cached.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import short_batches, sole, whole_text

_CACHE = 400_000
_NONE = 1 << 30
#: Fixed value: the pre-token pattern for which cutting at single blanks and line feeds is proved.
_CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(r"[^\S \n]|  | \n|\n |\n\n")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairCoder:
    """Encoder and decoder over a rank file and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.cuttable = pattern == _CUTTABLE
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(b) for b, i in ranks.items()}
        self.prefix: dict[int, int] = {}
        for b, i in ranks.items():
            self.prefix[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._best: dict[int, int] = {}
        self._decimal = {i: str(i) for i in ranks.values()}
        for i in sorted(self.token_bytes):
            self._learn(i)
        self._first: dict[str, tuple[str, bytes]] = {}
        self._spaced: dict[str, tuple[str, bytes]] = {}

    def _learn(self, token: int) -> None:
        """Find the two tokens that merge into this one, from those of lower rank."""
        b = self.token_bytes[token]
        for n in range(len(b) - 1, 0, -1):
            left, right = self.ranks.get(b[:n], token), self.ranks.get(b[n:], token)
            if left < token and right < token and self._stays_apart(left, right):
                self.halves[token] = (left, right)
                self.joined[left, right] = token
                return

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves a border between these tokens."""
        halves, joined = self.halves, self.joined
        limit = 1 << 62
        while True:
            if joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, pair = left, halves.get(left)
                if pair:
                    left = pair[1]
                    continue
                limit, pair = right + 1, halves.get(right)
                if not pair:
                    return True
                right = pair[0]
            else:
                limit, pair = right + 1, halves.get(right)
                if pair:
                    right = pair[0]
                    continue
                limit, pair = left, halves.get(left)
                if not pair:
                    return True
                left = pair[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if not piece:
            return []
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        text, longest = piece.decode("latin-1"), self.automaton.iter_long
        length, best, fit = self.length, self._best, self._fit
        dead: set[int] = set()
        tokens: list[int] = []
        at, last, size = 0, _NONE, len(piece)
        matches = longest(text)
        while at < size:
            long_one = next(matches)[1]
            token = best.get(last << 32 | long_one)
            if token is None:
                token = fit(last, long_one)
            if dead:
                while token >= 0 and at + length[token] in dead:
                    token = self._shorter(last, token)
            if token < 0:  # nothing fits here: the token before this place goes
                dead.add(at)
                at -= length[tokens.pop()]
                last = tokens[-1] if tokens else _NONE
                matches = longest(text, at)
                continue
            tokens.append(token)
            last = token
            at += length[token]
            if token != long_one:
                matches = longest(text, at)
        return tokens

    def _fit(self, last: int, token: int) -> int:
        """The longest token, from this one down its prefixes, that may stand after ``last``; -1 if none."""
        key, found = last << 32 | token, token
        while last != _NONE and found >= 0 and not self._stays_apart(last, found):
            found = self.prefix[found]
        if len(self._best) >= _CACHE:
            self._best.clear()
        self._best[key] = found
        return found

    def _shorter(self, last: int, token: int) -> int:
        token = self.prefix[token]
        if token < 0:
            return token
        found = self._best.get(last << 32 | token)
        return self._fit(last, token) if found is None else found

    def _entry(self, text: str) -> tuple[str, bytes]:
        if self.cuttable and text[:1] == " " and text[-1] in ".,;:" and text[1:-1].isalpha():  # a word and a mark
            (a, b), (c, d) = self._cached(self._spaced, text[1:-1], text[:-1]), self._cached(self._first, text[-1], text[-1])
            return f"{a} {c}", b + d
        if self.cuttable and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            ids = self.encode_piece(text.encode())
            return " ".join(map(self._decimal.__getitem__, ids)), self.decode(ids)
        ids = [i for piece in self.pieces.findall(text) for i in self.encode_piece(piece.encode())]
        return " ".join(map(self._decimal.__getitem__, ids)), self.decode(ids)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def coded(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by a space, and the bytes they decode to.

        With the one pattern that this holds for, in text whose white space is
        single blanks and line feeds, pre-tokens never reach over a blank (which begins one) or a line feed (which is
        one), so it is cut there by plain splits.
        """
        if not self.cuttable or _PLAIN.search(text):
            parts = [self._cached(self._first, x, x) for x in self.pieces.findall(text)]
        else:
            parts, first, spaced = [], self._first, self._spaced
            for n, line in enumerate(text.split("\n")):
                if n:
                    parts.append(self._cached(first, "\n", "\n"))
                words = line.split(" ")
                if words[0]:
                    parts.append(self._cached(first, words[0], words[0]))
                parts += [spaced.get(w) or self._cached(spaced, w, " " + w) for w in words[1:]]
        return " ".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _cached(self, cache: dict, key: str, text: str) -> tuple[str, bytes]:
        if (found := cache.get(key)) is None:
            found = self._entry(text)
            if len(key) <= 64:
                if len(cache) >= _CACHE:
                    cache.clear()
                cache[key] = found
        return found


def coder(ranks_path: str, pattern: str) -> BytePairCoder:
    """One coder per Python worker."""
    return sole(("byte pairs", ranks_path, pattern), lambda: BytePairCoder(load_ranks(ranks_path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids`` if asked for).

    Defined cases: null and empty text have no tokens; ids may be null or
    repeated; very long pre-tokens take linear time; an empty table gives an
    empty result; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, out_sha, ids = [], [], [], []
            for value in batch.column(1):
                line, decoded = bpe.coded(value.as_py())
                n.append(line.count(" ") + 1 if line else 0)
                ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                out_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in line.split()])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return short_batches(docs).select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from a column of token ids.

    Defined cases: null and empty lists give empty text; bytes that aren't
    UTF-8 become replacement characters; an id outside the vocabulary is an
    error; an empty table gives an empty result; other columns are not read.
    """
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return short_batches(encoded).select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"doc_id {id_type}, text string")
