"""Best-fit packing by non-negative least squares over length patterns.

Texts become token ids; a document is cut into pieces of at most ``capacity``.
The histogram of piece lengths (at most ``capacity`` bins, whatever the corpus)
goes to the driver, which makes the plan:

1. patterns of two and three pieces, and of up to eight pieces of two lengths,
   that fill a sequence or leave a few tokens,
2. repeat counts that fit the histogram in the least-squares sense, none
   negative, by accelerated projected gradient; then again over the patterns
   that got the most,
3. rounding with the error carried from pattern to pattern, never beyond what
   is there,
4. the residual, packed best-fit by length with repeats.

Where best fit alone needs fewer sequences than the patterns, it is taken.

A piece finds its place by its number among pieces of its length.  Numbers come
from counts per (length, partition), so no task sees all pieces of a length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, short_batches, sole, whole_text

_CACHE, _KEPT = 300_000, 225_000
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MARK = re.compile(r"[.,;:!?#$%&*](?<=[^\W\d_].)[.,;:!?#$%&*]*(?=\s|\Z)")  # marks between a letter and a blank: tokens of their own
_ODD_SPACE = "\x1c\x1d\x1e\x1f"  # blanks to str.split, not to the tokenizer
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # blanks beyond ASCII


class WordTokens:
    """Token ids of whole texts as little-endian 32-bit bytes, by cached words.

    The tokenizer never joins across white space, nor a letter with a mark, so
    ids of a text are those of its words and the marks after them, in order.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bare = self._bare()
        self.cache: dict[str, bytes] = {}
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")

    def _bare(self):
        """The same model after a split at blanks, for words that are normal already; None for a tokenizer of another make."""
        from tokenizers import Tokenizer

        made = json.loads(self.tokenizer.to_str())
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or made["model"].get("end_of_word_suffix") != "</w>":
            return None
        made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}, "added_tokens": []}
        return Tokenizer.from_str(json.dumps(made))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin-1 letters, many in one call: each ends with the one token of it that ends a word."""
        out: list[bytes] = []
        groups = [words[i : i + 4096] for i in range(0, len(words), 4096)]
        for group, found in zip(groups, self.bare.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(group):  # not as expected of such a model
                out += self._encode(group)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *ends], ends)]
        return out

    def _line(self, text: str) -> str:
        """The text with words and marks between ASCII blanks."""
        text = _MARK.sub(r" \g<0>", text)
        if text.isascii():
            return text.lower()
        if any(c in text for c in _WIDE_SPACE):
            text = " ".join(text.split())
        try:
            text.encode("latin-1")  # here lower case and composition commute
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words."""
        letters = [w for w in words if _LETTERS.fullmatch(w)] if self.bare else []
        others = list(words.difference(letters))
        found = dict(zip(letters, self._encode_letters(letters), strict=True))
        found.update(zip(others, self._encode(others), strict=True))
        return found

    def encode(self, texts: list[str], together: int = 64) -> Iterator[bytes]:
        for at in range(0, len(texts), together):
            some = texts[at : at + together]
            odd = [any(c in t for c in _ODD_SPACE) for t in some]
            split = pc.ascii_split_whitespace(pa.array(["" if o else self._line(t) for t, o in zip(some, odd, strict=True)], pa.large_string()))
            coded = split.flatten().dictionary_encode()
            every = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # str objects, several times faster than to_pylist
            new = set(every).difference(self.cache)
            if len(self.cache) + len(new) > _CACHE:
                self._tidy()
                new = set(every).difference(self.cache)
            found = self._learn(new)
            self.cache.update(found)
            known = list(map(self.cache.__getitem__, every))
            for w in [w for w in found if len(w) > 64]:
                del self.cache[w]
            # ids of the words in order, out of those of each word once
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            which = coded.indices.to_numpy()
            n = sizes[which]
            ends = np.cumsum(n)
            ids = np.frombuffer(b"".join(known), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n) + np.arange(n.sum())]
            bounds = np.append(0, ends)[split.offsets.to_numpy()].tolist()
            for text, o, i, j in zip(some, odd, bounds, bounds[1:], strict=False):
                yield self._encode([text])[0] if o else ids[i:j].tobytes()

    def _tidy(self) -> None:
        """Keep the shortest words, the most used ones."""
        up_to = np.cumsum(np.bincount(list(map(len, self.cache)), minlength=1))
        longest = int(np.searchsorted(up_to, _KEPT, "right"))
        self.cache = {w: ids for w, ids in self.cache.items() if len(w) < longest}


def word_tokens(path: str) -> WordTokens:
    """One coder per Python worker."""
    return sole(("word tokens", path), lambda: WordTokens(path))


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; whole texts.

    Defined cases: null and empty text is one piece of the end id alone; rows
    may repeat ids or have none; an empty table gives an empty result; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            slices = (batch.column(1).slice(at, 64).to_pylist() for at in range(0, batch.num_rows, 64))
            for n, ids in enumerate(ids for texts in slices for ids in tokens.encode(texts)):
                view = memoryview(ids + end)
                for k, at in enumerate(range(0, len(view), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    row.append(n)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return short_batches(docs).select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, schema)


def _patterns(counts: np.ndarray, capacity: int, width: int = 8, common: int = 96, slack: int = 3) -> np.ndarray:
    """Patterns of present lengths, one a row, 0 pads.

    All of two pieces that leave at most ``slack`` tokens and of three that
    leave none; of the ``common`` lengths that hold most tokens, also those of
    up to ``width`` pieces of two lengths that leave at most ``slack``.
    """
    have = np.flatnonzero(counts)
    have = have[have > 0]
    present = counts > 0
    found = []
    for spare in range(slack + 1):
        a = have[have <= (capacity - spare) // 2]
        a = a[present[capacity - spare - a]]
        found.append(np.stack([capacity - spare - a, a], 1))
    for c in have[have <= capacity // 3]:
        b = have[(have >= c) & (have <= (capacity - c) // 2)]
        b = b[present[capacity - c - b]]
        found.append(np.stack([capacity - c - b, b, np.full_like(b, c)], 1))
    most = np.sort(have[np.argsort(-counts[have] * have, kind="stable")[:common]])
    for i in range(1, width + 1):
        for j in range(width + 1 - i):
            if i + j < 2:
                continue
            a, b = (v.ravel() for v in np.meshgrid(most, most if j else most[:1], indexing="ij"))
            total = i * a + j * b
            fits = (total <= capacity) & (total >= capacity - slack) & ((a != b) | (j == 0))
            fits &= (i + j > 3) | (i + j == 3) & (total < capacity)  # the others are above
            found.append(np.hstack([np.repeat(a[fits][:, None], i, 1), np.repeat(b[fits][:, None], j, 1)]))
    widest = max((f.shape[1] for f in found if len(f)), default=2)
    return np.concatenate([np.pad(f, ((0, 0), (0, widest - f.shape[1]))) for f in found if len(f) or f.shape[1] == 2])


def _fit(patterns: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |W (A x - counts)|^2, by accelerated projected gradient.

    W weighs a length by itself: short pieces that are left over are easy to
    place, long ones are not.
    """
    size, real = len(counts), patterns > 0
    x = np.zeros(len(patterns))
    if not len(x):
        return x
    ahead, t = x, 1.0
    weight = (np.arange(size) / (size - 1)) ** 2
    # the largest eigenvalue of A'WA is bounded by its largest row sum
    widths = np.repeat(real.sum(1), real.sum(1))
    uses = weight * np.bincount(patterns[real], widths, minlength=size)
    step = 1.0 / uses[patterns].sum(1, where=real).max()
    target = counts.astype(float)
    # the pieces column by column, mostly without the pads: few patterns have more than three; W makes pads count 0
    columns = [(lengths, slice(None)) if 2 * np.count_nonzero(lengths) > len(x) else (lengths[lengths > 0], np.flatnonzero(lengths)) for lengths in np.ascontiguousarray(patterns.T)]
    slope = np.empty(len(x))
    for _ in range(rounds):
        r = np.zeros(size)
        for lengths, rows in columns:
            r += np.bincount(lengths, ahead[rows], size)
        r = (r - target) * weight
        slope[:] = 0
        for lengths, rows in columns:
            slope[rows] += r.take(lengths)
        slope *= -step
        slope += ahead
        new = np.maximum(slope, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new - x
        ahead *= (t - 1) / t_new
        ahead += new
        x, t = new, t_new
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths, repeats)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        for room in sorted(r for r in open_ if r >= length):
            while n and open_[room]:
                lengths, many = open_[room].pop()
                took = min(n, many)
                if many > took:
                    open_[room].append((lengths, many - took))
                open_.setdefault(room - length, []).append(((*lengths, length), took))
                n -= took
        while n:
            fits = capacity // length
            whole = n // fits
            if whole:
                open_.setdefault(capacity - fits * length, []).append(((length,) * fits, whole))
                n -= whole * fits
            else:
                open_.setdefault(capacity - n * length, []).append(((length,) * n, 1))
                n = 0
    return [x for group in open_.values() for x in group]


def _rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts near ``x``; the error is carried from pattern to pattern.  Takes what it uses out of ``left``."""
    out, carry = [], 0.0
    for k in np.lexsort((patterns[:, 1], -patterns[:, 0])):
        carry += x[k]
        if carry < 1:
            continue
        lengths = tuple(int(v) for v in patterns[k] if v)
        need: dict[int, int] = {}
        for v in lengths:
            need[v] = need.get(v, 0) + 1
        many = min(int(carry), *(int(left[v]) // n for v, n in need.items()))
        if many > 0:
            out.append((lengths, many))
            for v, n in need.items():
                left[v] -= n * many
            carry -= many
        carry = min(carry, 1.0)
    return out


def plan(counts: np.ndarray, capacity: int, kept_patterns: int = 4096, rounds: int = 200, turns: int = 6) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together use every piece of the histogram once.

    What rounding leaves over is fitted again, ``turns`` times at most.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    for _ in range(turns):
        patterns = _patterns(left, capacity)
        x = _fit(patterns, left, rounds)
        if len(x) > kept_patterns:
            best = np.sort(np.argpartition(-x, kept_patterns)[:kept_patterns])
            patterns = patterns[best]
            x = _fit(patterns, left, rounds)
        took = _rounded(patterns, x, left)
        out += took
        if not took:
            break
    out += _best_fit(left, capacity)
    plain = _best_fit(np.append(0, counts[1:]).astype(np.int64), capacity)
    return min(out, plain, key=lambda p: sum(many for _, many in p))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Defined cases: null and empty text is one piece with the end id alone; rows
    may repeat ids, each row has pieces of its own; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col).withColumn("_part", F.spark_partition_id()))
    counts = pieces.where(F.col("length") < capacity).groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpoint(counts)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n")).collect():
        histogram[r[0]] = r[1]
    spans, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, many in plan(histogram, capacity):
        offset = 0
        for v in lengths:
            spans.append((v, int(used[v]), int(used[v]) + many, base, offset))
            used[v] += many
            offset += v
        base += many
    # a length's numbers lie in blocks about as wide as its spans are on average, so a piece meets few spans
    of_length = np.bincount([v for v, *_ in spans], minlength=capacity + 1)
    shifts = [max(0, int(n // max(1, k)).bit_length() - 1) for n, k in zip(used.tolist(), of_length.tolist(), strict=True)]
    rows = [(v, block, first, end, at, offset) for v, first, end, at, offset in spans for block in range(first >> shifts[v], (end - 1 >> shifts[v]) + 1)]
    # a few rows for each of the planned patterns, so the size is bounded
    places = F.broadcast(spark.createDataFrame(rows, "length long, _block long, _from long, _to long, _base long, offset long"))
    shift = F.element_at(F.lit(shifts), F.col("length").cast("int") + 1)
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    short = pieces.where(F.col("length") < capacity)
    nth = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1
    placed = short.withColumn("_nth", nth).join(before, ["length", "_part"]).withColumn("_nth", F.col("_nth") + F.col("_before"))
    placed = placed.withColumn("_block", F.call_function("shiftright", F.col("_nth"), shift))
    placed = placed.join(places, ["length", "_block"]).where((F.col("_nth") >= F.col("_from")) & (F.col("_nth") < F.col("_to")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = placed.select(*columns, (F.col("_base") + F.col("_nth") - F.col("_from")).alias("sequence_id"), "offset")
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
