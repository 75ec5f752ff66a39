"""Toxicity: a support vector machine on a subsequence string kernel.

The kernel of two strings sums over their common character subsequences, each
weighed by ``decay`` to the power of the length it spans, so ``i-d.i o t`` and
``idxiot`` stay close to ``idiot``.  Landmark strings are chosen from labelled
texts, the kernel against them is turned into features by the Nystrom map
(K_mm ** -1/2), and a linear SVM with squared hinge loss learns on these; its
margins become probabilities by a sigmoid fitted on rows it did not see.  Three
more features stand beside the map: how dense the kernels are (sums of fourth
powers over a text's stretches, against its length), the length, and the
largest kernel as far as it exceeds what clean texts reach with the same
landmark, so that one insult counts even where training texts hold several.
Clean texts with one landmark written with inserted, doubled or missing
letters, or inside other letters, are trained on beside the labelled ones.

A text is a bag of words, cut at white space and undone of inserted marks; runs
of single characters are joined, and so are neighbours that spell a landmark
with a blank in it.  A text's kernel with a landmark is the
largest over windows from every position of its words.  Words are scored once
for each worker and cached.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import short_batches, sole, whole_text

WINDOW = 24
_CACHE = 100_000
_PIECE, _BLOCK = 4096, 1 << 20  # characters looked at together
#: Characters commonly written for letters.
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_ENDS = (".", ",", ";", ":", "!", "?")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _pairs_kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float, beginnings: bool = False) -> np.ndarray:
    """Subsequence kernels of ``order`` for pairs of rows of codes (0 pads).

    With ``beginnings``, those of all beginnings of the two, in the first two axes.
    """
    n, la = a.shape
    lb = b.shape[1]
    below = np.ones((la + 1, lb + 1, n), np.float32)
    total = np.zeros((la, lb, n) if beginnings else n, np.float32)
    ta, tb = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for level in range(order):
        here = np.zeros((la + 1, lb + 1, n), np.float32)
        for i in range(la):
            hits = np.where((tb == ta[i]) & (tb > 0), below[i, :-1], 0) * np.float32(decay * decay)
            if level == order - 1:
                if beginnings:
                    total[i] = hits
                else:
                    total += hits.sum(0)
                continue
            run = np.zeros(n, np.float32)
            for j in range(lb):
                run = np.float32(decay) * run + hits[j]
                here[i + 1, j + 1] = np.float32(decay) * here[i, j + 1] + run
        below = here
    return total.cumsum(0).cumsum(1) if beginnings else total


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        out[i, : min(len(w), width)] = [ord(c) for c in w[:width]]
    return out


@dataclass
class Landmarks:
    """Strings; ``^`` and ``$`` stand for a word's borders.

    A word is compared in windows from every position, of every width up to one
    more letter in each gap of the landmark (four more at least); the best
    counts.  Windows that lack more than one letter in five of the landmark
    (one at least), in its order, count as 0.
    """

    words: list[str]
    order: int = 3
    decay: float = 0.97

    def __post_init__(self):
        self.cores = [w.strip("^$") for w in self.words]
        self.spans = [max(2 * len(c) - 1, len(c) + 4) for c in self.cores]
        codes = _codes(self.words, max(map(len, self.words), default=1))
        self.own = _pairs_kernel(codes, codes, self.order, self.decay)
        heads: dict[str, set[str]] = {}
        for c in self.cores:
            for i in range(1, len(c)):
                heads.setdefault(c[:i], set()).add(c[i:])
        self.heads = {h: tuple(sorted(t)) for h, t in heads.items()}

    def kernel(self, marked: list[str]) -> np.ndarray:
        """Normalised kernels of ``^word$`` strings: words x landmarks."""
        out = np.zeros((len(marked), len(self.words)), np.float32)
        room = "\0" * (max(self.spans) + 2)
        sizes = np.cumsum([len(w) + 1 for w in marked])
        table = np.zeros(0x110000, np.uint32)
        at = 0
        while at < len(marked):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BLOCK, "right")))
            text = "\0" + "\0".join(marked[at:to]) + room
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
            begins = np.cumsum([0, *(len(w) + 1 for w in marked[at : to - 1])])
            found: dict[str, np.ndarray] = {}
            for j, core in enumerate(self.cores):
                if core not in found:
                    found[core] = self._alike(codes, j, table)
                starts = found[core]
                for cut in range(0, len(starts), 4096):
                    some = starts[cut : cut + 4096]
                    owner = at + np.searchsorted(begins, some, "right") - 1
                    np.maximum.at(out, (owner, j), self._windows(codes, some, j))
            at = to
        return out

    def _alike(self, codes: np.ndarray, j: int, table: np.ndarray) -> np.ndarray:
        """Positions whose windows hold enough of a landmark's letters in order, by bitwise longest common subsequence; windows end with their word."""
        core = self.cores[j]
        lacking = max(1, len(core) // 5)
        end = np.uint32(1 << 31)
        for k, c in enumerate(core):
            table[ord(c)] |= 1 << k
        table[0] = end
        bits = table[codes]
        for c in core:
            table[ord(c)] = 0
        starts = np.flatnonzero(bits & np.uint32((2 << lacking) - 1))
        left, inside = np.full(len(starts), (1 << len(core)) - 1, np.uint32), np.ones(len(starts), bool)
        for i in range(self.spans[j]):
            b = bits[starts + i]
            inside &= b != end
            hit = left & (b * inside)
            left = (left + hit) | (left - hit)
        return starts[np.bitwise_count(left & np.uint32((1 << len(core)) - 1)) <= lacking]

    def _windows(self, codes: np.ndarray, starts: np.ndarray, j: int) -> np.ndarray:
        """The best kernel of the windows that begin at each of ``starts``."""
        mark = int(self.words[j].startswith("^"))
        windows = codes[starts[:, None] + np.arange(-mark, self.spans[j] + self.words[j].endswith("$"))]
        windows[:, mark:] *= np.logical_and.accumulate(windows[:, mark:] > 0, axis=1)
        if mark:
            windows[windows[:, 0] != ord("^"), 0] = 0
        landmark = np.broadcast_to(np.array([ord(c) for c in self.words[j]], np.int32), (len(starts), len(self.words[j])))
        k = _pairs_kernel(windows, landmark, self.order, self.decay, True)[:, -1]
        own = np.diagonal(_pairs_kernel(windows, windows, self.order, self.decay, True)).T
        return (k / np.sqrt(np.maximum(own * self.own[j], 1e-12))).max(0)


def spellings(chunk: str) -> set[str]:
    """What a stretch without white space may be meant as: letters only, its parts, look-alikes undone."""
    low = chunk.lower()
    if low.isalpha():
        return {low}
    if low[-1:] in _ENDS and low[:-1].isalpha():
        return {low[:-1]}
    plain = _NOT_LETTER.sub("", low)
    found = {plain, *(x for x in _NOT_LETTER.split(low) if len(x) > 2)}
    if plain and plain != low:
        found.add(_NOT_LETTER.sub("", low[:-1].translate(_LOOKALIKE) + low[-1]))
    return {x for x in found if x}


def pieces(word: str) -> list[str]:
    """A word with its borders marked; a very long one in pieces that overlap by more than any window."""
    marked = f"^{word}$"
    return [marked[i : i + _PIECE + 2 * WINDOW + 2] for i in range(0, len(marked), _PIECE)]


def chunks(text: str, heads: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Distinct stretches without white space, runs of single characters joined, and neighbours that are a landmark with a blank in it.

    ``heads``: beginnings of landmarks and what must follow them.
    """
    parts = text.lower().split()
    out = {p.rstrip(".,;:!?") for p in set(parts)}
    out.discard("")
    if heads:
        for head in out & heads.keys():
            at = -1
            for _ in range(parts.count(head)):
                at = parts.index(head, at + 1)
                if at + 1 < len(parts) and parts[at + 1].startswith(heads[head]):
                    out.add(head + parts[at + 1])
    run: list[str] = []
    if list(map(len, out)).count(1) > 1:
        for p in [*parts, "  "]:
            if len(p) == 1:
                run.append(p)
            else:
                if len(run) > 2:
                    out.add("".join(run))
                run = []
    return list(out)


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    weights: np.ndarray  # on ``features``; those of kernels are the SVM's times K_mm ** -1/2
    bias: float
    usual: np.ndarray | float = 0.0  # what hardly any clean text's kernel exceeds, by landmark
    slope: float = 1.0
    shift: float = 0.0
    _known: dict = field(default_factory=dict, repr=False)
    _rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_rows": []}

    def _learn(self, new: list[str]) -> None:
        words, owner = [], []
        for n, chunk in enumerate(new):
            for s in spellings(chunk):
                for w in pieces(s):
                    words.append(w)
                    owner.append(n)
        out = np.zeros((len(new), len(self.landmarks.words)), np.float32)
        if words:
            distinct = list(dict.fromkeys(words))
            k = self.landmarks.kernel(distinct)
            live = k.any(1)
            where = {w: i for i, w in enumerate(distinct) if live[i]}
            for w, n in zip(words, owner, strict=True):
                if (i := where.get(w)) is not None:
                    np.maximum(out[n], k[i], out=out[n])
        found = out.any(1)
        for n, chunk in enumerate(new):
            if found[n]:
                self._known[chunk] = len(self._rows)
                self._rows.append(out[n])
            else:
                self._known[chunk] = -1

    def measures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest kernels with the landmarks, sums of their fourth powers, and number of stretches."""
        size = len(self.landmarks.words)
        best, sums, count = np.zeros((len(texts), size), np.float32), np.zeros((len(texts), size), np.float32), np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            split = [chunks(t, self.landmarks.heads) for t in texts[at : at + 256]]
            if len(self._known) > 2 * _CACHE:
                self._known.clear()
                self._rows.clear()
            known = self._known
            new = list({c for part in split for c in part if c not in known})
            if new:
                self._learn(new)
            for n, part in enumerate(split, at):
                count[n] = len(part)
                rows = [r for r in map(known.__getitem__, part) if r >= 0]
                if rows:
                    found = np.array([self._rows[r] for r in rows])
                    best[n], sums[n] = found.max(0), (found**4).sum(0)
            for c in new:
                if len(c) > 64:
                    known.pop(c, None)
        return best, sums, count

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Each text's largest kernels with the landmarks."""
        return self.measures(texts)[0]

    def features(self, best: np.ndarray, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What the SVM sees: kernels, how dense they are, the length, and the excess."""
        return np.hstack([best, 10 * sums / np.sqrt(1 + count)[:, None], np.log1p(count)[:, None], self.excess(best)[:, None]])

    def margins(self, best: np.ndarray, sums: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.features(best, sums, count) @ self.weights + self.bias

    def excess(self, kernels: np.ndarray) -> np.ndarray:
        """The largest part of the way from a landmark's usual kernel to 1, to a power that lifts small ones: changed spellings stay far below 1."""
        return ((kernels - self.usual) / (1 - self.usual)).max(1, initial=0) ** 0.2

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*self.measures(texts)) + self.shift, -50, 50)))


def without_copies(texts: list[str], labels: np.ndarray, sketch: int = 16) -> list[int]:
    """One of each group of texts with one label that share half of their smallest word-triple hashes."""
    keep, groups = [], {}
    for i, (text, y) in enumerate(zip(texts, labels, strict=True)):
        words = text.lower().split()
        triples = {zlib.crc32(" ".join(words[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 2))}
        smallest = [(int(y), h) for h in sorted(triples)[:sketch]]
        seen = Counter(g for h in smallest for g in groups.get(h, ()))
        if seen and 2 * seen.most_common(1)[0][1] >= len(smallest):
            continue
        for h in smallest:
            groups.setdefault(h, []).append(i)
        keep.append(i)
    return keep


def choose_landmarks(texts: list[str], labels: np.ndarray, shortest: int = 4, least: float = 12.0) -> list[str]:
    """Words and word beginnings that tell toxic texts apart, by the G statistic.

    ``least`` is the smallest G that counts; it rises with the logarithm of the
    number of candidates, so that chance finds none among many.  Copies and near
    copies with one label count once.  A candidate much like a chosen one must
    reach it again on the texts that lack that one.
    Beginnings have ``shortest`` to 12 letters; longer ones add nothing that
    their own beginnings lack.
    """
    one_each = without_copies(texts, labels)
    texts, labels = [texts[i] for i in one_each], np.asarray(labels)[one_each]
    n, pos = len(texts), int(labels.sum())
    if not 0 < pos < n:
        return ["^none$"]
    enough = least / np.log(n / pos)  # toxic texts that a string needs, were it in no other

    def words(text: str) -> set[str]:
        return {w for c in chunks(text) for w in spellings(c) if shortest - 1 <= len(w) <= WINDOW}

    def strings(text: str) -> set[str]:
        found = set()
        for w in words(text):
            if len(w) < shortest:
                found.add(f"^{w}$")
            elif w[:shortest] in roots:
                found.add(f"^{w}$")
                found |= {"^" + w[:k] for k in range(shortest, min(len(w), 12) + 1)}
        return found

    roots: set[str] = set()
    first = Counter(x for t, y in zip(texts, labels, strict=True) if y for x in {w[:shortest] for w in words(t) if len(w) >= shortest})
    roots = {x for x, c in first.items() if c >= enough}
    toxic = Counter(x for t, y in zip(texts, labels, strict=True) if y for x in strings(t))
    toxic = {x: c for x, c in toxic.items() if c >= enough}
    inside = dict.fromkeys(toxic, 0)  # bit sets of texts
    for i, t in enumerate(texts):
        for x in strings(t):
            if x in toxic:
                inside[x] |= 1 << i
    bad = sum(1 << i for i, y in enumerate(labels) if y)

    def gain(a: int, b: int, pos: int, n: int) -> float:
        if a * (n - pos) <= 2 * b * pos:
            return 0.0
        return a * np.log(a / ((a + b) * pos / n)) + (b * np.log(b / ((a + b) * (n - pos) / n)) if b else 0)

    def worth(x: str, but: int = 0) -> float:
        """G of a candidate on the texts outside the set ``but``."""
        a, b, seen = (inside[x] & ~but & bad).bit_count(), (inside[x] & ~but & ~bad).bit_count(), (but & bad).bit_count()
        return gain(a, b, pos - seen, n - but.bit_count()) if a else 0.0

    least = max(least, np.log(len(first) + len(toxic) + 1))
    found = sorted(((worth(x), x) for x in toxic), key=lambda g: (-g[0], -len(g[1]), g[1]))
    chosen: list[str] = []
    for g, x in found:
        if g < least:
            break
        stem = x.rstrip("$")
        like = [y for y in chosen if stem.startswith(y.rstrip("$")) or y.startswith(stem)]
        if like and worth(x, _union(inside[y] for y in like)) < least:
            continue
        if chosen:
            like += [y for y, k in zip(chosen, Landmarks(chosen).kernel([x])[0], strict=True) if k > 0.8]
        if like and worth(x, _union(inside[y] for y in like)) < least:
            continue
        chosen.append(x)
    # words are also looked for inside others
    return [*chosen, *(x.strip("^$") for x in chosen if x.endswith("$"))] or ["^none$"]


def _union(sets: Iterable[int]) -> int:
    out = 0
    for x in sets:
        out |= x
    return out


def changed(core: str, rng: np.random.Generator) -> list[str]:
    """Ways to write a landmark: as it is, with letters inserted, doubled or left out, and inside other letters."""

    def letter() -> str:
        return chr(97 + int(rng.integers(26)))

    def inserted(n: int) -> str:
        places = {int(p) for p in rng.choice(np.arange(1, len(core)), n, replace=False)}
        return "".join(letter() + c if i in places else c for i, c in enumerate(core))

    p = int(rng.integers(1, len(core)))
    around = "".join(letter() for _ in range(4)) + core + "".join(letter() for _ in range(4))
    out = [core, inserted(1), core[:p] + core[p - 1 :], "".join(c + letter() for c in core[:-1]) + core[-1], around, around[4:], around[:-4]]
    if len(core) > 4:
        out += [inserted(2), core[:p] + core[p + 1 :]]
    return out


def _svm(x: np.ndarray, y: np.ndarray, c: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; y is -1 or 1."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    reg = np.ones(len(w))
    reg[-1] = 1e-3
    for _ in range(rounds):
        active = y * (xb @ w) < 1
        xa = xb[active]
        new = np.linalg.solve(np.diag(reg) + 2 * c * xa.T @ xa, 2 * c * xa.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w[:-1], float(w[-1])


def _sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid on margins, with Platt's targets."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-4 * w)
    return float(w[0]), float(w[1])


def train(texts: list[str], toxic: list[int], rates: tuple[float, float] = (1.0, 1.0), c: float = 1.0, seed: int = 5) -> ToxicityModel:
    """Landmarks and SVM on four fifths of the rows, the sigmoid on the rest.

    ``rates``: shares of all rows with label 0 and 1 that were drawn; the
    sigmoid weighs rows by them, so that scores hold for the whole.
    """
    y = np.array(toxic, int)
    order = np.random.default_rng(seed).permutation(len(texts))
    held = order[: len(texts) // 5]
    fit = order[len(texts) // 5 :]
    model = ToxicityModel(Landmarks(choose_landmarks([texts[i] for i in fit], y[fit])), np.zeros(0), 0.0)
    marks = model.landmarks
    measured = model.measures(texts)
    kernels = measured[0]
    clean = kernels[fit][y[fit] == 0]
    model.usual = np.minimum(np.quantile(clean, 0.999, axis=0), 0.95) if len(clean) else np.zeros(len(marks.words))
    between = marks.kernel(marks.words).astype(float)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    def with_changed(rows: np.ndarray, seed: int) -> tuple[tuple, np.ndarray]:
        """Measures and labels of ``rows``, and of clean ones with a changed landmark each, as many as toxic ones."""
        rng = np.random.default_rng(seed)
        plain, n = rows[y[rows] == 0], int(y[rows].sum())
        if not len(plain) or not n:
            return tuple(m[rows] for m in measured), y[rows]
        words = [f"^{w}$" for x in marks.words if x.endswith("$") for _ in range(-(-n // len(marks.words) // 4)) for w in changed(x.strip("^$"), rng)] or [f"^{x.strip('^$')}$" for x in marks.words]
        words = [words[i] for i in rng.permutation(len(words))[:n]]
        to, extra = rng.choice(plain, len(words)), marks.kernel(words)
        more = np.maximum(kernels[to], extra), measured[1][to] + extra**4, measured[2][to] + 1
        return tuple(np.concatenate([m[rows], x]) for m, x in zip(measured, more, strict=True)), np.append(y[rows], np.ones(len(words), int))

    known, truth = with_changed(fit, seed + 1)
    size = len(marks.words)
    x = model.features(*known)
    x[:, :size] = x[:, :size] @ root
    w, bias = _svm(x, 2.0 * truth - 1, c) if len(fit) else (np.zeros(2 * size + 2), -1.0)
    model.weights, model.bias = np.concatenate([root @ w[:size], w[size:]]), bias
    if 0 < y[held].sum() < len(held):
        known, truth = with_changed(held, seed + 2)
        model.slope, model.shift = _sigmoid(model.margins(*known), truth, 1 / np.array(rates)[truth])
    return model


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = 4000, **options) -> ToxicityModel:
    """Train on about ``rows_per_label`` rows with either label, drawn by a hash of the id, and their texts.

    Only the drawn labels are joined to the texts, so that side is bounded and
    may be broadcast.  Of rows that repeat an id, all count.
    """
    known = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("_y")).where("_k is not null and _y in (0, 1)")
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rates = tuple(min(1.0, rows_per_label / max(1, counts.get(y, 0))) for y in (0, 1))
    draw = F.pmod(F.xxhash64(F.lit(23), F.col("_k").cast("string")), F.lit(1_000_000))
    sample = F.broadcast(known.where(draw < F.when(F.col("_y") == 1, int(1_000_000 * rates[1])).otherwise(int(1_000_000 * rates[0]))))
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("t"))
    found = texts.join(sample, F.col("_id") == F.col("_k")).select("t", "_y", "_k").collect()
    found.sort(key=lambda r: (str(r["_k"]), r["_y"], r["t"]))
    return train([r["t"] for r in found], [r["_y"] for r in found], rates, **options)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Probability that a text is toxic."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sole(("toxicity",), int)  # what other operators cached here may go
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every document, whole texts.

    Defined cases: null counts as empty, and empty text gets the score of a
    text unlike all landmarks; rows may repeat; an empty table gives an empty
    result; other columns are not read.
    """
    scored = short_batches(docs).select(docs[id_col].alias("doc_id"), toxicity_score(model, whole_text(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``threshold``.

    Defined cases: those of ``score_toxicity``; null and empty texts are judged
    as a text unlike all landmarks, rows that repeat share a decision, columns
    of any name are passed on.
    """
    return short_batches(docs).where(toxicity_score(model, whole_text(text_col)) < threshold)
