"""Near-duplicate detection by BagMinHash.

A document is the multiset of its shingles of five words.  The weights of the
multiset are discretised to whole numbers; each shingle owns Poisson processes
over the blocks (0,1], (1,2], (2,4], (4,8], ... of its weight axis.  A point of a
block falls into one unit of it and splits the block around that unit, so that
any two documents see the same points wherever both weights reach.  Points are
dealt to the components of the signature, each of which keeps the earliest.
Two signatures agree in a component with the probability of the weighted
Jaccard similarity.  Generation stops for good once a process has passed the
document's latest kept point, so a weight of w costs far less than w steps.

1. Signatures are banded.  Documents of equal word sequence count once.
2. Each band bucket links its members to one centre (a star, never all pairs):
   the member that shares most buckets, which is the one most likely to be what
   the others were copied from.  The multisets of each such pair are compared
   exactly.
3. Members that aren't near their centre may still be near another member.
   They meet on their rarest elements (prefix and size filter, exact for the
   threshold): what a whole group has in common, as a passage or template,
   brings none of them together.  Where few documents meet, each pair that
   isn't connected yet is compared; where many do, stars go on, from the
   smallest document and then from others, until one finds no link.  What is
   left open there is settled exactly: documents with the same common elements
   from the meeting place on stand for one another, so each document is
   compared with the smallest one of every such group that may be near it.
4. Links are joined to classes by star-contraction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, short_batches, sole, whole_text
from .components import connected_components

BANDS, ROWS = 24, 6
_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _golden(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLDEN) & (1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads all bits."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


def _hashes() -> _WordHashes:
    return sole(("word hashes",), _WordHashes)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int = 5) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = _mix(out * _GOLDEN + h[k : len(h) - n + 1 + k])
    return out


def content_key(text: str, words: list[str]) -> bytes:
    """Equal for equal word sequences; without words, for equal texts."""
    if words:
        return hashlib.blake2b("\0".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, person=b"no words").digest()


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size) of the multisets given as (document, element, weight > 0)."""
    kept = np.full(docs * size, np.inf)
    block, seeds, lows, sizes, of = 0, [], [], [], []
    rows = np.arange(len(doc))
    while len(rows):
        low, width = (0, 1) if block == 0 else (1 << block - 1, 1 << block - 1)
        rows = rows[weight[rows] > low]
        of.append(rows)
        seeds.append(_mix(element[rows] + _golden(block + 1)))
        lows.append(np.full(len(rows), low))
        sizes.append(np.full(len(rows), width))
        block += 1
    of, seed, low, width = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (of, seeds, lows, sizes))
    d, w, x = doc[of], weight[of], np.zeros(len(of))
    turn = 0
    while len(d):
        latest = kept.reshape(docs, size).max(1)
        unit = width == 1
        many = 1 if turn < 2 else 8 if turn < 8 else 32
        turn += 1
        # units: several points of each at once
        ud, us, ux = d[unit], seed[unit], x[unit]
        steps = _mix(us[:, None] + np.arange(1, many + 1, dtype=np.uint64) * _GOLDEN)
        us = us + _golden(many)
        gaps = -np.log(((steps >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        xs = ux[:, None] + np.cumsum(gaps, 1)
        slot = (_mix(steps ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(size)).astype(np.int64)
        near = xs <= latest[ud][:, None]
        np.minimum.at(kept, (ud[:, None] * size + slot)[near], xs[near])
        ux = xs[:, -1]
        # blocks: one point, which splits them
        wide = ~unit
        nd, nseed, nlow, nwidth, nx, nw = [ud], [us], [low[unit]], [width[unit]], [ux], [w[unit]]
        if wide.any():
            bd, bw, blow, bwidth = d[wide], w[wide], low[wide], width[wide]
            bs = _mix(seed[wide] + _GOLDEN)
            bx = x[wide] - np.log(((bs >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / bwidth
            near = bx <= latest[bd]
            bd, bw, blow, bwidth, bs, bx = (v[near] for v in (bd, bw, blow, bwidth, bs, bx))
            place = blow + (_mix(bs ^ np.uint64(0x3C3C3C3C3C3C3C3C)) % bwidth.astype(np.uint64)).astype(np.int64)
            slot = (_mix(bs ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(size)).astype(np.int64)
            hit = place < bw
            np.minimum.at(kept, (bd * size + slot)[hit], bx[hit])
            half, at = bwidth // 2, np.arange(len(bd))
            while len(at):  # the halves that the point isn't in start afresh from it
                other = np.where(place[at] < blow[at] + half[at], blow[at] + half[at], blow[at])
                live = other < bw[at]
                a = at[live]
                nd.append(bd[a])
                nseed.append(_mix(bs[a] + other[live].astype(np.uint64) * _GOLDEN + half[a].astype(np.uint64)))
                nlow.append(other[live])
                nwidth.append(half[a])
                nx.append(bx[a])
                nw.append(bw[a])
                blow = blow.copy()
                blow[at] = np.where(other == blow[at], blow[at] + half[at], blow[at])
                half = half.copy()
                half[at] //= 2
                at = at[half[at] > 0]
            nd.append(bd[hit])
            nseed.append(_mix(bs[hit] ^ _GOLDEN))
            nlow.append(place[hit])
            nwidth.append(np.ones(int(hit.sum()), np.int64))
            nx.append(bx[hit])
            nw.append(bw[hit])
        d, seed, low, width, x, w = (np.concatenate(v) for v in (nd, nseed, nlow, nwidth, nx, nw))
        live = x < kept.reshape(docs, size).max(1)[d]
        d, seed, low, width, x, w = (v[live] for v in (d, seed, low, width, x, w))
    return kept.reshape(docs, size)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    parts = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, parts.shape[:2])
    for k in range(rows):
        out = _mix(out + parts[:, :, k])
    return out.view(np.int64)


def as_set(counted: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers for a multiset: its n-th copy of an element is an element of its own."""
    values, n = np.unique(counted, return_counts=True)
    nth = (np.arange(len(counted)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    values = np.repeat(values, n)
    return np.sort(np.where(nth == 0, values, _mix(values + nth * _GOLDEN)).view(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, h, key, n, bands`` of every document, whole texts; ``h`` is the text's hash."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, start, waiting = [], [], 0, 0

            def flush():
                sets = [np.unique(p, return_counts=True) for p in parts]
                full = [i for i, (v, _) in enumerate(sets) if len(v)]
                out = [None] * len(sets)
                if full:
                    doc = np.repeat(np.arange(len(full)), [len(sets[i][0]) for i in full])
                    found = bag_minhash(doc, np.concatenate([sets[i][0] for i in full]), np.concatenate([sets[i][1] for i in full]), len(full), bands * rows)
                    for i, b in zip(full, band_hashes(found, bands, rows), strict=True):
                        out[i] = b
                empty = np.zeros(0, np.int64)
                columns = [batch.column(0).slice(start, len(parts)), batch.column(2).slice(start, len(parts)), pa.array(keys, pa.binary()), pa.array([len(p) for p in parts], pa.int64()), pa.array([empty if b is None else b for b in out], pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "key", "n", "bands"])

            for value in batch.column(1):
                text = value.as_py()
                words = words_of(text)
                keys.append(content_key(text, words))
                parts.append(shingles(words, size))
                waiting += len(parts[-1])
                if waiting > 15_000 or len(parts) == 256:
                    yield flush()
                    start += len(parts)
                    keys, parts, waiting = [], [], 0
            if parts:
                yield flush()

    schema = f"doc_id {id_type}, h long, key binary, n long, bands array<long>"
    return short_batches(docs).select(docs[id_col].alias("doc_id"), whole_text(text_col).alias("text"), F.xxhash64(whole_text(text_col)).alias("h")).mapInArrow(run, schema)


def multisets(texts: DataFrame, size: int) -> DataFrame:
    """``key, items`` of texts in a column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, items = [], []
                for value in batch.column(0).slice(at, 256):
                    text = value.as_py()
                    words = words_of(text)
                    keys.append(content_key(text, words))
                    items.append(as_set(shingles(words, size)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["key", "items"])

    return short_batches(texts).select("text").mapInArrow(run, "key binary, items array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with ``na, nb, common``: sizes and exact overlap of the multisets of each pair."""
    left = sets.select(F.col("key").alias("a"), F.col("items").alias("_ia"))
    right = sets.select(F.col("key").alias("b"), F.col("items").alias("_ib"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(*pairs.columns, F.size("_ia").alias("na"), F.size("_ib").alias("nb"), F.size(F.array_intersect("_ia", "_ib")).alias("common"))


def _meeting_places(about: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``e, band, key, n, root, left, tail, small, m``: elements on which a near pair of ``about`` must meet.

    With a multiset's elements from rarest to most common, a near pair has its
    first common one among the first ``1 - threshold`` of the larger and the
    first ``1 - 2 share`` of the smaller multiset, so whatever most documents
    of a group hold in common brings none of them together.  ``band`` is a step
    of sizes; the larger of a near pair is in the same or the next step, and is
    listed in both.  Only places where several roots meet are listed, ``m`` is
    the number of documents there.  ``left`` counts a document's elements that
    others hold too from ``e`` on, ``tail`` is a hash of those after ``e``.
    """
    share = threshold / (1 + threshold)
    rows = about.join(sets, "key").select("key", "root", F.size("items").alias("n"), F.explode("items").alias("e"))
    held = rows.groupBy("e").agg(F.count(F.lit(1)).alias("df"), (F.min("root") != F.max("root")).alias("mixed")).where("df > 1")
    common = rows.join(held, "e").groupBy("key", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e", "mixed"))).alias("c"))
    whole = F.aggregate("c", F.lit(0).cast("long"), lambda h, x: h.bitwiseXOR(x["e"]))
    ahead = F.transform("c", lambda x, i: F.struct((F.size("c") - i).alias("left"), x["e"].alias("e"), x["mixed"].alias("mixed")))
    early = F.filter(ahead, lambda x: x["left"] >= (threshold - 1e-9) * F.col("n"))
    passed = F.bit_xor("x.e").over(Window.partitionBy("key", "root", "n").orderBy(F.desc("x.left")).rowsBetween(Window.unboundedPreceding, 0))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    listed = common.select("key", "root", "n", step.alias("s"), whole.alias("whole"), F.explode(early).alias("x"))
    listed = listed.withColumn("tail", F.col("whole").bitwiseXOR(passed)).where("x.mixed")
    listed = listed.select("x.e", F.explode(F.array("s", F.col("s") - 1)).alias("band"), "key", "n", "root", "x.left", "tail", (F.col("x.left") >= (2 * share - 1e-9) * F.col("n")).alias("small"), "s")
    listed = listed.withColumn("small", F.col("small") & (F.col("s") == F.col("band"))).drop("s")
    several = listed.groupBy("e", "band").agg(F.max("small").alias("_any"), (F.min("root") != F.max("root")).alias("_mixed"), F.count(F.lit(1)).alias("m"))
    return listed.join(several.where("_any and _mixed").select("e", "band", "m"), ["e", "band"])


def _pair(x: str, y: str) -> list[Column]:
    """Columns ``a, b, ra, rb`` of the pair of structs (key, root) ``x`` and ``y``, the lesser key first."""
    low, high = F.least(x, y), F.greatest(x, y)
    return [low["key"].alias("a"), high["key"].alias("b"), low["root"].alias("ra"), high["root"].alias("rb")]


def _met(places: DataFrame) -> DataFrame:
    """Pairs of documents with different roots that meet at a place."""
    one = F.struct("key", "root")
    x = places.where("small").select("e", "band", one.alias("x"), F.col("n").alias("nx"))
    y = places.select("e", "band", one.alias("y"), F.col("n").alias("ny"))
    return x.join(y, ["e", "band"]).where("x.root != y.root and (nx < ny or nx = ny and x.key < y.key)").select(*_pair("x", "y"))


def _starred(places: DataFrame, order: list[Column]) -> DataFrame:
    """At each place, the first document by ``order`` paired with the first one of every other root."""
    first = places.groupBy("e", "band", "root").agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct("key", "root").alias("x"))).alias("r"))
    centre = first.groupBy("e", "band").agg(F.min("r").alias("c"))
    return first.join(centre, ["e", "band"]).where("r.x.root != c.x.root").select(F.col("r.x").alias("x"), F.col("c.x").alias("y")).select(*_pair("x", "y"))


def _open(places: DataFrame, share: float, tile: int = 512) -> DataFrame:
    """Pairs that leave no near pair of documents that meet at a place unconnected.

    A near pair whose first common element is ``e`` has exactly its two tails'
    overlap in common, which is the same for any two documents with these tails
    and enough for smaller ones.  So either is near the smallest document with
    the other's tail, and those two are near each other: it is enough to pair
    each document with the smallest one of each tail.  ``left`` bounds the
    overlap.  Documents and tails are dealt into tiles, so that no task gets
    all of a place.
    """
    one = F.struct("key", "root")
    tails = places.groupBy("e", "band", "tail").agg(F.min(F.struct("n", one.alias("x"), "left")).alias("r"))
    tails = tails.select("e", "band", "tail", F.col("r.x").alias("y"), F.col("r.n").alias("ny"), F.col("r.left").alias("ly"))
    tiles = places.groupBy("e", "band").agg(F.ceil(F.count(F.lit(1)) / tile).alias("rows")).join(tails.groupBy("e", "band").agg(F.ceil(F.count(F.lit(1)) / tile).alias("columns")), ["e", "band"])
    x = places.select("e", "band", one.alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx")).join(tiles, ["e", "band"])
    x = x.withColumn("i", F.pmod(F.xxhash64("x.key"), "rows")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1))).drop("rows", "columns")
    y = tails.join(tiles, ["e", "band"])
    y = y.withColumn("j", F.pmod(F.xxhash64("tail"), "columns")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).drop("rows", "columns", "tail")
    may = F.least("lx", "ly") >= share * (F.col("nx") + F.col("ny"))
    return x.join(y, ["e", "band", "i", "j"]).where(may & F.expr("x.root != y.root")).select(*_pair("x", "y"))


def _further_links(stars: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float, near: Column, few: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links ``a, b`` between documents under one centre of which one isn't near it, and what roots they join: ``root, into``."""
    loose = stars.where("loose").select("b").distinct()
    about = stars.join(loose, "b", "left_semi").select(F.col("a").alias("key")).distinct()
    about = about.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    places = checkpoint(_meeting_places(checkpoint(about), sets, threshold))
    links, joined, turn = [], [], 0

    def linked(pairs: DataFrame) -> bool:
        found = checkpoint(_compared(pairs.distinct(), sets).where(near).select("a", "b", "ra", "rb"))
        if found.isEmpty():
            return False
        links.append(found.select("a", "b"))
        joined.append(connected_components(found, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("into")))
        return True

    while not places.isEmpty():
        # where few documents meet, each pair; elsewhere stars: around the smallest document, then around others in turn until they find no link
        pairs = _starred(places.where(F.col("m") > few), [~F.col("small"), F.col("n")] if turn == 0 else [F.xxhash64(F.lit(turn), "key")])
        if turn == 0:
            pairs = pairs.unionByName(_met(places.where(F.col("m") <= few)))
        if not linked(pairs):
            break
        places = places.where(F.col("m") > few).join(joined[-1], "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")
        several = places.groupBy("e", "band").agg((F.min("root") != F.max("root")).alias("_mixed"), F.max("small").alias("_any")).where("_mixed and _any").select("e", "band")
        places = checkpoint(places.join(several, ["e", "band"]))
        turn += 1
    crowded = places.where(F.col("m") > few)
    if not crowded.isEmpty():
        linked(_open(crowded, threshold / (1 + threshold) - 1e-9))
    return links, joined


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, few: int = 8) -> DataFrame:
    """``doc_id, h, root, class_id, class_size, n_links`` of every document; ``h`` is its text's hash, ``root`` tells classes apart."""
    # J >= threshold is the same as overlap >= share * (sum of sizes)
    share = threshold / (1 + threshold) - 1e-12
    near = F.col("common") >= share * (F.col("na") + F.col("nb"))
    marks = checkpoint(signatures(docs, id_col, text_col, size, bands, rows))
    keys = marks.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    entries = keys.select("key", F.explode("bands").alias("bucket"))
    shared = checkpoint(entries.join(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "bucket"))
    wide = shared.join(shared.groupBy("key").agg(F.sum("m").alias("reach")), "key")
    centres = wide.groupBy("bucket").agg(F.max(F.struct("reach", "key")).alias("c")).select("bucket", F.col("c.key").alias("centre"))
    star = checkpoint(shared.join(centres, "bucket").where("key != centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct())
    involved = star.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # one document of each key involved; its text gives the multiset
    wanted = keys.select("key", "least").join(involved, "key", "left_semi").select(F.col("least").alias("_least")).distinct()
    texts = docs.select(docs[id_col].alias("_id"), whole_text(text_col).alias("text")).join(wanted, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = checkpoint(multisets(texts, size).dropDuplicates(["key"]))
    stars = checkpoint(_compared(star, sets).withColumn("loose", ~near))
    links = stars.where("not loose").select("a", "b")
    roots = connected_components(links, "a", "b")
    more, joined = _further_links(stars, sets, roots, threshold, near, few)
    for found in more:
        links = links.unionByName(found)
    links = links.distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    classed = keys.select("key", "least", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    for into in joined:
        classed = classed.join(into, "root", "left").withColumn("root", F.coalesce("into", "root")).drop("into")
    classes = classed.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    of_key = classed.select("key", "root").join(classes, "root").join(degree, "key", "left")
    return marks.select("doc_id", "h", "key").join(of_key, "key").select("doc_id", "h", "root", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, n_links, kept``.

    ``class_id`` is the least id of the class, whose document is kept;
    ``n_links`` counts compared and confirmed links of the document's word
    sequence to other word sequences.

    Defined cases: words are runs of letters, digits and underscores in lower
    case; fewer than ``size`` words are one shingle; texts without words (null
    counts as empty) are near-duplicates only of equal texts; rows that repeat
    an id count each, and stay together if their class keeps that id; null ids
    are kept only in a class without any other id; an empty table gives an
    empty result; columns other than the two named are not read.
    """
    return _classes(docs, id_col, text_col, **options).select("doc_id", "class_id", "class_size", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs``, all columns, for each class of near-duplicates.

    Defined cases: those of ``near_dedup``; of rows of a class that repeat the
    kept id, one stays (of rows that repeat id and text, any one).
    """
    found = checkpoint(_classes(docs, id_col, text_col, **options).where(F.col("doc_id").eqNullSafe(F.col("class_id"))))
    # a class keeps one text of its id, a text one row
    kept = checkpoint(found.groupBy("root").agg(F.first("doc_id").alias("id"), F.min("h").alias("h"), F.count(F.lit(1)).alias("n")).drop("root"))
    own, hashed = docs[id_col], F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))

    def rows_of(some: DataFrame) -> DataFrame:
        return docs.join(some, own.eqNullSafe(some["id"]) & (hashed == some["h"]), "left_semi")

    several = kept.where("n > 1")
    if several.isEmpty():
        return rows_of(kept)
    return rows_of(kept.where("n = 1")).unionByName(rows_of(several).dropDuplicates([id_col, text_col]))
