"""Evaluation texts leaking into training text.

Items and documents are cut into windows of the same size. Sizes are WINDOW words (a shorter
item is one window), which finds every run of WINDOW equal words, and, for whole passages with
small edits, the item's own size: the largest of a fixed scale (steps of about STEP) that is
at most FILL of the item, so that the windows of an item slide over at least one window of a
document, of which every s // STRIDE-th is looked at. Each window gets a 64-bit SimHash: of
words and word pairs for WINDOW, of words for whole items. The item fingerprints are indexed
by four blocks of 16 bits. Two fingerprints within RADIUS = 3 bits agree in at least one
block; within WIDE_RADIUS = 7 bits they differ by at most one bit in at least one block, and
the index of whole items holds each block under these 17 values: the lookup finds every item
window within the radius. Candidates are verified by the exact weighted Jaccard similarity of
their five-word shingles, at least LEAST; a shingle weighs the sum of its words' inverse
document frequencies, counted over all documents in a bounded sketch.

A changed word breaks five shingles, so at 0.8 a window of 57 words stands one change, one of
130 words two. A passage with one word in ten changed is not similar in this sense; its runs
of WINDOW words, if any is left, are what finds it.

The index holds at most INDEX_WINDOWS windows at a time; larger item sets are looked up
block by block, each block against all documents, whose words are then hashed and written
once. Documents are read as one stream of words, in pieces that overlap by a window, so that a
text's length does not matter.

Null and empty texts have no windows. Items with fewer than five words are compared as one
shingle. Repeated items or documents give one row for each pair of ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.words import py_words, words
from sievelake.session import materialize

WIDE_RADIUS, STEP, FILL, STRIDE, LEAST_ITEM = 7, 1.12, 0.94, 16, 32
WINDOW, RADIUS, SHINGLE, LEAST = 16, 3, 5, 0.8
SKETCH = 1 << 18
INDEX_WINDOWS = 400_000
PIECE = 1 << 15
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_HASHES: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words; a cache per worker spares most of the hashing."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    out = []
    for w in py_words(text):
        h = _HASHES.get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all windows of ``size`` consecutive words; features are the words and their pairs."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pair = (h[:-1] * _MIX[0]) ^ (h[1:] * _MIX[1])
    ones = np.zeros((n, 64), np.int16)
    for feats, width in ((h, size), (pair, size - 1)):
        if width:
            bits = np.unpackbits(feats.view(np.uint8)).reshape(-1, 64)
            total = np.zeros((len(feats) + 1, 64), np.int32)
            np.cumsum(bits, axis=0, out=total[1:])
            ones += (total[width : width + n] - total[:n]).astype(np.int16)
    return np.packbits(ones * 2 > 2 * size - 1, axis=1).reshape(-1).view(np.uint64)


def shingle_weights(h: np.ndarray, idf: np.ndarray) -> dict[int, float]:
    """Weights of a window's shingles."""
    k = min(SHINGLE, len(h))
    word = idf[h % np.uint64(SKETCH)]
    mixed = np.zeros(len(h) - k + 1, np.uint64)
    weight = np.zeros(len(h) - k + 1)
    for j in range(k):
        mixed = (mixed * _MIX[0]) ^ (h[j : len(h) - k + 1 + j] * _MIX[1])
        weight += word[j : len(h) - k + 1 + j]
    return dict(zip(mixed.tolist(), weight.tolist()))


def weighted_jaccard(a: dict[int, float], b: dict[int, float]) -> float:
    common = sum(w for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def item_size(n: int) -> int:
    """Size of the windows of whole items of n words; 0 for short ones."""
    s, out = float(LEAST_ITEM), 0
    while int(s) <= FILL * n:
        out, s = int(s), s * STEP
    return out


class Words:
    """A run of words with running sums of their hash bits, from which windows of any size get their fingerprints."""

    def __init__(self, h: np.ndarray):
        self.h, self.total = h, np.zeros((len(h) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(h.view(np.uint8)).reshape(-1, 64), axis=0, out=self.total[1:])

    def prints(self, size: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(places, SimHashes of the words) of every stride-th window."""
        at = np.arange(0, len(self.h) - size + 1, stride)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        return at, np.packbits((self.total[at + size] - self.total[at]) * 2 > size, axis=1).reshape(-1).view(np.uint64)


class ItemIndex:
    """Windows of a bounded number of items, with the multi-index over their fingerprints' blocks."""

    def __init__(self, items: list[tuple[str, str]], idf: np.ndarray, whole: bool = False):
        self.idf, self.sizes, self.wide = idf, {}, {}
        by_size: dict[tuple[bool, int], list] = {}
        for item, text in items:
            h = word_hashes(text)
            if len(h):
                by_size.setdefault((False, min(WINDOW, len(h))), []).append((item, h))
                if whole and item_size(len(h)):
                    by_size.setdefault((True, item_size(len(h))), []).append((item, h))
        for (wide, size), rows in by_size.items():
            marks, owners, wins = [], [], []
            for item, h in rows:
                f = Words(h).prints(size)[1] if wide else fingerprints(h, size)
                marks.append(f)
                owners += [item] * len(f)
                wins.append(np.lib.stride_tricks.sliding_window_view(h, size))
            marks, wins = np.concatenate(marks), np.concatenate(wins)
            blocks, near = [], np.array([0, *(1 << np.arange(16))]) if wide else np.zeros(1, np.int64)
            for b in range(4):
                v = ((marks >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                v = (v[:, None] ^ near[None, :]).reshape(-1)
                order = np.argsort(v, kind="stable")
                blocks.append((order // len(near), np.searchsorted(v[order], np.arange(65537))))
            (self.wide if wide else self.sizes)[size] = (marks, np.array(owners, object), wins, [shingle_weights(w, idf) for w in wins], blocks)

    @staticmethod
    def within(held: tuple, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the fingerprint, item window) of all pairs within the radius."""
        marks, _, _, _, blocks = held
        found = []
        for b, (order, start) in enumerate(blocks):
            v = ((own >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            count = start[v + 1] - start[v]
            at = np.repeat(np.arange(len(own)), count)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            item = order[start[v[at]] + inner] if len(at) else np.zeros(0, np.int64)
            near = np.bitwise_count(own[at] ^ marks[item]) <= radius
            found.append(at[near] * len(marks) + item[near])
        both = np.unique(np.concatenate(found))
        return both // len(marks), both % len(marks)

    def matches(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window position, item window) of all pairs within the radius."""
        return self.within(self.sizes[size], fingerprints(h, size), RADIUS)

    def overlap(self) -> int:
        return max([*self.sizes, *self.wide, 1]) - 1


def _lookup(index: ItemIndex):
    def checked(ids, h, size, held, at, item):
        _, owners, wins, weights, _ = held
        inside = ids[at] == ids[at + size - 1]
        for p, i in zip(at[inside].tolist(), item[inside].tolist()):
            window = h[p : p + size]
            same = bool((window == wins[i]).all())
            sim = 1.0 if same else weighted_jaccard(shingle_weights(window, index.idf), weights[i])
            if sim >= LEAST:
                yield ids[p], owners[i], sim, size if same else 0

    def piece(ids: np.ndarray, h: np.ndarray):
        """ids: document of each word. Windows that begin in the overlap belong to the next piece."""
        for size, held in index.sizes.items():
            at, item = index.matches(h[: PIECE + size - 1], size)
            yield from checked(ids, h, size, held, at, item)
        if index.wide:
            run = Words(h)
            for size, held in index.wide.items():
                at, own = run.prints(size, max(1, size // STRIDE))
                own, at = own[at < PIECE], at[at < PIECE]
                n, item = index.within(held, own, WIDE_RADIUS)
                yield from checked(ids, h, size, held, at[n], item)

    def run(batches):
        beyond = index.overlap()
        with np.errstate(over="ignore"):
            for pdf in batches:
                hs = [np.frombuffer(x, np.uint64) for x in pdf["words"]] if "words" in pdf else [word_hashes(t) for t in pdf["text"]]
                ids = np.repeat(pdf["doc_id"].to_numpy(), [len(x) for x in hs])
                h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
                out = []
                for at in range(0, len(h), PIECE):
                    out += piece(ids[at : at + PIECE + beyond], h[at : at + PIECE + beyond])
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "similarity", "same_words"]).groupby(["doc_id", "item_id"], as_index=False).agg(windows=("similarity", "size"), similarity=("similarity", "max"), same_words=("same_words", "max"))

    return run


def hashed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the documents' words as 64-bit hashes, written once."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": [word_hashes(t).tobytes() for t in pdf["text"]]})

    return materialize(docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words binary"), "words")


def inverse_frequencies(documents: DataFrame, text_col: str) -> np.ndarray:
    """ln(1 + N/df) by word bucket over all documents; SKETCH numbers at most."""

    def run(batches):
        for pdf in batches:
            total = np.zeros(SKETCH, np.int64)
            for t in pdf[text_col]:
                h = word_hashes(t)
                if len(h):
                    total[np.unique(h % np.uint64(SKETCH))] += 1
            b = np.nonzero(total)[0]
            yield pd.DataFrame({"b": b, "n": total[b]})

    rows = documents.select(text_col).mapInPandas(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(SKETCH)
    df[rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return np.log1p(max(1, documents.count()) / np.maximum(1, df))


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", whole: bool = False) -> DataFrame:
    """(doc_id, item_id, windows, similarity, same_words): each document with each item it holds a window of.

    windows counts the matching window pairs, similarity is the best of them, same_words the
    size of a window that is equal word for word (0 if none is). ``whole`` looks for whole items
    with small edits, too.
    """
    spark = documents.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(passage_col).alias("passage")).filter("item_id IS NOT NULL AND passage IS NOT NULL")
    total = items.agg(F.sum(F.size(words(F.col("passage"))))).first()[0] or 0
    blocks = max(1, math.ceil(total / INDEX_WINDOWS))
    idf = inverse_frequencies(documents, text_col)
    docs = documents.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if blocks > 1:
        docs = hashed_words(docs)
    out = None
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        held = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["passage"]) for r in part.collect()], idf, whole))

        def run(batches, held=held):
            yield from _lookup(held.value)(batches)

        found = docs.mapInPandas(run, f"doc_id {kind}, item_id string, windows long, similarity double, same_words int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max("similarity").alias("similarity"), F.max("same_words").alias("same_words"))
