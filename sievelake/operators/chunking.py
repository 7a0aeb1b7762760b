"""Documents to chunks: headings, paragraphs, sentences, topic boundaries, size adjustment."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sievelake.functions.embed import hashed_vectors
from sievelake.functions.text import has_headings, pack_weighed, split_headings, token_weight, tokens_of
from sievelake.functions.vectors import cosine

MAX_TOKENS, MIN_TOKENS, MIN_SEGMENT = 512, 256, 2
# Words after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr vs etc fig vol dept est approx ie eg al st ave no op ch pp".split())
# Sentence ends, and closing marks that stay with the sentence.
ENDS, CLOSERS = ".!?;。！？；…", "\"')]}」』”’）】"
_STOP = re.compile(f"[{re.escape(ENDS)}]")
_TAIL = re.compile(f"[{re.escape(ENDS + CLOSERS)}]*")
_WORD_BEFORE = re.compile(r"[^\W\d_]+\Z")


def _ends_sentence(text: str, at: int) -> bool:
    c, nxt = text[at], text[at + 1 : at + 2]
    if c == "…":
        return not nxt or nxt.isspace()
    if c != ".":
        return True
    if nxt and not nxt.isspace():
        return False
    word = _WORD_BEFORE.search(text, max(0, at - 40), at)
    if not word:
        return True
    return word[0].lower() not in ABBREVIATIONS and not (len(word[0]) == 1 and word[0].isupper())


def split_sentences(text: str | None) -> list[str]:
    """Sentences with their end marks and closers; white space between them is dropped."""
    out, start, at = [], 0, 0
    text = text or ""
    while m := _STOP.search(text, at):
        at = m.end()
        if _ends_sentence(text, m.start()):
            at = _TAIL.match(text, at).end()
            if s := text[start:at].strip():
                out.append(s)
            start = at
    if s := text[start:].strip():
        out.append(s)
    return out


@F.pandas_udf(ArrayType(StringType()))
def sentences(text: pd.Series) -> pd.Series:
    return text.map(split_sentences)


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, at, title, content) by headings; the whole text where there are none."""
    whole = F.array(F.struct(F.lit("").alias("title"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("content")))
    parts = F.when(has_headings(F.col("text")), split_headings(F.col("text"))).otherwise(whole)
    return docs.select("doc_id", F.posexplode(parts).alias("at", "s")).select("doc_id", "at", "s.title", "s.content")


def merge_small(pieces: Column, least: int) -> Column:
    """Array of (title, content, w): a piece under ``least`` tokens goes to the end of the one before it and loses its title."""
    start = F.array().cast("array<struct<title:string,content:string,w:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.struct(last["title"].alias("title"), F.concat(last["content"], F.lit("\n\n"), x["content"]).alias("content"), (last["w"] + x["w"]).alias("w"))
        return F.when((tokens_of(x["w"]) < least) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, start, step)


def smart_split(docs: DataFrame, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, chunk_index, title, content, token_count, hierarchy, node_type) of docs (doc_id, text, base).

    Headings first; sections over max_tokens by paragraphs; small pieces into their
    predecessor; what is then over 1.5 * max_tokens by paragraphs again. All in expressions
    over one row, so documents are never grouped or sorted; a piece carries its token weight,
    so that texts are weighed once.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    whole = F.array(F.struct(F.lit("").alias("title"), text.alias("content")))
    parts = F.filter(F.when(has_headings(text), split_headings(text)).otherwise(whole), lambda s: s["content"] != "")
    weighed = F.transform(parts, lambda s: F.struct(s["title"].alias("title"), s["content"].alias("content"), token_weight(s["content"]).alias("w")))

    def pack(s: Column, over: float) -> Column:
        many = F.transform(pack_weighed(s["content"], max_tokens), lambda p: F.struct(s["title"].alias("title"), p["content"].alias("content"), p["w"].alias("w")))
        return F.when(tokens_of(s["w"]) <= over, F.array(s)).otherwise(many)

    d = docs.select("doc_id", "base", weighed.alias("p"))
    d = d.select("doc_id", "base", merge_small(F.flatten(F.transform("p", lambda s: pack(s, max_tokens))), min_tokens).alias("p"))
    d = d.select("doc_id", "base", F.posexplode(F.flatten(F.transform("p", lambda s: pack(s, int(max_tokens * 1.5))))).alias("chunk_index", "s"))
    out = d.select("doc_id", "base", "chunk_index", "s.title", "s.content", "s.w")
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat(F.lit("chunk_"), F.col("chunk_index").cast("string")))
    return out.select("doc_id", "chunk_index", "title", "content", tokens_of(F.col("w")).alias("token_count"), F.concat("base", F.lit("/"), name).alias("hierarchy"), F.lit("chunk").alias("node_type"))


def overlapping(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, window, content): windows of ``size`` sentences that share ``overlap`` of them."""
    s = docs.select("doc_id", sentences("text").alias("s")).filter(F.size("s") > 0)
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - overlap - 1), F.lit(step))
    return s.select("doc_id", "s", F.posexplode(starts).alias("window", "at")).select("doc_id", "window", F.array_join(F.slice("s", F.col("at") + 1, size), " ").alias("content"))


def adjacent_distances(rows: DataFrame) -> DataFrame:
    """(source_file, chunk_index, id, next_id, distance): 1 - cosine between a chunk and the next of its file.

    rows: id, source_file, chunk_index, vector. Neighbours are joined on file and index, so
    one large file is spread over all tasks; of rows with equal index the smallest id stands.
    """
    r = rows.filter("source_file IS NOT NULL AND chunk_index IS NOT NULL").groupBy("source_file", "chunk_index").agg(F.min_by(F.struct("id", "vector"), "id").alias("x"))
    r = r.select("source_file", "chunk_index", "x.id", "x.vector")
    nxt = r.select("source_file", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("id").alias("next_id"), F.col("vector").alias("next_vector"))
    return r.join(nxt, ["source_file", "chunk_index"]).select("source_file", "chunk_index", "id", "next_id", (1 - cosine(F.col("vector"), F.col("next_vector"))).alias("distance"))


def boundaries(distances: Column, min_segment: int = MIN_SEGMENT) -> Column:
    """Indices of an array of distances over max(mean + 2*sd, 0.3), taken greedily at least min_segment apart; fewer than three distances have none."""
    n = F.size(distances)
    mean = F.aggregate(distances, F.lit(0.0), lambda acc, x: acc + x) / n
    square = F.aggregate(distances, F.lit(0.0), lambda acc, x: acc + x * x) / n
    least = F.greatest(mean + 2 * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), F.lit(0.3))
    high = F.filter(F.transform(distances, lambda x, i: F.when(x > least, i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    take = F.aggregate(high, none, lambda acc, i: F.when((F.size(acc) == 0) | (i - F.try_element_at(acc, F.lit(-1)) >= min_segment), F.concat(acc, F.array(i))).otherwise(acc))
    return F.when(n >= 3, take).otherwise(none)


def segments(sents: Column, bounds: Column) -> Column:
    """Array of texts: sentences joined by a space, cut after each boundary that leaves sentences on both sides."""
    cuts = F.filter(F.transform(bounds, lambda b: b + 1), lambda c: (c > 0) & (c < F.size(sents)))
    starts = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(F.size(sents)))
    return F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(sents, a + 1, b - a), " "))


def semantic_split(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, min_segment: int = MIN_SEGMENT) -> DataFrame:
    """(doc_id, segment, content): topics of docs (doc_id, text) by the distances between neighbouring sentences; under three sentences, one segment."""

    @F.pandas_udf("array<double>")
    def gaps(s: pd.Series) -> pd.Series:
        def one(x) -> list[float]:
            if len(x) < 3:
                return []
            v = embed(list(x))
            n = np.linalg.norm(v, axis=1)
            ok = (n[1:] * n[:-1]) > 0
            return (1 - np.where(ok, (v[1:] * v[:-1]).sum(1) / np.where(ok, n[1:] * n[:-1], 1), 0.0)).tolist()

        return s.map(one)

    d = docs.select("doc_id", sentences("text").alias("s")).filter(F.size("s") > 0)
    d = d.select("doc_id", "s", gaps("s").alias("d"))
    return d.select("doc_id", F.posexplode(segments(F.col("s"), boundaries(F.col("d"), min_segment))).alias("segment", "content"))
