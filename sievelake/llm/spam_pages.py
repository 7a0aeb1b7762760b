"""Keyword-stuffed and link-list pages.

Every text is cut into blocks of about BLOCK characters at line ends, or less where a
paragraph of at least PARAGRAPH characters ends. Words that fewer than one in COMMON
documents hold are brought to one placeholder first, and so are tokens that mix letters with
other characters inside (addresses, markup, numbers of articles), their digits apart: what a
list names then reads alike, whatever it names, while numbers, marks and common words keep
their entropy; the numbers of an ordered list's items are left out. A page's
blocks go through one compressor one after the other, so a block's compressed size is what it
adds to the text before it (the first block: to the text after it). The ratio to the block's
own size is divided by the usual ratio of sentences of the same language and length, a median
over all documents. A block below REDUNDANT is extremely redundant; it is confirmed if less
than half of its characters stand in sentences (a sentence ends with sentence punctuation and
has at least SENTENCE_WORDS words). A page is reported if confirmed blocks hold more than half
of its characters.

Logs, tables and configuration have few sentences, too, but their numbers and values do not
compress; references and tag lines under an article do not reach half of the page.

Document frequencies count all different texts. Common words are broadcast; there are at most
COMMON times as many as a text has distinct words on average.

Null and empty texts are never reported. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.session import materialize

BLOCK, PARAGRAPH, COMMON = 300, 40, 50
REDUNDANT, SENTENCE_WORDS, SHARE = 0.6, 6, 0.5
LENGTHS = (60, 120, 200, 300, 450)
PLACEHOLDER = "\x01"

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_SPACE = re.compile(r"\s")
_IDEO = re.compile(r"[一-鿿]")
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+")
_PIECE = re.compile(r"[一-鿿]|[^\s一-鿿\u3000-\u303f\uff00-\uffef]+|[\s\u3000-\u303f\uff00-\uffef]+")
_PART = re.compile(r"[^\W\d_]+")
#: The number of a list's item, at a line's start.
_MARKER = re.compile(r"^[ \t]*(?:[-*+] +)?(?:\d{1,4}[.)、．]|[(\[（]\d{1,4}[)\]）])(?!\d)[ \t]*", re.M)
_NO_DIGIT = re.compile(r"\D+")
#: What may stand around a word.
_AROUND = "()\"'[]{}.,;:!?…*_`~|·—–-«»“”‘’¿¡"
#: Lower-case words count as common from so many documents on, however small the collection.
LEAST_DOCUMENTS = 3
#: A sentence ends with its mark before white space, or with an ideographic mark; a line that goes on in lower case goes on.
_END = re.compile(r"(?<=[.!?;…])\s+|(?<=[。！？；])|\n(?![^\W\d_A-Z])")
_MARK = ".!?;…。！？；"


def blocks(text: str) -> list[str]:
    """The text in pieces that together are the text; long lines are cut at white space."""
    out, cur = [], ""
    for line in _LINE.findall(text):
        while len(line) > BLOCK * 3 // 2:
            space = _SPACE.search(line, BLOCK, BLOCK + 80)
            end = space.end() if space else BLOCK
            if cur:
                out.append(cur)
                cur = ""
            out.append(line[:end])
            line = line[end:]
        cur += line
        if len(cur) >= BLOCK or (len(cur) >= PARAGRAPH and not line.strip()):
            out.append(cur)
            cur = ""
    if len(cur) < PARAGRAPH and out:
        out[-1] += cur
    elif cur:
        out.append(cur)
    return out


class Reduced(dict):
    """Pieces of text and what they become; filled as they are met."""

    def __init__(self, common: frozenset[str]):
        self.common = common

    def __missing__(self, piece: str) -> str:
        if len(self) > 300_000:
            self.clear()
        out = self[piece] = self.reduced(piece)
        return out

    def word(self, m: re.Match) -> str:
        return m[0] if m[0].lower() in self.common else PLACEHOLDER

    def reduced(self, piece: str) -> str:
        core = piece.strip(_AROUND)
        if not any(c.isalpha() for c in core):
            return piece
        if piece[0] not in "#@" and re.sub(r"[-'’_]", "", core).isalpha():  # a word, or words joined to a name
            return _PART.sub(self.word, piece)
        return PLACEHOLDER + _NO_DIGIT.sub("", core)

    def text(self, s: str) -> bytes:
        return "".join(map(self.__getitem__, _PIECE.findall(_MARKER.sub("", s)))).encode()


def compressed_sizes(parts: list[bytes]) -> list[int]:
    """What each part adds, compressed, to those before it; the first to those after it."""

    def start(d: bytes):
        return zlib.compressobj(6, zlib.DEFLATED, -12, 5, zlib.Z_DEFAULT_STRATEGY, d) if d else zlib.compressobj(6, zlib.DEFLATED, -12, 5)

    z = start(b"".join(parts[1:4]))
    out = [len(z.compress(parts[0])) + len(z.flush(zlib.Z_SYNC_FLUSH))]
    if len(parts) > 1:
        z = start(parts[0])
        out += [len(z.compress(p)) + len(z.flush(zlib.Z_SYNC_FLUSH)) for p in parts[1:]]
    return out


def sentence_share(block: str) -> float:
    """Share of characters that stand in sentences of at least SENTENCE_WORDS words."""
    held = 0
    for s in _END.split(block):
        if s and s[-1] in _MARK and (len(s.split()) >= SENTENCE_WORDS or (not s.isascii() and len(_IDEO.findall(s)) >= SENTENCE_WORDS)):
            held += len(s)
    return held / max(1, len(block.strip()))


def language(lang: Column) -> Column:
    """Two lower-case letters, or xx."""
    two = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(F.length(two) == 2, two).otherwise("xx")


def common_words(docs: DataFrame) -> frozenset[str]:
    """Lower-case words that at least one in COMMON different texts holds; copies of a text count once."""

    def count(batches):
        for pdf in batches:
            n = Counter({"": len(pdf)})  # under the empty word: texts
            for t in pdf["text"]:
                n.update(set(_WORD.findall(t.lower())))
            yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())})

    held = docs.select("text").distinct().mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = materialize(held, "frequencies")
    texts = held.filter("word = ''").select("n").first()
    return frozenset(r["word"] for r in held.filter(F.col("n") >= max(LEAST_DOCUMENTS, texts["n"] / COMMON)).select("word").collect() if r["word"]) if texts else frozenset()


def block_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, size_class, chars, ratio, in_sentences), one row for each block."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), language(F.col(lang_col)).alias("lang")).filter(F.length("text") > 0)
    held = documents.sparkSession.sparkContext.broadcast(common_words(docs))

    def run(batches):
        reduced = Reduced(held.value)
        for pdf in batches:
            rows = []
            for doc, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                bs = blocks(text)
                for b, size in zip(bs, compressed_sizes([reduced.text(b) for b in bs])):
                    han = not b.isascii() and len(_IDEO.findall(b)) > 0.2 * len(b)
                    kind = "zh" if han else "xx" if lang == "zh" else lang
                    rows.append((doc, kind, sum(len(b) >= x for x in LENGTHS), len(b), size / len(b.encode()), sentence_share(b)))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "size_class", "chars", "ratio", "in_sentences"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, lang string, size_class int, chars int, ratio double, in_sentences double")


def usual_ratios(features: DataFrame) -> DataFrame:
    """(lang, size_class, usual): median over all documents of their blocks' mean ratio, of blocks made of sentences.

    At most (languages x sizes) rows: language is two letters. A document counts once, however long.
    """
    each = features.filter("in_sentences >= 0.8").groupBy("doc_id", "lang", "size_class").agg(F.avg("ratio").alias("ratio"))
    return each.groupBy("lang", "size_class").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"))


def scored_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, chars, stuffed_chars, stuffed_share) of every non-empty document."""
    f = materialize(block_features(documents, id_col, text_col, lang_col), "blocks")
    usual = usual_ratios(f)
    any_lang = usual.groupBy("size_class").agg(F.percentile_approx("usual", 0.5).alias("usual_any"))
    rel = F.col("ratio") / F.coalesce("usual", "usual_any", F.lit(0.6))
    stuffed = (rel < REDUNDANT) & (F.col("in_sentences") < 0.5)
    scored = f.join(usual, ["lang", "size_class"], "left").join(F.broadcast(any_lang), "size_class", "left")  # six rows
    by = scored.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum(F.when(stuffed, F.col("chars")).otherwise(0)).alias("stuffed_chars"))
    return by.withColumn("stuffed_share", F.col("stuffed_chars") / F.col("chars"))


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, stuffed_share) of the pages of which more than half is stuffed."""
    return scored_pages(documents, id_col, text_col, lang_col).filter(F.col("stuffed_share") > SHARE).select("doc_id", "stuffed_share")
