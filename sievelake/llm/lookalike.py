"""Visually identical text with different characters.

Every value is mapped to a *form*: width variants, look-alike letters, kinds of space and
hyphen, invisible characters and ligatures go to one spelling. Forms are then grouped in SQL
under Spark's accent-sensitive ``UNICODE`` collation. Each class has a canonical member: one of
its own values as it stands, of those that are their own form (none of their characters had to
be mapped) the one with the smallest digest, else the smallest of all. It is joined back to
every value, so text of another script stays as some row holds it. Forms are only compared,
never shown.

Nulls and empty values stay as they are and belong to no class. Two values whose forms
differ only in what can be seen (capitals, accents, raised or circled digits, joined
emoji, line breaks) are in different classes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievelake.session import materialize

# Single letters of Cyrillic, Greek, Armenian and of Latin's extensions that Unicode's
# table of confusable characters (Technical Standard 39) maps to a Latin letter. Left out are Greek alpha,
# iota, upsilon and gamma and Cyrillic pe, which running text shows apart from a, i, u, y and n.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛգ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝա", "x": "хχ", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
# Hyphens drawn like the ASCII one.
HYPHENS = "\u2010\u2011\ufe63"
# Ranges of Unicode's default-ignorable code points, U+200D excepted.
INVISIBLE = (
    r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200c\u200e\u200f\u202a-\u202e"
    r"\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0100-\U000e0fff"
)
SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Stand-ins for joiners and tags that can be seen, because collation ignores these themselves; where a text holds
#: such a private-use character itself, it is written after ESCAPE.
JOINER, ESCAPE, TAG_BASE = "\ue000", "\ue001", 0xE100
EMOJI = r"\u203c-\u3299\U0001f000-\U0001faff"


def _table() -> dict[str, str]:
    """Single characters and what they become, by rule from the Unicode database where it has one."""
    out = {c: to for to, many in LOOKALIKES.items() for c in many}
    for lo, hi in ((0xFF01, 0xFFEE), (0x2F00, 0x2FD5), (0x2160, 0x217F), (0xFB00, 0xFB06)):
        for cp in range(lo, hi + 1):
            d = unicodedata.decomposition(chr(cp)).split()
            if d and d[0] in ("<wide>", "<narrow>", "<compat>"):
                out[chr(cp)] = "".join(chr(int(x, 16)) for x in d[1:])
    out |= dict.fromkeys(HYPHENS, "-")
    out |= dict.fromkeys("\u2028\u2029\u0085", "\n")
    for cp in range(0xE0020, 0xE0080):  # tag characters: seen only as part of a flag
        out[chr(cp)] = ""
    return {k: "".join(out.get(c, c) for c in v) for k, v in out.items()}


TABLE = _table()
_CHANGED = re.compile(f"[{''.join(TABLE)}]")
_DROP = re.compile(f"[{INVISIBLE}]")
_SPACE = re.compile(f"[{SPACES}]")
_JOIN = re.compile(rf"(?<=[{EMOJI}])\u200d(?=[{EMOJI}])")
_FLAG = re.compile("\U0001f3f4[\U000e0020-\U000e007f]+")
_STAND_INS = re.compile("[\ue000\ue001\ue120-\ue17f]")
_ASCII_DIRT = re.compile("[\x00-\x08\x0b-\x1f\x7f]")


def form(s: str | None) -> str | None:
    """The look-alike form of one value (joiners still as stand-ins)."""
    if not s:
        return s
    if s.isascii():
        return _ASCII_DIRT.sub("", s.replace("\r\n", "\n").replace("\r", "\n")) if _ASCII_DIRT.search(s) else s
    s = unicodedata.normalize("NFD", s.replace("\r\n", "\n").replace("\r", "\n"))
    s = _STAND_INS.sub(lambda m: ESCAPE + m[0], s)
    s = _FLAG.sub(lambda m: m[0][0] + "".join(chr(TAG_BASE + ord(c) - 0xE0000) for c in m[0][1:]), s)
    s = _JOIN.sub(JOINER, _DROP.sub("", s)).replace("\u200d", "")
    s = _SPACE.sub(" ", s)
    return unicodedata.normalize("NFC", _CHANGED.sub(lambda m: TABLE[m[0]], s))


def shown(s: str | None) -> str | None:
    """A form with the stand-ins replaced by the characters they stand for."""
    if s is None or s.isascii():
        return s

    def plain(m: re.Match) -> str:
        c = m[0]
        return c[1] if len(c) == 2 else "\u200d" if c == JOINER else chr(0xE0000 + ord(c) - TAG_BASE)

    return re.sub("\ue001[\ue000\ue001\ue120-\ue17f]|[\ue000\ue120-\ue17f]", plain, s)


@F.pandas_udf(StringType())
def form_udf(s: pd.Series) -> pd.Series:
    return s.map(form, na_action="ignore")


def fields_of(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, value) of every row and field with a value."""
    df = df.select(F.col(id_col).alias("id"), *fields).filter("id IS NOT NULL")
    long = df.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("id", "x.field", "x.value")
    return long.filter(F.length("value") > 0)


def folded(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, value_key, form_key, form) of every row and field with a value, written once.

    Keys are digests of 128 bits: after the grouping nothing longer than a key is shuffled.
    """
    forms = fields_of(df, id_col, fields).withColumn("form", form_udf("value"))
    return materialize(forms.select("id", "field", F.unhex(F.md5("value")).alias("value_key"), F.unhex(F.md5("form")).alias("form_key"), "form"), "forms")


def classes(forms: DataFrame) -> DataFrame:
    """(field, class_key, canonical_key, last_key): the classes under the collation, each with the member of the smallest digest as canonical one."""
    return forms.sparkSession.sql(
        "SELECT field, collate(form, 'UNICODE') AS class_key, min(form_key) AS canonical_key, max(form_key) AS last_key FROM {forms} GROUP BY field, collate(form, 'UNICODE')",
        forms=forms.select("field", "form", "form_key"),
    )


def with_class(forms: DataFrame) -> DataFrame:
    """(id, field, value_key, form_key, canonical_key): the canonical member of its class joined back to every value.

    A class of one form is its own canonical member. Only classes in which the collation
    brings several forms together have to be joined back by collation; the mapping leaves few.
    """
    several = materialize(classes(forms).filter("canonical_key <> last_key").select("field", F.col("class_key").cast("string").alias("class_form"), "canonical_key"), "classes")
    rows = forms.select("id", "field", "value_key", "form_key")
    if several.isEmpty():
        return rows.withColumn("canonical_key", F.col("form_key"))
    back = forms.sparkSession.sql(
        "SELECT DISTINCT f.field, f.form_key, c.canonical_key FROM {forms} f JOIN {several} c ON f.field = c.field AND collate(f.form, 'UNICODE') = collate(c.class_form, 'UNICODE')",
        forms=forms.select("field", "form", "form_key"), several=several,
    )
    return rows.join(back, ["field", "form_key"], "left").withColumn("canonical_key", F.coalesce("canonical_key", "form_key"))


def spellings(forms: DataFrame) -> DataFrame:
    """(field, canonical_key, value_key, chosen_key) of every spelling in a class of several; chosen_key is the canonical member's."""
    each = with_class(forms).select("field", "canonical_key", "value_key", (F.col("value_key") != F.col("form_key")).alias("mapped")).distinct()
    # smallest and largest key of a class decide whether it has two spellings; all combine before the shuffle
    best = each.groupBy("field", "canonical_key").agg(F.min(F.struct("mapped", "value_key")).alias("best"), F.min("value_key").alias("lo"), F.max("value_key").alias("hi"))
    several = best.filter("lo <> hi").select("field", "canonical_key", F.col("best.value_key").alias("chosen_key"))
    return each.join(several, ["field", "canonical_key"]).select("field", "canonical_key", "value_key", "chosen_key")


def _chosen(df: DataFrame, id_col: str, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values (id, field, value, value_key), spellings, texts (field, chosen_key, canonical) of the canonical members)."""
    values = fields_of(df, id_col, fields).withColumn("value_key", F.unhex(F.md5("value")))
    spelled = materialize(spellings(folded(df, id_col, fields)), "spellings")
    chosen = spelled.select("field", "chosen_key").distinct()
    held = values.select("field", F.col("value_key").alias("chosen_key"), "value").join(chosen, ["field", "chosen_key"])
    return values, spelled, held.groupBy("field", "chosen_key").agg(F.min("value").alias("canonical"))


def canonical_values(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, canonical): every value as the canonical member of its class; repeated rows of an id count once.

    Only spellings of classes with several are joined; every other value is its own canonical member.
    """
    values, spelled, texts = _chosen(df, id_col, fields)
    other = spelled.filter("value_key <> chosen_key").join(texts, ["field", "chosen_key"]).select("field", "value_key", "canonical")
    return values.join(other, ["field", "value_key"], "left").select("id", "field", F.coalesce("canonical", "value").alias("canonical")).distinct()


def class_counts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, canonical, spellings, ids): the classes with several spellings and how many ids hold one of them."""
    values, spelled, texts = _chosen(df, id_col, fields)
    ids = values.select("id", "field", "value_key").distinct().join(spelled, ["field", "value_key"]).groupBy("field", "chosen_key").agg(F.count_distinct("value_key").alias("spellings"), F.count_distinct("id").alias("ids"))
    return ids.join(texts, ["field", "chosen_key"]).select("field", "canonical", "spellings", "ids")


def alike_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b, of rows whose values look the same but are different strings.

    Different spellings of a class are paired first and only then expanded to their ids, so
    copies of one spelling are never paired with each other.
    """
    tagged = with_class(folded(df, id_col, fields)).select("id", "field", "value_key", "canonical_key")
    # min and max over a class decide whether it has two spellings; both combine before the shuffle
    mixed = tagged.groupBy("field", "canonical_key").agg(F.min("value_key").alias("lo"), F.max("value_key").alias("hi")).filter("lo <> hi")
    m = materialize(tagged.join(mixed.select("field", "canonical_key"), ["field", "canonical_key"], "left_semi").distinct(), "spellings")
    spell = m.select("field", "canonical_key", "value_key").distinct()
    pairs = spell.alias("a").join(spell.alias("b"), ["field", "canonical_key"]).filter("a.value_key <> b.value_key").select("field", F.col("a.value_key").alias("va"), F.col("b.value_key").alias("vb"))
    left = m.select("field", F.col("value_key").alias("va"), F.col("id").alias("id_a"))
    right = m.select("field", F.col("value_key").alias("vb"), F.col("id").alias("id_b"))
    return pairs.join(left, ["field", "va"]).join(right, ["field", "vb"]).filter("id_a < id_b").select("field", "id_a", "id_b").distinct()
