"""Text expressions: token estimate, headings, summaries by rule, paths, query parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character ranges that count as CJK in the token estimate.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}"
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def token_weight(text: Column) -> Column:
    """Ten times the token estimate before it is cut to a whole number; adds up over pieces joined by white space."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]"))
    other = F.regexp_count(t, F.lit(rf"[^{CJK}{SPACE}\p{{P}}]+"))
    return cjk * 15 + other * 13


def tokens_of(weight: Column) -> Column:
    return F.floor(weight / F.lit(10)).cast("int")


def token_estimate(text: Column) -> Column:
    """int(1.5 for each CJK character + 1.3 for each other word); 0 for null or empty."""
    return tokens_of(token_weight(text))


def has_headings(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?md)^#{1,6}\s+.+$"), F.lit(False))


def heading_title(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), "^#+", ""))


def split_headings(text: Column) -> Column:
    """Array of (title, content): the non-blank preamble and one entry for each heading, bodies trimmed."""
    marked = F.split(F.coalesce(text, F.lit("")), r"(?md)(?=^#{1,6}\s+\S)")
    parts = F.filter(marked, lambda p: F.length(F.regexp_replace(p, r"\s", "")) > 0)

    def entry(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?d)^#{1,6}\s+([^\n]+)", 1)
        body = F.regexp_replace(p, r"(?d)^#{1,6}\s+[^\n]+", "")
        return F.struct(F.trim(head).alias("title"), F.regexp_replace(F.when(head != "", body).otherwise(p), r"^\s+|\s+$", "").alias("content"))

    return F.transform(parts, entry)


def pack_weighed(text: Column, max_tokens: int) -> Column:
    """Array of (content, w): paragraphs packed greedily up to max_tokens; one that is larger stays whole. w is the token weight.

    The weight of a concatenation is the sum of the weights, so the fold never scans a text again.
    """
    paras = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    weighed = F.transform(paras, lambda p: F.struct(p.alias("p"), token_weight(p).alias("w")))
    start = F.struct(F.array().cast("array<struct<content:string,w:int>>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("w"))

    def piece(acc: Column) -> Column:
        return F.array(F.struct(acc["cur"].alias("content"), acc["w"].alias("w")))

    def step(acc: Column, x: Column) -> Column:
        flush = (tokens_of(acc["w"] + x["w"]) > max_tokens) & (acc["cur"] != "")
        return F.struct(
            F.when(flush, F.concat(acc["done"], piece(acc))).otherwise(acc["done"]).alias("done"),
            F.when(flush | (acc["cur"] == ""), x["p"]).otherwise(F.concat(acc["cur"], F.lit("\n\n"), x["p"])).alias("cur"),
            F.when(flush, x["w"]).otherwise(acc["w"] + x["w"]).alias("w"),
        )

    return F.aggregate(weighed, start, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], piece(acc))).otherwise(acc["done"]))


def pack_paragraphs(text: Column, max_tokens: int) -> Column:
    """The contents of pack_weighed."""
    return F.transform(pack_weighed(text, max_tokens), lambda p: p["content"])


def first_characters(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def l0_by_rule(text: Column) -> Column:
    """Up to the first ideographic full stop; else up to the first . ! ? before white space or the end; else 80 characters."""
    t = F.coalesce(text, F.lit(""))
    zh = F.regexp_extract(t, "(?s)^(.*?。)", 1)
    en = F.regexp_extract(t, r"(?s)^(..*?[.!?])(?:\s|\z)", 1)
    return F.when(zh != "", zh).when(en != "", en).otherwise(F.substring(t, 1, 80))


def path_levels(path: Column) -> Column:
    """/a/b/c to [/a, /a/b, /a/b/c]; [] for null or empty, ["/"] for the root."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", ""), "/"), lambda p: p != "")
    levels = F.transform(parts, lambda p, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(F.coalesce(path, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(levels)


def level_weight(index: Column, total: Column) -> Column:
    """0.8 to the number of levels below (index from 0)."""
    return F.pow(F.lit(0.8), (total - index - 1).cast("double"))


def scopes_of(param: Column) -> Column:
    """Comma list to trimmed non-empty names."""
    return F.filter(F.transform(F.split(F.coalesce(param, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def escape_like(s: str) -> str:
    """Escape for LIKE ... ESCAPE '\\'."""
    return s.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")


def escape_query(q: str) -> str:
    """A full-text query in which operators and special characters have lost their meaning."""
    q = q.strip()
    if not q:
        return '""'
    special = q.upper() in ("AND", "OR", "NOT") or any(c in q for c in '+-"*()') or any(f" {op} " in q for op in ("AND", "OR", "NOT"))
    return '"' + q.replace('"', '""') + '"' if special else q


def is_phrase(q: Column) -> Column:
    """Whether escape_query makes one phrase of the query."""
    t = F.trim(F.coalesce(q, F.lit("")))
    return F.upper(t).isin("AND", "OR", "NOT") | t.rlike(r'[+\-"*()]| (?:AND|OR|NOT) ')
