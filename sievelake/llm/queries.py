"""Registered queries of the training-text problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import curves, leakage, lookalike, mixture, neardup, spam_pages
from sievelake.sources.tables import table

FIELDS = ["text", "abstract"]
DIM, K, LEAST_COSINE = 128, 10, 0.85
FOUND_JACCARD = 0.70


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, sf, "memories"), "id", FIELDS)


def p1_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every memory's values, each as the canonical member of its class."""
    return lookalike.canonical_values(table(spark, sf, "memories"), "id", FIELDS)


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of several spellings, with their canonical member and the memories that hold one."""
    return lookalike.class_counts(table(spark, sf, "memories"), "id", FIELDS)


def _with_file(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "memories").select("id", "text", "source_file").filter(F.col("source_file") != "")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_with_file(spark, sf), "id", "text", FOUND_JACCARD)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_groups(_with_file(spark, sf), "id", "text", FOUND_JACCARD)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return curves.similar_pairs(table(spark, sf, "vectors"), "memory_id", "vector", DIM, K, LEAST_COSINE).select(F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return curves.nearest(table(spark, sf, "vectors"), "memory_id", "vector", DIM, K, whole=True).select("id", "neighbour", F.round("score", 3).alias("score"), "rank")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_cases")).filter(F.col("same_words") >= leakage.WINDOW).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of words and whole passages with small edits."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_cases"), whole=True).select("doc_id", "item_id", "windows", F.round("similarity", 6).alias("similarity"))


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items and the documents that hold them, counted."""
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_cases"), whole=True).groupBy("item_id").agg(F.count("*").alias("documents"), F.sum("windows").alias("windows"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.rates(mixture.token_table(table(spark, sf, "documents")), table(spark, sf, "mix_targets")).filter("NOT reachable").select("source")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    tokens = mixture.token_table(table(spark, sf, "documents"))
    return mixture.mixture(tokens, mixture.rates(tokens, table(spark, sf, "mix_targets")))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.reached_shares(mixture.token_table(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages.stuffed_pages(table(spark, sf, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return spam_pages.scored_pages(table(spark, sf, "documents")).select("doc_id", "chars", "stuffed_chars", F.round("stuffed_share", 6).alias("stuffed_share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_canonical, p1_classes, p2_found, p2_groups, p3_found, p3_neighbours, p6_found, p6_leaks, p6_items, p7_found, p7_mixture, p7_shares, p8_found, p8_shares)}

#: Words in DuckDB: ideographs are set apart first, because RE2 has no class subtraction.
_WORDS = r"regexp_extract_all(regexp_replace(lower({0}), '([一-鿿])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def _form(col: str) -> str:
    """The look-alike form in SQL for the characters of the tables: drop, translate, compose."""
    single = {k: v for k, v in lookalike.TABLE.items() if len(v) == 1}
    several = {k: v for k, v in lookalike.TABLE.items() if len(v) > 1 and ord(k) < 0xFFFF}
    spaces = "".join(chr(c) for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
    quote = lambda s: s.replace("'", "''")
    e = rf"regexp_replace({col}, '([\x{{1F000}}-\x{{1FAFF}}])\x{{200D}}([\x{{1F000}}-\x{{1FAFF}}])', '\1{lookalike.JOINER}\2', 'g')"
    e = rf"regexp_replace({e}, '[\x{{AD}}\x{{34F}}\x{{61C}}\x{{115F}}\x{{1160}}\x{{180B}}-\x{{180F}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{3164}}\x{{FE00}}-\x{{FE0F}}\x{{FEFF}}\x{{FFA0}}]', '', 'g')"
    e = f"translate({e}, '{quote(''.join(single) + spaces)}', '{quote(''.join(single.values()) + ' ' * len(spaces))}')"
    for k, v in several.items():
        if k in "ﬀﬁﬂﬃﬄ":
            e = f"replace({e}, '{k}', '{v}')"
    return f"nfc_normalize({e})"


def sql() -> dict[str, str]:
    form_rows = " UNION ".join(f"SELECT id, '{f}' AS field, {f} AS value, {_form(f)} AS form FROM memories WHERE {f} <> ''" for f in FIELDS)
    leak_rows = (
        f"WITH w AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM eval_cases), "
        "iw AS (SELECT DISTINCT item_id, list_aggregate(w[i:i + 15], 'string_agg', ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS i FROM w WHERE len(w) >= 16)), "
        f"d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), "
        "dw AS (SELECT doc_id, list_aggregate(w[i:i + 15], 'string_agg', ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 14)) AS i FROM d WHERE len(w) >= 16)) "
        "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k)"
    )
    return {
        "p1_found": f"WITH v AS ({form_rows}) SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.field = b.field AND a.form = b.form WHERE a.id < b.id AND a.value <> b.value",
        "p1_canonical": f"WITH v AS ({form_rows}), c AS (SELECT field, form, min_by(value, (CASE WHEN value <> form THEN '1' ELSE '0' END) || md5(value)) AS canonical FROM v GROUP BY ALL) SELECT DISTINCT id, field, canonical FROM v JOIN c USING (field, form)",
        "p1_classes": f"WITH v AS ({form_rows}) SELECT field, min_by(value, (CASE WHEN value <> form THEN '1' ELSE '0' END) || md5(value)) AS canonical, count(DISTINCT value) AS spellings, count(DISTINCT id) AS ids FROM v GROUP BY field, form HAVING count(DISTINCT value) > 1",
        "p2_found": (
            f"WITH m AS (SELECT id, any_value(text) AS text FROM memories WHERE source_file <> '' GROUP BY id), "
            f"s AS (SELECT id, list_distinct({_WORDS.format('text')}) AS w FROM m), "
            "t AS (SELECT id, len(w) AS n, unnest(w) AS word FROM s), "
            "c AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.word = b.word AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL) "
            "SELECT id_a, id_b FROM c WHERE 10 * common >= 7 * (na + nb - common)"
        ),
        "p2_groups": (
            f"WITH RECURSIVE m AS (SELECT id, any_value(text) AS text FROM memories WHERE source_file <> '' AND id IS NOT NULL GROUP BY id), "
            f"s AS (SELECT id, list_sort(list_distinct({_WORDS.format('text')})) AS w FROM m), k AS (SELECT w, min(id) AS rep FROM s WHERE len(w) > 0 GROUP BY w), "
            "t AS (SELECT rep, len(w) AS n, unnest(w) AS word FROM k), "
            "c AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.word = b.word AND a.rep <> b.rep AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9 GROUP BY ALL), "
            "e AS (SELECT a, b FROM c WHERE 10 * common >= 7 * (na + nb - common)), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), "
            "g AS (SELECT a AS rep, min(b) AS low FROM reach GROUP BY a), d AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY a) "
            "SELECT s.id, least(k.rep, coalesce(low, k.rep)) AS group_id, coalesce(links, 0) AS links FROM s JOIN k USING (w) LEFT JOIN g ON g.rep = k.rep LEFT JOIN d ON d.rep = k.rep"
        ),
        "p3_found": (
            "WITH v AS (SELECT memory_id, any_value(vector::DOUBLE[128]) AS v FROM vectors WHERE len(vector) = 128 AND len([x FOR x IN vector IF NOT isfinite(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0 GROUP BY memory_id), "
            "s AS (SELECT a.memory_id AS a, b.memory_id AS b, array_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.memory_id <> b.memory_id), "
            "r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM s) "
            "SELECT DISTINCT least(a, b) AS memory_id_a, greatest(a, b) AS memory_id_b FROM r WHERE rn <= 10 AND c >= 0.85"
        ),
        # at this size every window holds all vectors
        "p3_neighbours": (
            "WITH v AS (SELECT memory_id, any_value(vector::DOUBLE[128]) AS v FROM vectors WHERE len(vector) = 128 AND len([x FOR x IN vector IF NOT isfinite(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0 GROUP BY memory_id), "
            "s AS (SELECT a.memory_id AS a, b.memory_id AS b, array_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.memory_id <> b.memory_id) "
            "SELECT a AS id, b AS neighbour, round(c, 3) AS score, rank FROM (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS rank FROM s) WHERE rank <= 10"
        ),
        "p6_found": leak_rows,
        # any usual tokenizer gives the same list: here ideographs, words, numbers and marks count as tokens
        "p7_found": (
            r"WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[一-鿿]|[A-Za-zÀ-ɏ]+|\p{N}+|[^\s\p{L}\p{N}]')) AS n FROM documents WHERE source IS NOT NULL), "
            "s AS (SELECT m.source, target_share, max_repeats, coalesce(sum(n), 0) AS n FROM mix_targets m LEFT JOIN d USING (source) GROUP BY ALL) "
            "SELECT source FROM s WHERE max_repeats * n < target_share * (SELECT sum(n) FROM s)"
        ),
    }
