"""Full-text search for batches of queries: postings, BM25, phrases.

A query is the set of its words, of which all or (match="any") at least one has to occur; a query
with operators or special characters is one phrase (``search_text``). Statistics are those of the
whole corpus; filters come after. Only postings of words that some query asks for are
shuffled: the words of the queries are joined to the text side first.

Null and empty texts hold no words and no document; empty queries find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions.text import is_phrase
from sievelake.functions.words import words

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Words of a run that a phrase is looked up by.
GRAM = 5


def term_table(docs: DataFrame) -> DataFrame:
    """(id, dl, term, pos) of docs (id, text)."""
    w = docs.select("id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return w.select("id", F.size("w").alias("dl"), F.posexplode("w").alias("pos", "term"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf) over the whole corpus."""
    return term_table(docs).groupBy("id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    dl = F.size(words(F.col("text")))
    return docs.select(dl.alias("dl")).filter("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms) of queries (query_id, query)."""
    q = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("w")).filter(F.size("w") > 0)
    return q.select("query_id", F.size("w").alias("n_terms"), F.explode("w").alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(FLOOR))


def part_score(size: DataFrame, weight: Column) -> Column:
    """A term's share of a score, from its weight and the columns tf and dl."""
    return weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / size.select("avgdl").scalar()))


def scored(tf: DataFrame, terms: DataFrame, size: DataFrame, match: str) -> DataFrame:
    """(query_id, id, score) from postings tf (id, dl, term, tf) and query_terms."""
    if match not in ("all", "any"):
        raise ValueError(f"unknown match: {match}")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").select("query_id", "n_terms", "term", idf(size.select("n").scalar(), F.col("df")).alias("idf"))
    hits = tf.join(weights, "term").groupBy("query_id", "id", "n_terms").agg(F.sum(part_score(size, F.col("idf"))).alias("score"), F.count("*").alias("hit"))
    return (hits if match == "any" else hits.filter("hit = n_terms")).select("query_id", "id", F.greatest("score", F.lit(0.0)).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, match: str = "all") -> DataFrame:
    """(query_id, id, score) of every document that holds all words of a query (or any of them); score is not negative."""
    qt = query_terms(queries)
    asked = qt.select("term").distinct()
    held = docs.select("id", words(F.col("text")).alias("w"))
    tf = (
        held.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked, "term", "left_semi")
        .groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    )
    return scored(tf, qt, corpus_size(docs), match)


def phrase_bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) with each query as one phrase, whose occurrences count like a word's."""
    hits = _phrases(docs, queries).withColumnRenamed("starts", "tf")
    df = hits.groupBy("query_id").agg(F.count("*").alias("df"))
    size = corpus_size(docs)
    score = part_score(size, idf(size.select("n").scalar(), F.col("df")))
    return hits.join(df, "query_id").select("query_id", "id", F.greatest(score, F.lit(0.0)).alias("score"))


def search_text(docs: DataFrame, queries: DataFrame, match: str = "all") -> DataFrame:
    """(query_id, id, score): queries with operators or special characters as phrases, the others by their words."""
    special = is_phrase(F.col("query"))
    return bm25(docs, queries.filter(~special), match).unionByName(phrase_bm25(docs, queries.filter(special)))


def phrase_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, starts): how often the query's words follow one another in a document."""
    return _phrases(docs, queries).select("query_id", "id", "starts")


def _phrases(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, dl, starts). A phrase is looked up by runs of GRAM words that together cover it, never by its single words, which may be in any text."""
    q = queries.select("query_id", words(F.col("query")).alias("w")).filter(F.size("w") > 0).select("query_id", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(GRAM)).alias("g"))
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - F.col("g"), F.lit(GRAM)), F.array(F.col("n") - F.col("g"))))
    q = q.withColumn("offsets", at).select("query_id", "w", "g", F.size("offsets").alias("m"), F.explode("offsets").alias("at"))
    qp = q.select("query_id", "m", "at", F.array_join(F.slice("w", F.col("at") + 1, F.col("g")), " ").alias("gram"))
    sizes = sorted(r["g"] for r in q.select("g").distinct().collect())  # at most GRAM numbers
    w = docs.select("id", words(F.col("text")).alias("w")).select("id", "w", F.size("w").alias("dl"))
    none = F.array().cast("array<struct<pos:int,gram:string>>")

    def grams(g: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.col("dl") - g), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i + 1, g), " ").alias("gram")))
        return F.when(F.col("dl") >= g, runs).otherwise(none)

    t = w.select("id", "dl", F.explode(F.concat(none, *[grams(g) for g in sizes])).alias("x")).select("id", "dl", "x.pos", "x.gram")
    hits = t.join(qp, "gram").groupBy("query_id", "m", "id", "dl", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("met")).filter("met = m")
    return hits.groupBy("query_id", "id", "dl").agg(F.count("*").alias("starts"))


def top_k(scores: DataFrame, k: int, by: str = "query_id", digits: int = 6) -> DataFrame:
    """The k best rows of each query with their rank (from 1); ties by id. Scores are rounded before they are ranked."""
    s = scores.withColumn("score", F.round("score", digits))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
