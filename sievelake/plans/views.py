"""The tables as the search queries see them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.vectors import usable
from sievelake.functions.words import words
from sievelake.session import cut
from sievelake.sources.tables import memories, table

NOW, DIM, K = 1706745600, 128, 10


def docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Memories once each, empty strings in paths and links null."""
    m = memories(spark, sf, *cols)
    for c in ("hierarchy_path", "parent_id", "source_file"):
        if c in cols:
            m = m.withColumn(c, F.nullif(c, F.lit("")))
    return m


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Usable vectors (id, vector), each id once."""
    v = table(spark, sf, "vectors").select(F.col("memory_id").alias("id"), "vector").filter(usable(F.col("vector"), DIM))
    return v.dropDuplicates(["id"])


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Eval cases with their query as it stands."""
    return table(spark, sf, "eval_cases").withColumnRenamed("item_id", "query_id")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, id): of each case, the first memory with a vector that holds its first expected term as a word; written, being asked for several times."""
    asked = table(spark, sf, "eval_cases").select(F.col("item_id").alias("query_id"), F.lower(F.try_element_at("expected_terms", F.lit(1))).alias("term"))
    held = docs(spark, sf, "text").select("id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(asked, "term")
    return cut(held.join(vectors(spark, sf).select("id"), "id").groupBy("query_id").agg(F.min("id").alias("id")))


def example_vectors(spark: SparkSession, sf: str, ex: DataFrame | None = None) -> DataFrame:
    """(query_id, vector) of the examples."""
    return cut((ex or examples(spark, sf)).join(vectors(spark, sf), "id").select("query_id", "vector"))


def located(spark: SparkSession, sf: str, ex: DataFrame | None = None) -> DataFrame:
    """(query_id, query, path): cases asked from where their example lies; without one, from their own path."""
    at = (ex or examples(spark, sf)).join(docs(spark, sf, "hierarchy_path"), "id").select("query_id", "hierarchy_path")
    return cut(cases(spark, sf).join(at, "query_id", "left").select("query_id", "query", F.coalesce("hierarchy_path", "path").alias("path")))


WORDS = r"regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '([一-鿿])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
SEC = "CASE WHEN {0} = 0 THEN NULL WHEN abs({0}) >= 100000000000 THEN CAST(floor({0} / 1000) AS BIGINT) ELSE {0} END"
_BM25 = "greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
#: Where "bm" takes documents that hold any word of a query; ``whole`` asks for all.
ANY, ALL = " /* any */", " HAVING count(*) = qt.n_terms"
#: Named subqueries; each names those it needs.
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "mem": ((), "SELECT id, min(text) AS text, min(abstract) AS abstract, min(overview) AS overview, min(category) AS category, min(scope) AS scope, min(importance) AS importance, "
            f"min({SEC.format('timestamp')}) AS ts, min(nullif(hierarchy_path, '')) AS hierarchy_path, min(nullif(parent_id, '')) AS parent_id, min(nullif(source_file, '')) AS source_file, min(chunk_index) AS chunk_index, min(node_type) AS node_type, min(metadata) AS metadata FROM memories GROUP BY id"),
    "vec": ((), "SELECT memory_id AS id, any_value(vector::DOUBLE[]) AS v FROM vectors WHERE len(vector) = 128 AND len([x FOR x IN vector IF NOT isfinite(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0 GROUP BY memory_id"),
    "w": (("mem",), f"SELECT id, {WORDS.format('text')} AS w FROM mem"),
    "dl": (("w",), "SELECT id, len(w) AS dl FROM w WHERE len(w) > 0"),
    "sz": (("dl",), "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl"),
    "qt": ((), f"SELECT query_id, len(q) AS n_terms, unnest(q) AS term FROM (SELECT item_id AS query_id, list_distinct({WORDS.format('query')}) AS q FROM eval_cases)"),
    "tf": (("w", "qt"), "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL"),
    "df": (("tf",), "SELECT term, count(*) AS df FROM tf GROUP BY term"),
    "bm": (("qt", "tf", "df", "dl", "sz"), f"SELECT qt.query_id, tf.id, sum({_BM25}) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), sz GROUP BY qt.query_id, tf.id, qt.n_terms{ANY}"),
    "ex": (("w", "vec"), "SELECT query_id, min(t.id) AS id FROM (SELECT item_id AS query_id, lower(expected_terms[1]) AS term FROM eval_cases) JOIN (SELECT DISTINCT id, unnest(w) AS term FROM w) t USING (term) JOIN vec ON vec.id = t.id GROUP BY query_id"),
    "qv": (("ex", "vec"), "SELECT query_id, v FROM ex JOIN vec USING (id)"),
    "qp": (("ex", "mem"), "SELECT item_id AS query_id, coalesce(hierarchy_path, path) AS path FROM eval_cases LEFT JOIN ex ON ex.query_id = item_id LEFT JOIN mem ON mem.id = ex.id"),
    "vs": (("qv", "vec", "mem"), "SELECT query_id, vec.id, list_cosine_similarity(qv.v, vec.v) AS score FROM qv, vec JOIN mem ON mem.id = vec.id"),
    "lv": (("qp",), "SELECT query_id, '/' || array_to_string(p[1:i], '/') AS level, pow(0.8e0, len(p) - i) AS weight FROM (SELECT query_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT query_id, [x FOR x IN string_split(path, '/') IF x <> ''] AS p FROM qp WHERE path <> ''))"),
    "lvec": (("lv", "vs", "mem"), "SELECT * FROM (SELECT vs.query_id, level, weight, vs.id, round(vs.score, 6) AS score, row_number() OVER (PARTITION BY vs.query_id, level ORDER BY round(vs.score, 6) DESC, vs.id) AS rank FROM vs JOIN lv USING (query_id) JOIN mem ON mem.id = vs.id WHERE hierarchy_path = level OR starts_with(hierarchy_path, level || '/')) WHERE rank <= 20"),
    "lbm": (("lv", "bm", "mem"), "SELECT * FROM (SELECT bm.query_id, level, weight, bm.id, round(bm.score, 6) AS score, row_number() OVER (PARTITION BY bm.query_id, level ORDER BY round(bm.score, 6) DESC, bm.id) AS rank FROM bm JOIN lv USING (query_id) JOIN mem ON mem.id = bm.id WHERE hierarchy_path = level OR starts_with(hierarchy_path, level || '/')) WHERE rank <= 20"),
    "lrrf": (("lvec", "lbm"), "SELECT query_id, level, weight, id, sum(1e0 / (60 + rank)) AS score FROM (SELECT query_id, level, weight, id, rank FROM lvec UNION ALL SELECT query_id, level, weight, id, rank FROM lbm) GROUP BY ALL"),
}


def sql(body: str, *names: str) -> str:
    """body under a WITH clause of the named subqueries and all they need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for x in CTE[name][0]:
                need(x)
            order.append(name)

    for n in names:
        need(n)
    head = "WITH " + ", ".join(f"{n} AS ({CTE[n][1]})" for n in order) if order else ""
    return head + (body if body.startswith(",") else f" {body}")  # a body that begins with a comma has further subqueries


def whole(statement: str) -> str:
    """The statement with documents that hold all words of a query instead of any."""
    return statement.replace(ANY, ALL)


def top(source: str, k: int = K, by: str = "query_id") -> str:
    """SELECT of the k best rows of each query of a subquery (query_id, id, score)."""
    return f"SELECT * FROM (SELECT {by}, id, round(score, 6) AS score, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, id) AS rank FROM {source}) WHERE rank <= {k}"
