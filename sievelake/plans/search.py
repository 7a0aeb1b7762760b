"""Registered search queries: vectors, full text, fusion, scoring, paths, trees, reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import scoring, text as tx, vectors as vx
from sievelake.operators import evaluation, fulltext, fusion, path_search as ps, quality, rerank as rr, retrieval, tree_search as ts, vector_search as vs
from sievelake.operators.posting_index import PostingIndex
from sievelake.plans.views import DIM, K, NOW, WORDS, cases, docs, example_vectors, examples, located, sql, top, vectors, whole
from sievelake.session import cut, shared_dir
from sievelake.sources.files import Settings
from sievelake.sources.tables import table

SCOPES = ["global", "agent:scout"]
QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _rows(spark, sf, *cols):
    """Vectors of memories that exist, with columns of the memory."""
    return vectors(spark, sf).join(docs(spark, sf, *cols), "id")


@query(sql(top("vs"), "vs"))
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vs.vector_topk(example_vectors(spark, sf), _rows(spark, sf), DIM, K)


@query(sql(top("(SELECT vs.* FROM vs JOIN mem USING (id) WHERE scope IN ('global', 'agent:scout'))"), "vs", "mem"))
def vector_topk_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return vs.vector_topk(example_vectors(spark, sf), _rows(spark, sf, "scope").filter(F.col("scope").isin(SCOPES)), DIM, K)


@query(sql("SELECT * FROM (SELECT query_id, level, id, score, rank FROM lvec) WHERE rank <= 10", "lvec"))
def level_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    ex = examples(spark, sf)
    q = cut(located(spark, sf, ex).join(example_vectors(spark, sf, ex), "query_id"))
    d = docs(spark, sf, "hierarchy_path")
    return ps.level_vector_hits(q, d, vectors(spark, sf), DIM, K).select("query_id", "level", "id", "score", "rank")


@query(sql(top("(SELECT vs.* FROM vs JOIN mem USING (id) WHERE hierarchy_path IS NULL)"), "vs", "mem"))
def global_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vs.vector_topk(example_vectors(spark, sf), _rows(spark, sf, "hierarchy_path").filter("hierarchy_path IS NULL"), DIM, K)


@query(sql("SELECT id, round(v[1] / n, 6) AS first, round(sqrt(list_sum([(x / n) * (x / n) FOR x IN v])), 6) AS length FROM (SELECT id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM vec)", "vec"))
def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    u = vectors(spark, sf).select("id", vx.normalize(F.col("vector")).alias("u"))
    return u.select("id", F.round(F.col("u")[0], 6).alias("first"), F.round(vx.norm(F.col("u")), 6).alias("length"))


@query("SELECT memory_id, dimension, len(vector) AS numbers, coalesce(len(vector) = 128 AND len([x FOR x IN vector IF NOT isfinite(x)]) = 0 AND len([x FOR x IN vector IF x <> 0]) > 0, false) AS usable FROM vectors")
def vector_state(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors")
    return v.select("memory_id", "dimension", F.when(F.col("vector").isNotNull(), F.size("vector").cast("bigint")).alias("numbers"), vx.usable(F.col("vector"), DIM).alias("usable"))


@query("SELECT memory_id, len(vector) * 4 AS bytes, true AS same FROM vectors WHERE vector IS NOT NULL")
def vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors").filter("vector IS NOT NULL").select("memory_id", "vector", vx.to_bytes("vector").alias("b"))
    back = v.select("memory_id", F.length("b").cast("bigint").alias("bytes"), "vector", vx.from_bytes("b").alias("back"))
    equal = F.forall(F.arrays_zip("vector", "back"), lambda x: x["vector"].eqNullSafe(x["back"]))
    return back.select("memory_id", "bytes", equal.alias("same"))


@query(sql("SELECT mem.id, parent_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM mem JOIN vec a ON a.id = mem.id JOIN vec b ON b.id = mem.parent_id", "mem", "vec"))
def cosine_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    """Of each child, its vector's cosine with its parent's."""
    v = vectors(spark, sf)
    d = docs(spark, sf, "parent_id").filter("parent_id IS NOT NULL")
    up = v.select(F.col("id").alias("parent_id"), F.col("vector").alias("pv"))
    return d.join(v, "id").join(up, "parent_id").select("id", "parent_id", F.round(vx.cosine(F.col("vector"), F.col("pv")), 6).alias("cosine"))


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return e, e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


_EMB = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), es AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.id % 50 = 0 AND q.id <> e.id)"


@query(f"WITH {_EMB}, r AS ({top('es', 1)}) SELECT r.query_id, r.id, r.score, a.label = b.label AS same_label FROM r JOIN e a ON a.id = r.query_id JOIN e b ON b.id = r.id")
def knn_join_top1(spark: SparkSession, sf: str) -> DataFrame:
    rows, q = _embeddings(spark, sf)
    best = vs.vector_topk(q, rows, 64, 1, exclude_self=True)
    a, b = rows.select(F.col("id").alias("query_id"), F.col("label").alias("la")), rows.select("id", F.col("label").alias("lb"))
    return best.join(a, "query_id").join(b, "id").select("query_id", "id", "score", (F.col("la") == F.col("lb")).alias("same_label"))


@query(f"WITH {_EMB} {top('es', 10)}")
def knn_join_top10(spark: SparkSession, sf: str) -> DataFrame:
    rows, q = _embeddings(spark, sf)
    return vs.vector_topk(q, rows, 64, 10, exclude_self=True)


@query()
def ivf_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate: recall against knn_join_top10 is tested to be at least 0.9."""
    rows, q = _embeddings(spark, sf)
    return vs.ivf_topk(q, rows, 64, 10, cells=16, probes=12)


@query(f"WITH {_EMB} SELECT query_id, id, round(score, 6) AS score FROM es WHERE score > 0.98")
def near_dup_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows within a cosine of 0.98 of the stated query rows."""
    rows, q = _embeddings(spark, sf)
    return vs.vector_scores(q, rows, 64, 0, exclude_self=True, least=0.98).filter("score > 0.98").select("query_id", "id", F.round("score", 6).alias("score"))


def _text(spark, sf):
    return fulltext.bm25(docs(spark, sf, "text"), cases(spark, sf), "any")


@query(sql(top("bm"), "bm"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.top_k(_text(spark, sf), K)


@query(whole(sql(top("bm"), "bm")))
def bm25_topk_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Memories that hold all words of a case's query; few cases have hits."""
    return fulltext.top_k(fulltext.bm25(docs(spark, sf, "text"), cases(spark, sf)), K)


@query(sql(top("bm"), "bm"))
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stored index: built in two batches, the first of which holds some documents in an older wording."""
    index = PostingIndex(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}")
    d = docs(spark, sf, "text")
    index.add(d.filter("pmod(xxhash64(id), 10) = 0").withColumn("text", F.lower("text")), 1)
    index.put(d, 2)
    return fulltext.top_k(index.search(cases(spark, sf), "any"), K)


@query(sql("SELECT query_id, id, round(score, 6) AS score FROM bm", "bm"))
def bm25_all_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _text(spark, sf).withColumn("score", F.round("score", 6))


@query(sql(top("(SELECT bm.* FROM bm JOIN mem USING (id) WHERE scope IN ('global', 'agent:scout'))"), "bm", "mem"))
def bm25_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.top_k(_text(spark, sf).join(docs(spark, sf, "scope").filter(F.col("scope").isin(SCOPES)).select("id"), "id"), K)


@query(sql("SELECT query_id, level, id, score, rank FROM lbm WHERE rank <= 10", "lbm"))
def bm25_level(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf, "hierarchy_path")
    return ps.level_hits(_text(spark, sf), d, located(spark, sf), K).select("query_id", "level", "id", "score", "rank")


@query(sql(top("(SELECT bm.* FROM bm JOIN mem USING (id) WHERE hierarchy_path IS NULL)"), "bm", "mem"))
def bm25_global(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.top_k(_text(spark, sf).join(docs(spark, sf, "hierarchy_path").filter("hierarchy_path IS NULL").select("id"), "id"), K)


RUN = 5


def _runs_sql(col: str, n: int) -> str:
    runs = f"SELECT item_id || '#' || s AS query_id, array_to_string(w[s:s + {n - 1}], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n - 1}, 1) + 1)) AS s FROM (SELECT item_id, {WORDS.format(col)} AS w FROM eval_cases))"
    return f", p AS ({runs}), g AS (SELECT id, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)), h AS (SELECT query_id, id FROM p JOIN g USING (k))"


def _runs(spark, sf, col: str, n: int) -> DataFrame:
    """(query_id, query): every run of n words of a case's column; query_id is item#place."""
    w = cases(spark, sf).select("query_id", fulltext.words(F.col(col)).alias("w"))
    at = w.select("query_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))).alias("s"))
    return at.select(F.concat_ws("#", "query_id", "s").alias("query_id"), F.array_join(F.slice("w", F.col("s"), n), " ").alias("query"))


@query(sql(_runs_sql("query", 2) + " SELECT query_id, id, count(*) AS starts FROM h GROUP BY ALL", "w"))
def bm25_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Memories that hold any two consecutive words of a case's query as a phrase; query_id is item#place."""
    return fulltext.phrase_hits(docs(spark, sf, "text"), _runs(spark, sf, "query", 2))


@query(sql(_runs_sql("passage", RUN) + " SELECT query_id, id, count(*) AS starts FROM h GROUP BY ALL", "w"))
def bm25_phrase_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Memories that hold any RUN consecutive words of an item's passage as a phrase; query_id is item#place."""
    return fulltext.phrase_hits(docs(spark, sf, "text"), _runs(spark, sf, "passage", RUN))


_BM_PHRASE = "greatest(ln((n - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))"


@query(sql(
    _runs_sql("query", 2) + ", f AS (SELECT query_id, id, count(*) AS tf FROM h GROUP BY ALL), fd AS (SELECT query_id, count(*) AS df FROM f GROUP BY query_id), "
    f"fs AS (SELECT query_id, id, {_BM_PHRASE} AS score FROM f JOIN fd USING (query_id) JOIN dl USING (id), sz), both_kinds AS (SELECT * FROM fs UNION ALL SELECT * FROM bm) {top('both_kinds')}", "w", "dl", "sz", "bm",
))
def text_search_escaped(spark: SparkSession, sf: str) -> DataFrame:
    """Queries as a client may send them: the cases' queries as they stand, and any two of their words in quotation marks, which make a phrase."""
    quoted = _runs(spark, sf, "query", 2).withColumn("query", F.concat(F.lit('"'), "query", F.lit('"')))
    return fulltext.top_k(fulltext.search_text(docs(spark, sf, "text"), cases(spark, sf).select("query_id", "query").unionByName(quoted), "any"), K)


@query(sql("SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY term", "w"))
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.term_stats(docs(spark, sf, "text"))


@query(sql("SELECT n, round(avgdl, 6) AS avgdl FROM sz", "sz"))
def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.corpus_size(docs(spark, sf, "text")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(sql("SELECT query_id, id, rank, hits FROM (SELECT bm.query_id, bm.id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS hits FROM bm) JOIN ex USING (query_id, id)", "bm", "ex"))
def rank_of_example(spark: SparkSession, sf: str) -> DataFrame:
    """At which place of its text hits a case's example stands."""
    hits, ex = cut(_text(spark, sf).withColumn("score", F.round("score", 6))), examples(spark, sf)
    own = hits.join(ex, ["query_id", "id"]).select("query_id", F.col("id").alias("own_id"), F.col("score").alias("own"))
    # counted, not ranked: no list is brought together for it
    before = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("id") <= F.col("own_id")))
    return hits.join(own, "query_id").groupBy("query_id", F.col("own_id").alias("id")).agg(F.count(F.when(before, 1)).alias("rank"), F.count("*").alias("hits"))


_STATED = "('0x' || substr(md5(a.id), 1, 8))::UBIGINT % 50 = 0"


@query(sql(f"SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM vec a JOIN vec b ON a.id <> b.id AND {_STATED} WHERE list_cosine_similarity(a.v, b.v) > 0.98", "vec"))
def near_dup_memories(spark: SparkSession, sf: str) -> DataFrame:
    """Memories within a cosine of 0.98 of the stated query rows, those whose digest is divisible by 50: what a store would refuse as near-duplicates."""
    v = vectors(spark, sf)
    q = v.filter(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 50 == 0).withColumnRenamed("id", "query_id")
    return vs.vector_scores(q, v, DIM, 0, exclude_self=True, least=0.98).filter("score > 0.98").select("query_id", "id", F.round("score", 6).alias("score"))


@query(sql("SELECT id, round(u[1] / n, 6) AS first, round(u[128] / n, 6) AS last FROM (SELECT id, u, sqrt(list_sum([x * x FOR x IN u])) AS n FROM (SELECT id, [(round((x / m) * 127) + 128 - 128) / 128e0 FOR x IN v] AS u FROM (SELECT id, v, list_max([abs(x) FOR x IN v]) AS m FROM vec)))", "vec"))
def vector_dequantize(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to unsigned bytes, scaled by their largest number, and back to unit length."""
    scaled = cut(vectors(spark, sf).select("id", "vector", F.array_max(F.transform(vx.doubles(F.col("vector")), lambda x: F.abs(x))).alias("m")))
    u8 = F.transform(vx.doubles(F.col("vector")), lambda x: (F.round(x / F.col("m") * 127) + 128).cast("int"))
    back = cut(scaled.select("id", u8.alias("u8"))).select("id", vx.dequantize(F.col("u8")).alias("u"))
    return back.select("id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 128), 6).alias("last"))


@query(sql(f", c AS ({top('(SELECT query_id, id, round(score, 5) AS score FROM bm)', 50)}), x AS (SELECT c.query_id, c.id, 0.7e0 * c.score + 0.3e0 * coalesce(vs.score, 0) AS score FROM c LEFT JOIN vs ON vs.query_id = c.query_id AND vs.id = c.id) {top('x')}", "bm", "vs"))
def rerank_by_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Text hits reranked by the cosine of their vectors with the case's, where no reranker is to be had; a missing vector counts as 0."""
    cand = fulltext.top_k(_text(spark, sf).withColumn("score", F.round("score", 5)), rr.CANDIDATES)
    with_q = cand.join(example_vectors(spark, sf).withColumnRenamed("vector", "qv"), "query_id", "left").join(vectors(spark, sf), "id", "left")
    cos = F.coalesce(vx.cosine(F.col("qv"), F.col("vector")), F.lit(0.0))
    return fulltext.top_k(with_q.select("query_id", "id", rr.cosine_fallback(F.col("score"), cos).alias("score")), K)


def _lists(spark, sf):
    return vs.vector_topk(example_vectors(spark, sf), _rows(spark, sf), DIM, 2 * K), fulltext.top_k(_text(spark, sf), 2 * K)


@query(sql(f", a AS ({top('vs', 20)}), b AS ({top('bm', 20)}), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.score WHEN b.id IS NOT NULL THEN least(a.score + 0.15e0 * a.score, 1e0) ELSE a.score END AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id) {top('f')}", "vs", "bm"))
def hybrid_boost(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.boost_fusion(*_lists(spark, sf), K)


@query(sql(f"SELECT * FROM ({top('bm')}) WHERE query_id NOT IN (SELECT query_id FROM qv)", "bm", "qv"))
def hybrid_bm25_only(spark: SparkSession, sf: str) -> DataFrame:
    """Cases without a query vector: the full-text list is the answer."""
    return fulltext.top_k(_text(spark, sf).join(example_vectors(spark, sf).select("query_id"), "query_id", "left_anti"), K)


@query(sql(f", a AS ({top('vs', 20)}), b AS ({top('bm', 20)}), f AS (SELECT query_id, id, sum(1e0 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) {top('f')}", "vs", "bm"))
def rrf_two_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.top_k(fusion.rrf(list(_lists(spark, sf)), ["query_id"]), K)


@query(sql("SELECT query_id, level, round(weight, 6) AS weight FROM lv", "lv"))
def path_levels(spark: SparkSession, sf: str) -> DataFrame:
    return ps.query_levels(located(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("SELECT id, level, row_number() OVER (PARTITION BY id ORDER BY length(level)) AS depth FROM (SELECT DISTINCT id, '/' || array_to_string(p[1:i], '/') AS level FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT id, [x FOR x IN string_split(min(hierarchy_path), '/') IF x <> ''] AS p FROM memories GROUP BY id HAVING min(hierarchy_path) <> '')))")
def memory_levels(spark: SparkSession, sf: str) -> DataFrame:
    lv = docs(spark, sf, "hierarchy_path").filter("hierarchy_path IS NOT NULL").select("id", F.posexplode(tx.path_levels(F.col("hierarchy_path"))).alias("i", "level"))
    return lv.select("id", "level", (F.col("i") + 1).cast("bigint").alias("depth"))


def _level_lists(spark, sf):
    ex = examples(spark, sf)
    d, q = docs(spark, sf, "hierarchy_path"), located(spark, sf, ex)
    qv = cut(q.join(example_vectors(spark, sf, ex), "query_id"))
    return [ps.level_vector_hits(qv, d, vectors(spark, sf), DIM, 2 * K), ps.level_hits(_text(spark, sf), d, q, 2 * K)]


@query(sql("SELECT query_id, id, round(max(score * weight), 6) AS score FROM lrrf GROUP BY ALL", "lrrf"))
def path_weighted(spark: SparkSession, sf: str) -> DataFrame:
    fused = fusion.rrf(_level_lists(spark, sf), ["query_id", "level", "weight"])
    return fused.groupBy("query_id", "id").agg(F.round(F.max(F.col("score") * F.col("weight")), 6).alias("score"))


_IMP = "(0.7e0 + 0.3e0 * CASE WHEN importance > 0 THEN importance ELSE 0.7e0 END)"
_LEN = "(CASE WHEN strlen(coalesce(text, '')) > 200 THEN 1e0 / (1 + log2(strlen(coalesce(text, '')) / 200e0)) ELSE 1e0 END)"
_REC = f"(exp(-(({NOW} - coalesce(ts, {NOW})) / 86400e0) / 14e0) * 0.1e0)"
_SCORED = f"least(score + {_REC}, 1e0) * {_IMP} * {_LEN}"
_PATH = (
    ", best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(max(score * weight), 9) AS score FROM lrrf GROUP BY ALL)), "
    "b10 AS (SELECT * FROM best WHERE rank <= 10), found AS (SELECT query_id, count(*) AS n FROM b10 GROUP BY query_id), "
    "g AS (SELECT vs.query_id, vs.id, round(vs.score, 6) AS score FROM vs JOIN mem USING (id) WHERE hierarchy_path IS NULL UNION ALL SELECT bm.query_id, bm.id, round(bm.score, 6) FROM bm JOIN mem USING (id) WHERE hierarchy_path IS NULL AND query_id NOT IN (SELECT query_id FROM qv)), "
    "gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g), "
    "room AS (SELECT gr.* FROM gr LEFT JOIN found USING (query_id) WHERE rank <= 10 - coalesce(n, 0)), "
    "two AS (SELECT query_id, id, score, 'level' AS source FROM b10 UNION ALL SELECT query_id, id, score * 0.5e0, 'global' FROM room), "
    f"s AS (SELECT query_id, id, source, {_SCORED} AS score FROM two JOIN mem USING (id)), "
    "o AS (SELECT query_id, id, source, round(score, 6) AS score FROM s WHERE score >= 0.01) "
    "SELECT * FROM (SELECT query_id, id, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM o) WHERE rank <= 10"
)


@query(sql(_PATH, "lrrf", "vs", "bm", "qv", "mem"))
def path_search(spark: SparkSession, sf: str) -> DataFrame:
    ex = examples(spark, sf)
    q = cut(located(spark, sf, ex).join(example_vectors(spark, sf, ex), "query_id", "left"))
    return ps.path_search(q, docs(spark, sf, "text", "hierarchy_path", "importance", "ts"), vectors(spark, sf), DIM, K, NOW, match="any")


@query(sql(f"SELECT id, round({_REC}, 6) AS boost FROM mem", "mem"))
def score_recency(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "ts").select("id", F.round(scoring.recency_boost(F.col("ts"), NOW), 6).alias("boost"))


@query(sql(f"SELECT id, round({_IMP}, 6) AS weight FROM mem", "mem"))
def score_importance(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "importance").select("id", F.round(scoring.importance_weight(F.col("importance")), 6).alias("weight"))


@query(sql(f"SELECT id, round({_LEN}, 6) AS factor FROM mem", "mem"))
def score_length(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "text").select("id", F.round(scoring.length_factor(F.col("text"), 200), 6).alias("factor"))


@query(sql(f"SELECT query_id, id, round(s, 6) AS score FROM (SELECT query_id, id, {_SCORED} AS s FROM bm JOIN mem USING (id)) WHERE s >= 0.01", "bm", "mem"))
def score_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    r = scoring.apply_scoring(_text(spark, sf).join(docs(spark, sf, "text", "importance", "ts"), "id"), NOW)
    return r.select("query_id", "id", F.round("score", 6).alias("score"))


def _children(spark, sf):
    return docs(spark, sf, "parent_id").filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("parent"))


@query(sql(f", c AS (SELECT DISTINCT id, parent_id FROM mem WHERE parent_id IS NOT NULL), seed AS (SELECT DISTINCT query_id, id FROM ({top('bm')})), x AS (SELECT query_id, id, 0 AS depth FROM seed UNION SELECT x.query_id, c.id, x.depth + 1 FROM x JOIN c ON c.parent_id = x.id WHERE x.depth < 5) SELECT query_id, id, min(depth) AS depth FROM x GROUP BY ALL", "bm", "mem").replace("WITH ", "WITH RECURSIVE ", 1))
def tree_expand(spark: SparkSession, sf: str) -> DataFrame:
    seeds = cut(fulltext.top_k(_text(spark, sf), K).select("query_id", "id"))
    return ts.expand_tree(seeds, _children(spark, sf), 5).groupBy("query_id", "id").agg(F.min("depth").alias("depth"))


@query()
def tree_best_first(spark: SparkSession, sf: str) -> DataFrame:
    q = cut(example_vectors(spark, sf))
    seeds = cut(vs.vector_topk(q, _rows(spark, sf), DIM, 10))
    return ts.tree_scores(q, seeds, _children(spark, sf), vectors(spark, sf)).withColumn("score", F.round("score", 6))


@query()
def tree_search(spark: SparkSession, sf: str) -> DataFrame:
    q = cut(example_vectors(spark, sf))
    return ts.tree_search(q, docs(spark, sf, "source_file", "chunk_index", "abstract"), _children(spark, sf), vectors(spark, sf), DIM, K)


_AGG = (
    ", r AS (SELECT bm.query_id, bm.id, round(bm.score, 6) AS score, coalesce(chunk_index, 0) AS i, coalesce(abstract, '') AS a, coalesce(source_file, 'id:' || bm.id) AS grp FROM bm JOIN mem USING (id)), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, i, id) AS b, row_number() OVER (PARTITION BY query_id, grp ORDER BY i, id) AS nth, count(*) OVER (PARTITION BY query_id, grp) AS c FROM r) "
    "SELECT query_id, max(CASE WHEN b = 1 THEN id END) AS id, max(score) AS score, max(c) AS chunk_count, CASE WHEN max(c) > 1 THEN string_agg('[Part ' || (i + 1) || '] ' || a || chr(10), '' ORDER BY nth) FILTER (WHERE nth <= 3) || CASE WHEN max(c) > 3 THEN '... (+' || (max(c) - 3) || ' more chunks)' || chr(10) ELSE '' END ELSE max(a) END AS abstract FROM n GROUP BY query_id, grp"
)


@query(sql(_AGG, "bm", "mem"))
def aggregate_by_source(spark: SparkSession, sf: str) -> DataFrame:
    r = _text(spark, sf).withColumn("score", F.round("score", 6)).join(docs(spark, sf, "source_file", "chunk_index", "abstract"), "id")
    return ts.aggregate_by_source(r)


_RR = (
    f", c AS ({top('(SELECT query_id, id, round(score, 5) AS score FROM bm)', 50)}), q AS (SELECT item_id AS query_id, list_distinct({WORDS.format('query')}) AS qw FROM eval_cases), "
    f"x AS (SELECT c.query_id, c.id, c.score, trim(text) <> '' AS ok, len([t FOR t IN qw IF list_contains({WORDS.format('text')}, t)]) / nullif(len(qw), 0)::DOUBLE AS r FROM c JOIN mem USING (id) JOIN q USING (query_id)), "
    "b AS (SELECT query_id, id, CASE WHEN NOT ok THEN score WHEN r IS NULL THEN score * 0.8e0 ELSE greatest(0.6e0 * r + 0.4e0 * score, 0.5e0 * score) END AS score FROM x) "
)


@query(sql(_RR + top("b"), "bm", "mem"))
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    return rr.rerank(_text(spark, sf).withColumn("score", F.round("score", 5)), cases(spark, sf), docs(spark, sf, "text"))


@query(sql(
    f", near AS ({top('vs', 50)}), c AS (SELECT near.*, v FROM near JOIN vec USING (id)), sims AS (SELECT a.query_id, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM c a JOIN c b ON a.query_id = b.query_id), "
    "r AS (SELECT query_id, id, [id] AS took, 1 AS rank FROM c WHERE rank = 1 UNION ALL "
    "SELECT query_id, id, list_append(took, id), rank + 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(gain, 9) DESC, place) AS n FROM ("
    "SELECT r.query_id, r.took, r.rank, c.id, c.rank AS place, 0.7e0 * c.score - 0.3e0 * max(s.sim) AS gain FROM r JOIN c ON c.query_id = r.query_id AND NOT list_contains(r.took, c.id) JOIN sims s ON s.query_id = r.query_id AND s.a = c.id AND list_contains(r.took, s.b) "
    "WHERE r.rank < 10 GROUP BY r.query_id, r.took, r.rank, c.id, c.rank, c.score)) WHERE n = 1) SELECT query_id, id, rank FROM r", "vs", "vec",
).replace("WITH ", "WITH RECURSIVE ", 1))
def mmr(spark: SparkSession, sf: str) -> DataFrame:
    near = vs.vector_topk(example_vectors(spark, sf), _rows(spark, sf), DIM, 50)
    return quality.mmr(near.join(vectors(spark, sf), "id"), K)


def _asked(spark, sf):
    return cut(cases(spark, sf).select("query_id", "query").join(example_vectors(spark, sf), "query_id", "left"))


def _mode(spark, sf, mode):
    return retrieval.retrieve(_asked(spark, sf), docs(spark, sf, "text", "scope"), vectors(spark, sf), Settings(mode=mode, scopes=("global", "agent:scout")), match="any")


_ALLOWED = "(SELECT {0}.* FROM {0} JOIN mem USING (id) WHERE scope IN ('global', 'agent:scout'))"


@query(sql(top(_ALLOWED.format("bm")), "bm", "mem"))
def mode_text(spark: SparkSession, sf: str) -> DataFrame:
    return _mode(spark, sf, 1)


_FUSE = "f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN b.score WHEN b.id IS NOT NULL THEN least(a.score + 0.15e0 * a.score, 1e0) ELSE a.score END AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id)"


@query(sql(f", a AS ({top(_ALLOWED.format('vs'), 20)}), b AS ({top(_ALLOWED.format('bm'), 20)}), {_FUSE} {top('f')}", "vs", "bm", "mem"))
def mode_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _mode(spark, sf, 2)


_HYBRID = f", a AS ({top(_ALLOWED.format('vs'), 20)}), b AS ({top(_ALLOWED.format('bm'), 20)}), {_FUSE}, plain AS ({top('f')})"
_RERANKED = (
    f", wa AS ({top(_ALLOWED.format('vs'), 100)}), wb AS ({top(_ALLOWED.format('bm'), 100)}), w{_FUSE.replace('FROM a FULL JOIN b', 'FROM wa a FULL JOIN wb b')}, wide AS ({top('wf', 50)}), "
    f"qw AS (SELECT item_id AS query_id, list_distinct({WORDS.format('query')}) AS qw FROM eval_cases), "
    f"x AS (SELECT query_id, id, score, trim(text) <> '' AS ok, len([t FOR t IN qw IF list_contains({WORDS.format('text')}, t)]) / nullif(len(qw), 0)::DOUBLE AS r FROM wide JOIN mem USING (id) JOIN qw USING (query_id)), "
    "blended AS (SELECT query_id, id, CASE WHEN NOT ok THEN score WHEN r IS NULL THEN score * 0.8e0 ELSE greatest(0.6e0 * r + 0.4e0 * score, 0.5e0 * score) END AS score FROM x), "
    f"reranked AS ({top('blended')})"
)


@query(sql(_RERANKED + " SELECT query_id, id, rank, floor(score * 1000) / 1000 AS score FROM reranked", "vs", "bm", "mem"))
def mode_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best after reranking; scores cut to three digits, because the blend of six-digit scores is often a tie in the sixth."""
    return _mode(spark, sf, 3).select("query_id", "id", "rank", (F.floor(F.col("score") * 1000) / 1000).alias("score"))


def _precision_sql(name: str) -> str:
    return f"SELECT item_id AS query_id, CASE WHEN k > 0 THEN round(coalesce(sum(CASE WHEN len([t FOR t IN expected_terms IF contains(lower(text), lower(t))]) > 0 AND rank <= k THEN 1 ELSE 0 END), 0) / k::DOUBLE, 6) ELSE 0e0 END AS precision FROM eval_cases LEFT JOIN ({name} JOIN mem USING (id)) ON query_id = item_id GROUP BY item_id, k"


@query(sql(_HYBRID + _RERANKED + f" SELECT p.query_id, p.precision AS plain, r.precision AS reranked, round(r.precision - p.precision, 6) AS gain FROM ({_precision_sql('plain')}) p JOIN ({_precision_sql('reranked')}) r USING (query_id)", "vs", "bm", "mem"))
def rerank_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Precision of every case without and with reranking."""
    d, c = docs(spark, sf, "text"), cases(spark, sf)
    parts = [evaluation.precision(cut(_mode(spark, sf, m)), d, c).select("query_id", F.col("precision").alias(n)) for m, n in ((2, "plain"), (3, "reranked"))]
    return parts[0].join(parts[1], "query_id").withColumn("gain", F.round(F.col("reranked") - F.col("plain"), 6))
