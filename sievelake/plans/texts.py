"""Registered queries on texts: token estimates, headings, chunks, summaries; and the evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import text as tx
from sievelake.functions.embed import embed_udf
from sievelake.operators import chunking, evaluation, fulltext, retrieval, summaries
from sievelake.plans.views import K, NOW, cases, docs, located, sql, top, vectors, whole
from sievelake.session import cut
from sievelake.sources.tables import table

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("/"), F.coalesce("source", F.lit("none"))).alias("base"))


def _distances(spark, sf):
    return chunking.adjacent_distances(docs(spark, sf, "source_file", "chunk_index").join(vectors(spark, sf), "id"))


_WEIGHT = rf"(len(regexp_extract_all({{0}}, '[{tx.CJK}]')) * 15 + len(regexp_extract_all({{0}}, '[^{tx.CJK}{tx.SPACE}\p{{P}}]+')) * 13)"
_EST = f"CAST(floor({_WEIGHT} / 10) AS INTEGER)"


def _est(c: str) -> str:
    return _EST.replace("{0}", c)


@query(f"SELECT doc_id, {_est('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, regexp_matches(text, '(?m)^#{1,6}\s+.+$') AS headed FROM documents")
def has_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", tx.has_headings(F.col("text")).alias("headed"))


@query(
    r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS at, trim(regexp_extract(p, '^#{1,6}\s+([^\n]+)', 1)) AS title, regexp_replace(regexp_replace(p, '^#{1,6}\s+[^\n]+', ''), '^\s+|\s+$', '', 'g') AS content "
    r"FROM (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,6}\s+\S)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents)) WHERE regexp_replace(p, '\s', '', 'g') <> ''"
)
def split_headings(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sections(_documents(spark, sf).filter("text IS NOT NULL"))


_PACK = (
    r"WITH RECURSIVE p AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS t FROM (SELECT doc_id, [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(text, chr(10) || chr(10))] AS ps FROM documents)) WHERE t <> ''), "
    + f"q AS (SELECT *, {_WEIGHT.replace('{0}', 't')} AS w FROM p), "
    + "r AS (SELECT doc_id, i, t, w, 0 AS piece FROM q WHERE i = 1 UNION ALL SELECT q.doc_id, q.i, q.t, CASE WHEN (r.w + q.w) // 10 > 128 THEN q.w ELSE r.w + q.w END, r.piece + CASE WHEN (r.w + q.w) // 10 > 128 THEN 1 ELSE 0 END FROM r JOIN q ON q.doc_id = r.doc_id AND q.i = r.i + 1) "
    + "SELECT doc_id, CAST(piece AS INTEGER) AS \"at\", string_agg(t, chr(10) || chr(10) ORDER BY i) AS content FROM r GROUP BY doc_id, piece"
)


@query(_PACK)
def paragraph_pack(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    return d.select("doc_id", F.posexplode(tx.pack_paragraphs(F.col("text"), 128)).alias("at", "content"))


_S = r"[\s\p{Z}\x{85}]"
_ENDS, _TAIL = "[!?;。！？；]", "[" + chunking.ENDS.replace("'", "''") + "\\]" + chunking.CLOSERS.replace("]", "").replace("'", "''") + "]*"
_SHORT = rf"'(^|[^\p{{L}}])((?i:{'|'.join(sorted(chunking.ABBREVIATIONS))})|\p{{Lu}})\.({_S}|$)', '\1\2' || chr(2) || '\3', 'g'"


def _sentences(text: str) -> str:
    """A list of sentences: ends are marked, full stops of abbreviations and initials hidden first."""
    e = f"regexp_replace(regexp_replace(coalesce({text}, ''), {_SHORT}), {_SHORT})"
    e = f"regexp_replace({e}, '({_ENDS}{_TAIL})', '\\1' || chr(1), 'g')"
    e = f"regexp_replace({e}, '([.…])({_S}|$)', '\\1' || chr(1) || '\\2', 'g')"
    return f"[s FOR s IN [regexp_replace(replace(x, chr(2), '.'), '^{_S}+|{_S}+$', '', 'g') FOR x IN string_split({e}, chr(1))] IF s <> '']"


@query(f"SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS at, unnest(ss) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents)")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.posexplode(chunking.sentences("text")).alias("at", "sentence"))


@query()
def smart_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.smart_split(_documents(spark, sf))


@query()
def semantic_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_split(_documents(spark, sf))


@query(
    f"SELECT doc_id, CAST(n // 4 AS INTEGER) AS window, array_to_string(ss[n + 1:n + 5], ' ') AS content FROM (SELECT doc_id, ss, unnest(range(0, greatest(len(ss) - 2, 0) + 1, 4)) AS n FROM (SELECT doc_id, {_sentences('text')} AS ss FROM documents) WHERE len(ss) > 0)"
)
def overlap_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.overlapping(_documents(spark, sf), 5, 1)


@query()
def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", embed_udf()("text").alias("vector"))


@query(sql(
    ", c AS (SELECT source_file, chunk_index, min(mem.id) AS id FROM mem JOIN vec USING (id) WHERE source_file IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL) "
    "SELECT a.source_file, a.chunk_index, a.id, b.id AS next_id, round(1 - list_cosine_similarity(x.v, y.v), 6) AS distance FROM c a JOIN c b ON a.source_file = b.source_file AND b.chunk_index = a.chunk_index + 1 JOIN vec x ON x.id = a.id JOIN vec y ON y.id = b.id", "mem", "vec",
))
def sentence_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between neighbouring chunks of a file."""
    return _distances(spark, sf).withColumn("distance", F.round("distance", 6))


@query(sql(
    ", c AS (SELECT source_file, chunk_index, min(mem.id) AS id FROM mem JOIN vec USING (id) WHERE source_file IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL), "
    "d AS (SELECT a.source_file, 1 - list_cosine_similarity(x.v, y.v) AS distance FROM c a JOIN c b ON a.source_file = b.source_file AND b.chunk_index = a.chunk_index + 1 JOIN vec x ON x.id = a.id JOIN vec y ON y.id = b.id) "
    "SELECT source_file, count(*) AS gaps, round(avg(distance), 5) AS mean, round(stddev_pop(distance), 5) AS sd FROM d GROUP BY source_file", "mem", "vec",
))
def distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of those distances in each file."""
    return _distances(spark, sf).groupBy("source_file").agg(F.count("*").alias("gaps"), F.round(F.avg("distance"), 5).alias("mean"), F.round(F.stddev_pop("distance"), 5).alias("sd"))


@query(
    r"SELECT doc_id, CASE WHEN contains(t, '。') THEN regexp_extract(t, '(?s)^(.*?。)', 1) WHEN regexp_matches(t, '(?s)^..*?[.!?](?:\s|\z)') THEN regexp_extract(t, '(?s)^(..*?[.!?])(?:\s|\z)', 1) ELSE left(t, 80) END AS abstract FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
)
def l0_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", tx.l0_by_rule(F.col("text")).alias("abstract"))


def _l1(text: str) -> str:
    marked = rf"regexp_replace(regexp_replace({text}, '([。！？])', '\1' || chr(1), 'g'), '([.!?])([\s\p{{Z}}])', '\1' || chr(1) || '\2', 'g')"
    head = f"CASE WHEN len(string_split({marked}, chr(1))) > 5 THEN array_to_string(string_split({marked}, chr(1))[1:5], '') ELSE {text} END"
    cut_head = f"[CASE WHEN strlen(h) >= 500 THEN left(h, [i FOR i IN range(1, 501) IF strlen(left(h, i)) >= 500][1]) ELSE h END FOR h IN [{head}]][1]"
    return rf"[CASE WHEN t = '' THEN left({text}, 500) ELSE t END FOR t IN [regexp_replace({cut_head}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')]][1]"


_L0 = r"CASE WHEN contains({0}, '。') THEN regexp_extract({0}, '(?s)^(.*?。)', 1) WHEN regexp_matches({0}, '(?s)^..*?[.!?](?:\s|\z)') THEN regexp_extract({0}, '(?s)^(..*?[.!?])(?:\s|\z)', 1) ELSE left({0}, 80) END"


@query(f"SELECT doc_id, {_l1('t')} AS overview FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def l1_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", summaries.l1_by_rule(F.coalesce("text", F.lit(""))).alias("overview"))


@query("WITH c AS (SELECT sha256(text) AS k, min(abstract) AS summary FROM memories WHERE abstract <> '' GROUP BY ALL) SELECT DISTINCT m.id, c.summary FROM memories m JOIN c ON c.k = sha256(coalesce(m.text, ''))")
def summary_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """Stored abstracts as a cache by content hash, looked up for every memory."""
    m = table(spark, sf, "memories").select("id", "text", "abstract")
    cache = m.filter(F.col("abstract") != "").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("abstract").alias("summary"))
    return m.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k")).distinct().join(cache, "k").select("id", "summary")


@query(sql(f", t AS (SELECT id, coalesce(text, '') AS t, abstract FROM mem), c AS (SELECT t, min(abstract) AS summary FROM t WHERE abstract <> '' GROUP BY t) SELECT id, coalesce(summary, {_L0.replace('{0}', 't.t')}) AS abstract, {_l1('t.t')} AS overview FROM t LEFT JOIN c ON c.t = t.t", "mem"))
def summarized(spark: SparkSession, sf: str) -> DataFrame:
    m = docs(spark, sf, "text", "abstract")
    cache = m.filter(F.col("abstract") != "").select(summaries.content_key(F.col("text"), 0).alias("key"), F.col("abstract").alias("summary"))
    cache = cache.groupBy("key").agg(F.min("summary").alias("summary"))
    return summaries.summarized(m.select("id", "text"), cache)


@query()
def ingest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the store would hold them: chunks with summaries, path, level and a vector."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id").alias("source_file"), "text")
    return retrieval.ingest_rows(d, NOW)


def _found(spark, sf):
    return cut(fulltext.top_k(fulltext.bm25(docs(spark, sf, "text"), cases(spark, sf), "any"), K))


_HITS = f", r AS ({top('bm')}), j AS (SELECT r.query_id, r.rank, r.score, mem.hierarchy_path, len([t FOR t IN expected_terms IF contains(lower(text), lower(t))]) AS got, len(expected_terms) AS n FROM r JOIN mem USING (id) JOIN eval_cases ON item_id = r.query_id)"
_PREC = (
    _HITS + ", b AS (SELECT j.query_id, count(*) AS results, sum(CASE WHEN got > 0 AND rank <= k THEN 1 ELSE 0 END) AS relevant FROM j JOIN eval_cases ON item_id = query_id GROUP BY query_id), "
    "p AS (SELECT item_id AS query_id, name, coalesce(results, 0) AS results, coalesce(relevant, 0)::BIGINT AS relevant, CASE WHEN k > 0 THEN round(coalesce(relevant, 0) / k::DOUBLE, 6) ELSE 0e0 END AS precision, coalesce(relevant, 0) >= topk_relevant AND coalesce(results, 0) >= min_results AS passed FROM eval_cases LEFT JOIN b ON item_id = query_id)"
)


@query(sql(_PREC + " SELECT * FROM p", "bm", "mem"))
def precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.precision(_found(spark, sf), docs(spark, sf, "text"), cases(spark, sf))


@query(sql(_PREC + " SELECT string_split(name, '_')[1] AS suite, count(*) AS cases, sum(passed::INTEGER)::BIGINT AS passed, round(avg(passed::INTEGER), 6) AS pass_rate, round(avg(precision), 6) AS precision FROM p GROUP BY ALL", "bm", "mem"))
def suite_pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.suites(evaluation.precision(_found(spark, sf), docs(spark, sf, "text"), cases(spark, sf)))


@query(sql(
    _HITS + " SELECT j.query_id, count(*) AS results, sum(CASE WHEN hierarchy_path = path OR starts_with(hierarchy_path, path || '/') THEN 1 ELSE 0 END)::BIGINT AS in_path, "
    "sum(CASE WHEN got = n THEN 1 ELSE 0 END)::BIGINT AS full_match, sum(CASE WHEN got > 0 AND got < n THEN 1 ELSE 0 END)::BIGINT AS partial_match, round(max(score), 6) AS best, round(sum(score), 6) AS total FROM j JOIN qp USING (query_id) GROUP BY j.query_id", "bm", "mem", "qp",
))
def scenario_match(spark: SparkSession, sf: str) -> DataFrame:
    at = cases(spark, sf).drop("path").join(located(spark, sf).select("query_id", "path"), "query_id")
    return evaluation.scenario(_found(spark, sf), docs(spark, sf, "text", "hierarchy_path"), at)


def _found_whole(spark, sf):
    return cut(fulltext.top_k(fulltext.bm25(docs(spark, sf, "text"), cases(spark, sf)), K))


@query(whole(SQL["precision_at_k"]))
def precision_at_k_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Asking for all words of a query; most cases find nothing, which is their result."""
    return evaluation.precision(_found_whole(spark, sf), docs(spark, sf, "text"), cases(spark, sf))


@query(whole(SQL["suite_pass_rates"]))
def suite_pass_rates_whole(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.suites(evaluation.precision(_found_whole(spark, sf), docs(spark, sf, "text"), cases(spark, sf)))


@query(whole(SQL["scenario_match"]))
def scenario_match_whole(spark: SparkSession, sf: str) -> DataFrame:
    at = cases(spark, sf).drop("path").join(located(spark, sf).select("query_id", "path"), "query_id")
    return evaluation.scenario(_found_whole(spark, sf), docs(spark, sf, "text", "hierarchy_path"), at)
