"""Registered queries of the store's reads and writes, of captured messages and of filters on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import quality, store
from sievelake.plans.views import NOW, SEC, docs, sql
from sievelake.sources.tables import memories, seconds, table
from sievelake.streaming import capture

QUERIES, SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


@query(sql("SELECT * FROM (SELECT scope, id, ts, row_number() OVER (PARTITION BY scope ORDER BY ts DESC NULLS LAST, id) AS rank FROM mem) WHERE rank <= 20", "mem"))
def list_recent(spark: SparkSession, sf: str) -> DataFrame:
    return store.list_recent(docs(spark, sf, "scope", "ts"), 20).select("scope", "id", "ts", "rank")


@query(sql("SELECT parent_id, mem.id, chunk_index, v.id IS NOT NULL AS has_vector FROM mem LEFT JOIN (SELECT DISTINCT memory_id AS id FROM vectors) v ON v.id = mem.id WHERE parent_id IS NOT NULL", "mem"))
def get_children(spark: SparkSession, sf: str) -> DataFrame:
    return store.children(docs(spark, sf, "parent_id", "chunk_index"), table(spark, sf, "vectors"))


@query(sql("SELECT mem.id, count(c.id) AS children, count(c.id) > 0 AS has_children FROM mem LEFT JOIN mem c ON c.parent_id = mem.id GROUP BY mem.id", "mem"))
def has_children(spark: SparkSession, sf: str) -> DataFrame:
    return store.child_counts(docs(spark, sf, "parent_id")).withColumn("has_children", F.col("children") > 0)


@query(sql("SELECT id, text FROM mem", "mem"))
def get_content(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "text")


@query("SELECT 'memories' AS name, count(*) AS kept FROM memories WHERE id NOT IN (SELECT memory_id FROM deletions) UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE memory_id NOT IN (SELECT memory_id FROM deletions)")
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What both tables keep once every logged deletion is applied to them."""
    gone = table(spark, sf, "deletions").select(F.col("memory_id").alias("id"))
    kept = [store.without(table(spark, sf, n), gone, k).select(F.lit(n).alias("name")) for n, k in (("memories", "id"), ("vectors", "memory_id"))]
    return kept[0].groupBy("name").agg(F.count("*").alias("kept")).unionByName(kept[1].groupBy("name").agg(F.count("*").alias("kept")))


@query(
    f"SELECT id, coalesce(text, '') AS text, nullif(abstract, '') AS abstract, nullif(overview, '') AS overview, coalesce(nullif(category, ''), 'other') AS category, coalesce(nullif(scope, ''), 'global') AS scope, coalesce(importance, 0.7e0) AS importance, coalesce(nullif(timestamp, 0), {NOW}) AS timestamp, "
    "coalesce(nullif(metadata, ''), '{}') AS metadata, nullif(hierarchy_path, '') AS hierarchy_path, coalesce(hierarchy_level, 0) AS hierarchy_level, nullif(parent_id, '') AS parent_id, coalesce(nullif(node_type, ''), 'chunk') AS node_type, nullif(source_file, '') AS source_file, coalesce(chunk_index, 0) AS chunk_index, nullif(token_count, 0) AS token_count FROM memories"
)
def insert_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return store.insert_defaults(table(spark, sf, "memories"), NOW)


@query("SELECT DISTINCT message_id AS id FROM captures WHERE message_id NOT IN (SELECT id FROM memories)")
def insert_new_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Captured messages under their own id that no memory has yet."""
    return store.new_rows(table(spark, sf, "captures").select(F.col("message_id").alias("id")), table(spark, sf, "memories"))


@query(sql("SELECT lower(category) AS category, count(*) AS total, count(parent_id) AS linked, round(avg(importance), 6) AS importance FROM mem GROUP BY lower(category)", "mem"))
def stats_by_category(spark: SparkSession, sf: str) -> DataFrame:
    m = docs(spark, sf, "category", "parent_id", "importance")
    return m.groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("total"), F.count("parent_id").alias("linked"), F.round(F.avg("importance"), 6).alias("importance"))


@query(sql("SELECT id, abstract, overview, source_file, '/api/memories/' || id || '/content' AS content_url FROM mem", "mem"))
def v2_projection(spark: SparkSession, sf: str) -> DataFrame:
    return store.as_v2(docs(spark, sf, "text", "abstract", "overview", "source_file"))


@query("SELECT id, id <> '' AND id NOT IN ('search', 'stats') AND NOT regexp_matches(id, '[/\\\\.]') AS valid FROM (SELECT id FROM memories UNION SELECT source_file FROM memories WHERE source_file IS NOT NULL)")
def valid_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Which ids and source files could stand in a request path."""
    m = table(spark, sf, "memories")
    ids = m.select("id").unionByName(m.filter("source_file IS NOT NULL").select(F.col("source_file").alias("id"))).distinct()
    return ids.select("id", store.valid_id(F.col("id")).alias("valid"))


@query("SELECT id, text, importance FROM memories WHERE text IS NOT NULL")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to JSON bodies and back through the request parser."""
    bodies = store.to_json_v1(table(spark, sf, "memories")).withColumnRenamed("json", "body")
    return store.parse_request(bodies).select("id", "text", "importance")


@query("SELECT id, json_extract_string(m, '$.platform') AS platform, json_extract_string(m, '$.messageId') AS message_id FROM (SELECT id, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM memories WHERE scope LIKE 'browser:%')")
def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Platform and message of browser memories; null where the metadata is no JSON."""
    m = table(spark, sf, "memories").filter(F.startswith("scope", F.lit("browser:")))
    return m.select("id", F.get_json_object("metadata", "$.platform").alias("platform"), F.get_json_object("metadata", "$.messageId").alias("message_id"))


_MSG = "m AS (SELECT message_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, role, platform, url, timestamp FROM captures WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10)"
_DEDUP = f"WITH {_MSG}, d AS (SELECT *, row_number() OVER (PARTITION BY concat_ws(':', platform, role, substring(text, 1, 100), coalesce(url, '')) ORDER BY timestamp, message_id) AS n FROM m)"


def _messages(spark, sf):
    return capture.fingerprinted(capture.messages(table(spark, sf, "captures")))


@query(f"{_DEDUP} SELECT message_id, platform, timestamp FROM d WHERE n = 1")
def capture_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return capture.deduplicated(_messages(spark, sf)).select("message_id", "platform", "timestamp")


@query(f"{_DEDUP} SELECT message_id AS id, text, 'conversation' AS category, 'browser:' || platform AS scope, 0.5e0 AS importance, CAST(floor(timestamp / 1000) AS BIGINT) AS timestamp FROM d WHERE n = 1")
def capture_rows(spark: SparkSession, sf: str) -> DataFrame:
    return capture.memory_rows(capture.deduplicated(_messages(spark, sf))).drop("metadata")


@query(
    f"WITH {_MSG}, g AS (SELECT platform, coalesce(url, '') AS url, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY platform, url ORDER BY timestamp) < 2000 THEN 0 ELSE 1 END AS s FROM m), "
    "r AS (SELECT platform, url, timestamp, sum(s) OVER (PARTITION BY platform, url ORDER BY timestamp, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT platform, url, min(timestamp) AS started_ms, max(timestamp) + 2000 AS ended_ms, count(*) AS messages FROM r GROUP BY platform, url, k"
)
def capture_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = capture.sessions(_messages(spark, sf))
    return s.select("platform", "url", F.unix_millis("started").alias("started_ms"), F.unix_millis("ended").alias("ended_ms"), "messages")


@query(f"WITH {_MSG} SELECT platform, CAST(floor(timestamp / 3600000) * 3600 AS BIGINT) AS hour, count(*) AS messages FROM m GROUP BY ALL")
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return capture.rates(_messages(spark, sf), "1 hour").select("platform", F.unix_seconds("from").alias("hour"), "messages")


@query("SELECT event_type, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = e.groupBy("event_type", F.window("t", "10 minutes").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.unix_seconds("w.start").alias("start"), "events", "total")


@query(f"WITH {_MSG}, q AS (SELECT message_id, platform, row_number() OVER (PARTITION BY platform ORDER BY timestamp DESC, message_id) AS n FROM m) SELECT message_id, platform FROM q WHERE n <= 500")
def offline_queue(spark: SparkSession, sf: str) -> DataFrame:
    return capture.bounded_queue(_messages(spark, sf)).select("message_id", "platform")


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    # a stream reads folders: the table's own where it is one, else its parent with the file's name as filter
    held = spark.read.parquet(path)
    is_file = any(f.rstrip("/").endswith(f"/{name}.parquet") for f in held.inputFiles())
    r = spark.readStream.schema(held.schema)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf) if is_file else r.parquet(path)


@query("SELECT DISTINCT message_id AS id FROM captures WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 ")
def capture_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Messages let through by the running stream, each message once: a delivery that comes again later is dropped by its id afterwards."""
    m = capture.messages(_stream(spark, sf, "captures")).select("message_id", "ts")
    seen = m.withWatermark("ts", "366 days").dropDuplicatesWithinWatermark(["message_id"])
    return capture.run_once(seen).select(F.col("message_id").alias("id"))


@query(f"WITH {_MSG} SELECT DISTINCT platform, role, substring(text, 1, 100) AS head, coalesce(url, '') AS url FROM m")
def capture_stream_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """What the running stream lets through by fingerprint, each once while the watermark of an hour remembers it."""
    m = capture.deduplicated_stream(capture.fingerprinted(capture.messages(_stream(spark, sf, "captures"))))
    return capture.run_once(m.select("platform", "role", F.substring("text", 1, capture.HEAD).alias("head"), F.coalesce("url", F.lit("")).alias("url")))


@query(f"WITH {_MSG} SELECT platform, CAST(floor(timestamp / 3600000) * 3600 AS BIGINT) AS hour, count(*) AS messages, greatest(count(*) - 2, 0) AS refused FROM m GROUP BY ALL")
def rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that a limit of two an hour and platform would refuse."""
    r = capture.rates(_messages(spark, sf), "1 hour")
    return r.select("platform", F.unix_seconds("from").alias("hour"), "messages", F.greatest(F.col("messages") - 2, F.lit(0)).alias("refused"))


@query("SELECT * FROM (SELECT event_type, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start, count(*) AS events FROM events GROUP BY ALL) WHERE start + 600 <= (SELECT max(epoch(ts)) FROM events) - 600")
def event_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark, ten minutes behind the last event, has closed, counted by the running stream; event_windows has the open ones, too."""
    e = _stream(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "10 minutes")
    w = e.groupBy("event_type", F.window("t", "10 minutes").alias("w")).agg(F.count("*").alias("events"))
    return capture.run_once(w.select("event_type", F.unix_seconds("w.start").alias("start"), "events"))


def _alt(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


def _noise(c: str) -> str:
    return f"CASE WHEN regexp_matches(lower({c}), '{_alt(quality.DENIALS)}') THEN 'denial' WHEN regexp_matches(lower({c}), '{_alt(quality.META_QUESTIONS)}') THEN 'meta' WHEN regexp_matches(lower(trim({c})), '{_alt(quality.SMALL_TALK)}') THEN 'small_talk' END"


@query(sql(f"SELECT id, {_noise('text')} AS kind FROM mem WHERE {_noise('text')} IS NOT NULL", "mem"))
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "text").select("id", quality.noise_kind(F.col("text")).alias("kind")).filter("kind IS NOT NULL")


@query(sql(f"SELECT id, round(CASE WHEN regexp_matches(lower(text), '{_alt(quality.META_QUESTIONS)}') THEN importance * 0.5e0 ELSE importance END, 6) AS importance FROM mem", "mem"))
def meta_question_weight(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "text", "importance").select("id", F.round(quality.reweighed(F.col("importance"), F.col("text")), 6).alias("importance"))


@query(f"SELECT item_id, CASE WHEN regexp_matches(lower(q), '{_alt(quality.META_QUESTIONS)}') THEN 'force' WHEN regexp_matches(lower(q), '{_alt(quality.SMALL_TALK)}') OR (length(q) < 4 AND len(regexp_extract_all(q, '[一-鿿]')) < 2) THEN 'skip' ELSE 'search' END AS decision FROM (SELECT item_id, trim(coalesce(query, '')) AS q FROM eval_cases)")
def retrieval_decision(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_cases").select("item_id", quality.retrieval_decision(F.col("query")).alias("decision"))


_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{cue}') THEN '{name}'" for name, cue in quality.CATEGORY_CUES) + " ELSE 'other' END"


@query(sql(f"SELECT {_CAT} AS guessed, lower(category) AS category, count(*) AS rows FROM mem GROUP BY ALL", "mem"))
def category_cues(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf, "text", "category").groupBy(quality.category(F.col("text")).alias("guessed"), F.lower("category").alias("category")).agg(F.count("*").alias("rows"))


@query("SELECT message_id, round(least(0.5e0 + CASE WHEN length(regexp_extract(text, '(?s)```(.*?)```', 1)) >= 50 THEN 0.2e0 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.1e0 ELSE 0 END + CASE WHEN role = 'assistant' THEN 0.1e0 ELSE 0 END, 1e0), 6) AS importance FROM captures")
def importance_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "captures").select("message_id", F.round(quality.importance_heuristic(F.col("text"), F.col("role")), 6).alias("importance"))


_SUFFIX = ", ".join(f"'{x}'" for x in quality.SUFFIXES)


@query(f"SELECT site, count(*) AS messages FROM (SELECT CASE WHEN h <> '' THEN array_to_string(CASE WHEN array_to_string(string_split(h, '.')[-2:], '.') IN ({_SUFFIX}) THEN string_split(h, '.')[-3:] ELSE string_split(h, '.')[-2:] END, '.') END AS site FROM (SELECT lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS h FROM captures)) GROUP BY site")
def site_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "captures").groupBy(quality.site_scope(F.coalesce("url", F.lit(""))).alias("site")).agg(F.count("*").alias("messages"))


@query(sql("SELECT id, scope FROM mem WHERE scope IN ('global', 'agent:scout')", "mem"))
def acl_scope(spark: SparkSession, sf: str) -> DataFrame:
    return quality.accessible(docs(spark, sf, "scope"), "scout")


@query(f"SELECT scope, CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS rows, round(sum(CASE WHEN importance > 0 THEN importance ELSE 0.7e0 END), 6) AS importance FROM (SELECT id, min(scope) AS scope, min({SEC.format('timestamp')}) AS ts, min(importance) AS importance FROM memories GROUP BY id) WHERE ts IS NOT NULL GROUP BY ALL HAVING count(*) >= 5")
def consolidation_due(spark: SparkSession, sf: str) -> DataFrame:
    return quality.consolidation(memories(spark, sf, "scope", "ts", "importance")).withColumn("importance", F.round("importance", 6))


@query(f"SELECT id, max({SEC.format('timestamp')}) AS ts FROM memories GROUP BY id")
def times_in_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "memories").select("id", seconds(F.col("timestamp")).alias("ts")).groupBy("id").agg(F.max("ts").alias("ts"))
