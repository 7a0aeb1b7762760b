"""Registered queries of the general data problems (hierarchies and orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import hierarchy, orphans
from sievelake.sources.tables import seconds, table


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "memories").select("id", "parent_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, sf)).select("id", "root_id", "depth")


def p4_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(_links(spark, sf), with_path=True)


def p4_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(_links(spark, sf))


def p4_descendant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendant_counts(_links(spark, sf))


def p4_path_check(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.check_paths(table(spark, sf, "memories"))


def p4_hierarchy_check(spark: SparkSession, sf: str) -> DataFrame:
    """Stored paths and levels against depth and the nearest sound ancestor; p4_path_check and its SQL look at the parent's stored path only."""
    return hierarchy.check_hierarchy(table(spark, sf, "memories"))


def _failing(spark: SparkSession, sf: str) -> DataFrame:
    m, v = table(spark, sf, "memories"), table(spark, sf, "vectors")
    refs = m.select(F.lit("memories").alias("ref_table"), F.col("id").alias("ref_id"), F.col("parent_id").alias("target_id"), seconds(F.col("timestamp")).alias("ref_ts")).unionByName(
        v.select(F.lit("vectors").alias("ref_table"), F.col("memory_id").alias("ref_id"), F.col("memory_id").alias("target_id"), F.unix_timestamp("embedded_at").alias("ref_ts"))
    )
    return orphans.failing_references(refs, m.select("id", seconds(F.col("timestamp")).alias("ts")), table(spark, sf, "deletions").select(F.col("memory_id").alias("id")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _failing(spark, sf).select("ref_table", "ref_id", "target_id", "state").distinct()


def p5_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.monthly_misses(_failing(spark, sf).distinct())


QUERIES = {f.__name__: f for f in (p4_found, p4_paths, p4_descendants, p4_descendant_counts, p4_path_check, p4_hierarchy_check, p5_found, p5_monthly)}

_SEC = "CASE WHEN {0} = 0 THEN NULL WHEN abs({0}) >= 100000000000 THEN CAST(floor({0} / 1000) AS BIGINT) ELSE {0} END"
_UP = (
    "WITH RECURSIVE m AS (SELECT id, min(nullif(parent_id, '')) AS parent FROM memories GROUP BY id), "
    "l AS (SELECT m.id, p.id AS parent FROM m LEFT JOIN m p ON m.parent = p.id), "
    "up AS (SELECT id, id AS node, 0 AS depth, [id] AS way, false AS looped FROM l "
    "UNION ALL SELECT up.id, l.parent, up.depth + 1, list_append(up.way, l.parent), list_contains(up.way, l.parent) FROM up JOIN l ON l.id = up.node WHERE l.parent IS NOT NULL AND NOT up.looped), "
    "top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS rn FROM up) "
)
_FAIL = (
    f"WITH k AS (SELECT id, min({_SEC.format('timestamp')}) AS ts FROM memories GROUP BY id), "
    f"r AS (SELECT 'memories' AS ref_table, id AS ref_id, parent_id AS target_id, {_SEC.format('timestamp')} AS ref_ts FROM memories "
    "UNION SELECT 'vectors', memory_id, memory_id, CAST(floor(epoch(embedded_at)) AS BIGINT) FROM vectors), "
    "f AS (SELECT r.*, CASE WHEN k.id IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM deletions d WHERE d.memory_id = r.target_id) THEN 'deleted' ELSE 'missing' END WHEN k.ts > r.ref_ts THEN 'late' END AS state "
    "FROM r LEFT JOIN k ON k.id = r.target_id WHERE r.target_id <> '') "
)
SQL = {
    "p4_found": _UP + "SELECT id, CASE WHEN looped THEN list_min(way[list_position(way, node):]) ELSE node END AS root_id, CASE WHEN looped THEN -1 ELSE depth END AS depth FROM top WHERE rn = 1",
    "p4_paths": _UP + "SELECT id, CASE WHEN looped THEN list_min(way[list_position(way, node):]) ELSE node END AS root_id, CASE WHEN looped THEN -1 ELSE depth END AS depth, CASE WHEN NOT looped THEN array_to_string(list_reverse(way), '/') END AS path FROM top WHERE rn = 1",
    "p4_descendants": _UP + "SELECT up.node AS ancestor, up.id, up.depth AS distance FROM up JOIN top ON top.id = up.id AND top.rn = 1 AND NOT top.looped WHERE up.depth > 0",
    "p4_descendant_counts": _UP + "SELECT up.node AS id, count(*) - 1 AS descendants FROM up JOIN top ON top.id = up.id AND top.rn = 1 AND NOT top.looped GROUP BY up.node",
    "p4_path_check": (
        "WITH d AS (SELECT id, min(nullif(parent_id, '')) AS parent, min(nullif(hierarchy_path, '')) AS path, min(hierarchy_level) AS level FROM memories GROUP BY id) "
        "SELECT d.id, CASE WHEN d.path IS NULL THEN 'missing' WHEN u.path IS NULL THEN 'unchecked' WHEN starts_with(d.path, u.path || '/') OR d.path = u.path THEN 'ok' ELSE 'stale' END AS path_state, "
        "CASE WHEN d.level IS NULL OR d.path IS NULL THEN 'missing' WHEN d.level = length(d.path) - length(replace(d.path, '/', '')) THEN 'ok' ELSE 'wrong' END AS level_state FROM d LEFT JOIN d u ON u.id = d.parent"
    ),
    "p5_found": _FAIL + "SELECT DISTINCT ref_table, ref_id, target_id, state FROM f WHERE state IS NOT NULL",
    "p5_monthly": _FAIL + "SELECT ref_table, coalesce(strftime(make_timestamp(ref_ts * 1000000), '%Y-%m'), 'unknown') AS month, state, count(*) AS misses FROM f WHERE state IS NOT NULL GROUP BY ALL",
}
