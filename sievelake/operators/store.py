"""The store's reads and writes as plans over three tables: memories, vectors, and the full-text index.

``MemoryStore`` is the facade: it has the verbs a client calls and holds no data. A write makes
a new version of the store: new folders for what it rewrites or appends, then one file that lists
the folders of every table and the batches of the index. Readers take the latest such file, so
they see all of a write or nothing of it, and what a write that failed has left behind is never
read. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.text import is_phrase
from sievelake.functions.vectors import normalize
from sievelake.operators import fulltext, fusion, path_search, vector_search
from sievelake.operators.posting_index import PostingIndex
from sievelake.sources.tables import read_if_there

MEMORY = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("id", T.StringType()), ("text", T.StringType()), ("abstract", T.StringType()), ("overview", T.StringType()), ("category", T.StringType()),
        ("scope", T.StringType()), ("importance", T.DoubleType()), ("timestamp", T.LongType()), ("metadata", T.StringType()), ("hierarchy_path", T.StringType()),
        ("hierarchy_level", T.IntegerType()), ("parent_id", T.StringType()), ("node_type", T.StringType()), ("source_file", T.StringType()),
        ("chunk_index", T.IntegerType()), ("token_count", T.IntegerType()),
    )]
)
VECTOR = T.StructType([T.StructField("memory_id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("dimension", T.IntegerType())])


def migrate(df: DataFrame, schema: T.StructType = MEMORY) -> DataFrame:
    """All columns of the schema, those that are missing as null; extra columns go. Applying it twice changes nothing."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def default_if_empty(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def insert_defaults(df: DataFrame, now: int, strict: bool = False) -> DataFrame:
    """Rows as they are stored: ids and times filled in, empty optional fields null, node_type 'chunk'.

    Unless strict, category, scope, importance and metadata get the table's defaults, too.
    """
    d = migrate(df)
    out = d.select(
        F.coalesce(null_if_empty(F.col("id")), F.expr("uuid()")).alias("id"), F.coalesce("text", F.lit("")).alias("text"),
        *[null_if_empty(F.col(c)).alias(c) for c in ("abstract", "overview")],
        *[(F.coalesce(F.col(c), F.lit("")) if strict else default_if_empty(F.col(c), v)).alias(c) for c, v in (("category", "other"), ("scope", "global"))],
        (F.coalesce("importance", F.lit(0.0)) if strict else F.coalesce("importance", F.lit(0.7))).alias("importance"),
        F.coalesce(null_if_zero(F.col("timestamp")), F.lit(now).cast("long")).alias("timestamp"),
        (F.coalesce("metadata", F.lit("")) if strict else default_if_empty(F.col("metadata"), "{}")).alias("metadata"),
        null_if_empty(F.col("hierarchy_path")).alias("hierarchy_path"), F.coalesce("hierarchy_level", F.lit(0)).alias("hierarchy_level"),
        null_if_empty(F.col("parent_id")).alias("parent_id"), default_if_empty(F.col("node_type"), "chunk").alias("node_type"),
        null_if_empty(F.col("source_file")).alias("source_file"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), null_if_zero(F.col("token_count")).alias("token_count"),
    )
    return out


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet, each id once."""
    return rows.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the ids of ``gone`` (id)."""
    return df.join(gone.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def list_recent(memories: DataFrame, limit: int, scopes: list[str] | None = None) -> DataFrame:
    """The ``limit`` latest rows of each scope; unknown times last, ties by id."""
    if limit <= 0:
        raise ValueError(f"invalid limit: {limit}")
    m = memories.filter(F.col("scope").isin(scopes)) if scopes else memories
    return m.withColumn("rank", F.row_number().over(W.partitionBy("scope").orderBy(F.col("ts").desc_nulls_last(), "id"))).filter(F.col("rank") <= limit)


def children(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every child with its parent, its place among the siblings (chunk_index, then id) and whether it has a vector."""
    kids = memories.filter(F.col("parent_id") != "").join(vectors.select(F.col("memory_id").alias("id"), F.lit(True).alias("v")).distinct(), "id", "left")
    return kids.select("parent_id", "id", "chunk_index", F.coalesce("v", F.lit(False)).alias("has_vector"))


def child_counts(memories: DataFrame) -> DataFrame:
    """(id, children) of every memory."""
    n = memories.filter(F.col("parent_id") != "").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return memories.select("id").join(n, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


def as_v2(results: DataFrame) -> DataFrame:
    """Results without their text: where to read it instead, and the summaries."""
    return results.withColumn("content_url", F.concat(F.lit("/api/memories/"), "id", F.lit("/content"))).drop("text")


def to_json_v1(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))


def parse_request(bodies: DataFrame, column: str = "body", max_bytes: int = 10 << 20) -> DataFrame:
    """Request bodies (JSON) to memory rows; larger or malformed ones are left out."""
    parsed = bodies.filter(F.octet_length(column) <= max_bytes).select(F.from_json(column, MEMORY).alias("m")).select("m.*")
    return parsed.filter("text IS NOT NULL")


def valid_id(c: Column) -> Column:
    """An id that can stand in a path: not empty, no reserved word, none of / \\ ."""
    return F.coalesce((c != "") & ~c.isin("search", "stats") & ~c.rlike(r"[/\\.]"), F.lit(False))


def parse_limit(raw: str | None) -> int:
    """1..100, otherwise 10."""
    try:
        n = int(raw)
    except (TypeError, ValueError):
        return 10
    return n if 1 <= n <= 100 else 10


def _next_batch(version: dict) -> int:
    """A number above all earlier ones that no failed write can have used."""
    return max([time.time_ns(), *(b + 1 for b in version["batches"][-1:])])


class MemoryStore:
    """Verbs of the store over parquet tables in one folder."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 128, now: int | None = None):
        self.spark, self.path, self.dim, self.now = spark, path, dim, now
        if self._version() is None:
            self._publish({"version": 0, "batches": [], "memories": [], "vectors": [], "index": f"{path}/index-0"})

    def _now(self) -> int:
        return self.now if self.now is not None else int(time.time())

    def _version(self) -> dict | None:
        """The latest version; None where there is no store yet."""
        held = read_if_there(self.spark, f"{self.path}/versions", "content STRING, version LONG")
        return None if held is None else json.loads(held.orderBy(F.desc("version")).first()["content"])

    def _publish(self, version: dict) -> None:
        row = self.spark.createDataFrame([(json.dumps(version),)], "content STRING").coalesce(1)
        row.write.parquet(f"{self.path}/versions/version={version['version']}")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        folders = self._version()[name]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _put(self, df: DataFrame, name: str) -> str:
        folder = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def index(self) -> PostingIndex:
        version = self._version()
        return PostingIndex(self.spark, version["index"], version["batches"])

    def memories(self) -> DataFrame:
        return migrate(self._table("memories", MEMORY))

    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTOR)

    def health(self) -> dict:
        """Whether both tables can be read, and the version of Spark."""
        self.memories().limit(1).count(), self.vectors().limit(1).count()
        return {"status": "ok", "version": self.spark.version}

    def _check(self, rows: DataFrame) -> None:
        if "vector" in rows.columns and rows.filter(F.col("vector").isNotNull() & (F.size("vector") != self.dim)).limit(1).count():
            raise ValueError(f"vectors need {self.dim} numbers")

    def _identified(self, rows: DataFrame) -> DataFrame:
        """Rows with their ids, new ones where they have none; written once, so that both tables get the same ids."""
        r = rows.withColumn("id", F.coalesce(null_if_empty(F.col("id")) if "id" in rows.columns else F.lit(None), F.expr("uuid()")))
        folder = self._put(r, "incoming")
        r = self.spark.read.schema(r.schema).parquet(folder)
        if r.groupBy("id").count().filter("count > 1").limit(1).count():
            raise ValueError("an id exists already")
        return r

    def _appended(self, r: DataFrame, version: dict) -> dict:
        """The version with rows (with ids) appended to both tables and the index."""
        batch = _next_batch(version)
        out = version | {"version": version["version"] + 1, "batches": [*version["batches"], batch], "memories": [*version["memories"], self._put(insert_defaults(r, self._now()), "memories")]}
        if "vector" in r.columns:
            v = r.filter("vector IS NOT NULL").select(F.col("id").alias("memory_id"), normalize(F.col("vector")).cast("array<float>").alias("vector"), F.lit(self.dim).alias("dimension"))
            out["vectors"] = [*version["vectors"], self._put(v, "vectors")]
        PostingIndex(self.spark, version["index"]).add(r.select("id", "text"), batch)
        return out

    def _without(self, ids: DataFrame, version: dict) -> dict:
        """The version with ids removed from both tables and the index."""
        batch = _next_batch(version)
        PostingIndex(self.spark, version["index"]).remove(ids.select("id"), batch)
        return version | {
            "version": version["version"] + 1, "batches": [*version["batches"], batch], "memories": [self._put(without(self.memories(), ids, "id"), "memories")], "vectors": [self._put(without(self.vectors(), ids, "memory_id"), "vectors")],
        }

    def insert(self, rows: DataFrame) -> None:
        """Append rows (with an optional column vector); ids that exist raise, nothing is written then."""
        self._check(rows)
        r = self._identified(rows)
        if r.join(self.memories().select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("an id exists already")
        self._publish(self._appended(r, self._version()))

    def get(self, id: str) -> DataFrame:
        return self.memories().filter(F.col("id") == id).join(self.vectors().select(F.col("memory_id").alias("id"), "vector"), "id", "left")

    def content(self, id: str) -> DataFrame:
        return self.memories().filter(F.col("id") == id).select("text")

    def delete(self, ids: DataFrame) -> None:
        """Remove ids from both tables and the index."""
        self._publish(self._without(ids, self._version()))

    def update(self, rows: DataFrame) -> None:
        """Replace rows by their ids, in one version."""
        self._check(rows)
        r = self._identified(rows)
        self._publish(self._appended(r, self._without(r.select("id"), self._version())))

    def compact(self) -> None:
        """One folder for each table, and the index without what was removed."""
        version = self._version()
        target = f"{self.path}/index-{uuid.uuid4().hex}"
        self.index().compact(target)
        self._publish(version | {"version": version["version"] + 1, "memories": [self._put(self.memories(), "memories")], "vectors": [self._put(self.vectors(), "vectors")], "index": target})

    def list(self, scope: str, limit: int) -> DataFrame:
        return list_recent(self.memories().withColumn("ts", F.col("timestamp")), limit, [scope])

    def stats(self) -> DataFrame:
        return self.memories().groupBy("category").agg(F.count("*").alias("total"))

    def search(self, query: str = "", vector: list[float] | None = None, path: str = "", limit: int = 10, scopes: list[str] | None = None) -> DataFrame:
        """Path search where a path is given, else hybrid, or text alone without a vector."""
        if limit <= 0 or (path and limit > 100):
            raise ValueError(f"invalid limit: {limit}")
        if not query and not vector:
            raise ValueError("both query vector and text are empty")
        q = self.spark.createDataFrame([(1, query, path, [float(x) for x in vector] if vector else None)], "query_id int, query string, path string, vector array<double>")
        docs = self.memories().withColumn("ts", F.col("timestamp"))
        allowed = docs.filter(F.col("scope").isin(scopes)) if scopes else docs
        vecs = self.vectors().select(F.col("memory_id").alias("id"), "vector")
        if path:
            return path_search.path_search(q, allowed, vecs, self.dim, limit, self._now())
        special = is_phrase(F.col("query"))  # phrases need positions, which the index has not
        text = self.index().search(q.filter(~special)).unionByName(fulltext.phrase_bm25(docs, q.filter(special))).join(allowed.select("id"), "id")
        if not vector:
            return fulltext.top_k(text, limit)
        near = vector_search.vector_topk(q, vecs.join(allowed.select("id"), "id"), self.dim, 2 * limit)
        return fusion.boost_fusion(near, fulltext.top_k(text, 2 * limit), limit)

    def insert_json(self, rows_json: str) -> str:
        """Insert a JSON list of rows; the number of rows as JSON."""
        rows = json.loads(rows_json)
        schema = T.StructType([*MEMORY.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
        self.insert(self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema))
        return json.dumps({"inserted": len(rows)})

    def delete_json(self, ids_json: str) -> str:
        """Delete a JSON list of ids."""
        ids = json.loads(ids_json)
        self.delete(self.spark.createDataFrame([(i,) for i in ids], "id string"))
        return json.dumps({"deleted": len(ids)})

    def search_json(self, vector_json: str, limit: int, scopes_json: str = "[]") -> str:
        """The small facade for clients that speak JSON strings; at most ``limit`` rows are collected."""
        rows = self.search(vector=json.loads(vector_json), limit=limit, scopes=json.loads(scopes_json or "[]") or None)
        return json.dumps([{"id": r["id"], "score": r["score"]} for r in rows.orderBy("rank").collect()])
