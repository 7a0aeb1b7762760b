"""File sources and sinks: directory trees of notes, JSON datasets, configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "txt")


def crawl(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int | None = None) -> DataFrame:
    """(source_file, hierarchy_path, text, bytes) of the text files under root; the path is taken relative to it.

    max_bytes, where given, cuts a text at that many bytes (the piece of a character left goes); by default texts are whole.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    base = Path(root.removeprefix("file:")).as_posix().rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\."), "")
    body = F.substring("content", 1, max_bytes) if max_bytes else F.col("content")
    text = F.regexp_replace(F.make_valid_utf8(body.cast("string")), "�+$", "")
    return raw.select(rel.alias("source_file"), F.regexp_replace(rel, "/[^/]*$", "").alias("hierarchy_path"), text.alias("text"), F.col("length").alias("bytes"))


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(memories, queries) of a JSON file {dimension, memories[], queries[]}."""
    raw = spark.read.schema(
        "dimension INT, memories ARRAY<STRUCT<id STRING, text STRING, vector ARRAY<FLOAT>, category STRING, scope STRING, importance DOUBLE>>, queries ARRAY<STRUCT<name STRING, vector ARRAY<FLOAT>, expected_top1 STRING>>"
    ).json(path, multiLine=True)
    return raw.select(F.explode("memories").alias("m")).select("m.*"), raw.select(F.explode("queries").alias("q")).select("q.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Settings:
    """mode 1: full text, 2: hybrid, 3: hybrid and rerank."""

    mode: int = 2
    limit: int = 10
    dim: int = 128
    scopes: tuple[str, ...] = field(default_factory=tuple)
    rerank_weight: float = 0.6

    @property
    def uses_vectors(self) -> bool:
        return self.mode >= 2

    @property
    def reranks(self) -> bool:
        return self.mode == 3


def load_settings(path: str) -> Settings:
    """Settings from JSON or flat YAML (key: value); unknown keys are ignored."""
    text = Path(path).read_text()
    try:
        raw = json.loads(text)
    except ValueError:
        raw = {k.strip(): v.split("#")[0].strip().strip("\"'") for k, _, v in (line.partition(":") for line in text.splitlines()) if v.strip()}
    known = {f.name: f for f in fields(Settings)}
    out = {}
    for k, v in raw.items():
        if k == "scopes":
            out[k] = tuple(v if isinstance(v, list) else [x.strip() for x in str(v).strip("[]").split(",") if x.strip()])
        elif k in known:
            out[k] = float(v) if k == "rerank_weight" else int(v)
    return Settings(**out)
