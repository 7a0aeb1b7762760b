"""Writes, the facade, sources, captured messages, filters."""

import json

import pytest
from pyspark.sql import functions as F

from sievelake.functions import text as tx
from sievelake.operators import evaluation, quality, store
from sievelake.sources import files
from sievelake.sources.tables import seconds
from sievelake.streaming import capture


@pytest.fixture
def db(spark, tmp_path):
    return store.MemoryStore(spark, str(tmp_path / "db"), dim=3, now=1_700_000_000)


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id string, text string, scope string, hierarchy_path string, vector array<float>")


def test_store_round_trip(spark, db):
    db.insert(rows(spark, ("a", "Go is strong", "global", None, [1.0, 0.0, 0.0]), ("b", "Python fits data", "global", None, [0.0, 2.0, 0.0]), ("c", "Go is fast", "agent:x", "/p", [0.9, 0.1, 0.0])))
    got = db.get("b").first()
    assert got["vector"] == [0.0, 1.0, 0.0] and got["category"] == "other" and got["timestamp"] == 1_700_000_000
    assert [r["id"] for r in db.search(query="go", vector=[1.0, 0.0, 0.0], limit=2, scopes=["global"]).orderBy("rank").collect()] == ["a", "b"]
    assert {r["id"] for r in db.search(query="go").collect()} == {"a", "c"}
    assert {r["id"] for r in db.search(query="go", path="/p").collect()} >= {"c"}
    assert json.loads(db.search_json("[1, 0, 0]", 1))[0]["id"] == "a"
    assert db.health()["status"] == "ok"
    assert db.content("a").first()["text"] == "Go is strong"
    assert {r["category"]: r["total"] for r in db.stats().collect()} == {"other": 3}
    with pytest.raises(ValueError):
        db.insert(rows(spark, ("a", "again", "global", None, None)))
    with pytest.raises(ValueError):
        db.insert(rows(spark, ("d", "bad", "global", None, [1.0])))
    db.update(rows(spark, ("a", "Go changed", "global", None, [1.0, 0.0, 0.0])))
    assert db.content("a").first()["text"] == "Go changed"
    db.delete(spark.createDataFrame([("a",), ("c",)], "id string"))
    assert {r["id"] for r in db.memories().collect()} == {"b"} and {r["memory_id"] for r in db.vectors().collect()} == {"b"}
    assert [r["id"] for r in db.list("global", 5).collect()] == ["b"]


def test_store_arguments(db):
    for bad in ({"query": "x", "limit": 0}, {}):
        with pytest.raises(ValueError):
            db.search(**bad)
    with pytest.raises(ValueError):
        db.list("global", 0)
    assert [store.parse_limit(x) for x in (None, "5", "0", "101", "x")] == [10, 5, 10, 10, 10]


def test_migrate_twice(spark):
    df = spark.createDataFrame([("a", "t", 1)], "id string, text string, extra int")
    once = store.migrate(df)
    assert once.schema.names == store.MEMORY.names and store.migrate(once).collect() == once.collect()


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, "", "", 0), ("x", "t", "c", "s", 5)], "id string, text string, category string, scope string, timestamp long")
    got = {r["text"]: r for r in store.insert_defaults(df, 9).collect()}
    assert got[""]["id"] and got[""]["category"] == "other" and got[""]["timestamp"] == 9 and got["t"]["timestamp"] == 5 and got["t"]["node_type"] == "chunk"
    assert store.insert_defaults(df.limit(1), 9, strict=True).first()["category"] == ""


def test_ids_scopes_times(spark):
    df = spark.createDataFrame([("a-1",), ("",), ("search",), ("a/b",), ("a.b",), (None,)], "id string")
    assert [r[0] for r in df.select(store.valid_id(F.col("id"))).collect()] == [True, False, False, False, False, False]
    assert spark.range(1).select(tx.scopes_of(F.lit(" a, ,b ,"))).first()[0] == ["a", "b"]
    t = spark.createDataFrame([(0,), (None,), (1706745600,), (1706745600123,)], "t long")
    assert [r[0] for r in t.select(seconds(F.col("t"))).collect()] == [None, None, 1706745600, 1706745600]


def test_request_parsing(spark):
    df = spark.createDataFrame([('{"text": "hi", "importance": 0.5}',), ("no json",), ('{"text": "' + "x" * 200 + '"}',), (None,)], "body string")
    assert [r["text"] for r in store.parse_request(df, max_bytes=100).collect()] == ["hi"]


def test_crawl_dataset_settings(spark, tmp_path):
    (tmp_path / "n/deep").mkdir(parents=True)
    (tmp_path / "n/a.md").write_text("# Title\nüber")
    (tmp_path / "n/deep/b.txt").write_text("plain")
    (tmp_path / "n/c.bin").write_text("no")
    got = {r["source_file"]: (r["hierarchy_path"], r["text"]) for r in files.crawl(spark, str(tmp_path / "n")).collect()}
    assert got == {"/a.md": ("", "# Title\nüber"), "/deep/b.txt": ("/deep", "plain")}
    assert files.crawl(spark, str(tmp_path / "n"), ("md",), max_bytes=9).first()["text"] == "# Title\n"
    (tmp_path / "d.json").write_text(json.dumps({"dimension": 2, "memories": [{"id": "a", "text": "t", "vector": [1, 0]}], "queries": [{"name": "q", "vector": [1, 0], "expected_top1": "a"}]}))
    m, q = files.dataset(spark, str(tmp_path / "d.json"))
    assert m.first()["id"] == "a" and q.first()["expected_top1"] == "a"
    files.write_json(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    (tmp_path / "s.yaml").write_text("mode: 3  # rerank\nlimit: 5\nscopes: [global, a]\nother: x\n")
    s = files.load_settings(str(tmp_path / "s.yaml"))
    assert (s.mode, s.limit, s.scopes, s.reranks, s.uses_vectors) == (3, 5, ("global", "a"), True, True)


CAP = "message_id string, text string, role string, platform string, url string, timestamp long"


def test_capture(spark):
    df = spark.createDataFrame([("1", "a long message", "user", "p", "u", 1000), ("2", " a long message ", "user", "p", "u", 2500), ("3", "short", "user", "p", "u", 3000), ("4", "another long one", "user", "p", None, 60_000), ("5", None, "user", "p", "u", 1)], CAP)
    m = capture.fingerprinted(capture.messages(df))
    assert {r["message_id"] for r in m.collect()} == {"1", "2", "4"}
    assert {r["message_id"] for r in capture.deduplicated(m).collect()} == {"1", "4"}
    assert sorted(r["messages"] for r in capture.sessions(m).collect()) == [1, 2]
    row = capture.memory_rows(m).filter("id = '1'").first()
    assert row["scope"] == "browser:p" and row["timestamp"] == 1 and json.loads(row["metadata"])["messageId"] == "1"
    assert sorted(r["message_id"] for r in capture.bounded_queue(m, 1).collect()) == ["4"]
    assert sum(r["messages"] for r in capture.rates(m, "1 minute", "30 seconds").collect()) == 6


def test_stream_dedup_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"message number {i % 7} here", "user", "p", "u", 1_000 * i) for i in range(40)], CAP)
    df.write.parquet(str(tmp_path / "in"))
    stream = capture.fingerprinted(capture.messages(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    out = capture.run_once(capture.deduplicated_stream(stream), str(tmp_path / "job"))
    assert out.count() == capture.deduplicated(capture.fingerprinted(capture.messages(df))).count() == 7


def test_stream_ingest(spark, tmp_path):
    df = spark.createDataFrame([("1", "a long message", "user", "p", "u", 1000)], CAP)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    q = capture.ingest(capture.memory_rows(capture.messages(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))), lambda rows, batch: seen.append((batch, rows.count())), str(tmp_path / "state"))
    q.awaitTermination()
    assert seen == [(0, 1)]


def test_quality(spark):
    texts = ["I don't have any information", "Do you remember me?", "hello", "The plan is ready", None, "为什么不行"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(quality.noise_kind(F.col("t"))).collect()] == ["denial", "meta", "small_talk", None, None, "meta"]
    assert [r[0] for r in df.select(quality.retrieval_decision(F.col("t"))).collect()] == ["search", "force", "skip", "search", "skip", "force"]
    urls = spark.createDataFrame([("https://a.b.example.co.uk/x",), ("http://docs.site.org:80/",), ("nope",), (None,)], "u string")
    assert [r[0] for r in urls.select(quality.site_scope(F.col("u"))).collect()] == ["example.co.uk", "site.org", None, None]
    imp = spark.createDataFrame([("x" * 501 + "```" + "c" * 60 + "```", "assistant"), ("a", "user")], "t string, r string")
    assert [round(r[0], 2) for r in imp.select(quality.importance_heuristic(F.col("t"), F.col("r"))).collect()] == [0.9, 0.5]


def test_evaluation(spark):
    cases = spark.createDataFrame([("q1", "s_one", ["Alpha"], 1, 1, 2, "/p"), ("q2", "s_two", ["x"], 1, 1, 2, None)], "query_id string, name string, expected_terms array<string>, min_results int, topk_relevant int, k int, path string")
    docs = spark.createDataFrame([("a", "has ALPHA", "/p/q"), ("b", "none", None)], "id string, text string, hierarchy_path string")
    res = spark.createDataFrame([("q1", "a", 1, 0.9), ("q1", "b", 2, 0.1)], "query_id string, id string, rank int, score double")
    got = {r["query_id"]: (r["results"], r["relevant"], r["precision"], r["passed"]) for r in evaluation.precision(res, docs, cases).collect()}
    assert got == {"q1": (2, 1, 0.5, True), "q2": (0, 0, 0.0, False)}
    assert evaluation.suites(evaluation.precision(res, docs, cases)).first()["pass_rate"] == 0.5
    s = evaluation.scenario(res, docs, cases).first()
    assert (s["in_path"], s["full_match"], s["partial_match"], s["best"]) == (1, 1, 0, 0.9)


def test_ingest_and_modes(spark, tmp_path):
    from sievelake.operators import retrieval

    (tmp_path / "a.md").write_text("# Alpha\nThe alpha server keeps records.\n# Beta\nThe beta cache drops rows.")
    (tmp_path / "b.txt").write_text("Gamma explains everything else.")
    got = retrieval.ingest_rows(files.crawl(spark, str(tmp_path)), 5, 50, 1).persist()
    assert got.count() == 3 and got.select("id").distinct().count() == 3
    assert {r["hierarchy_path"]: r["hierarchy_level"] for r in got.collect()} == {"/a.md/Alpha": 2, "/a.md/Beta": 2, "/b.txt/chunk_0": 2}
    v = got.select("id", "vector")
    q = got.filter("text LIKE '%alpha%'").select(F.lit(1).alias("query_id"), F.lit("alpha").alias("query"), F.lit("").alias("path"), "vector")
    for mode in (1, 2, 3):
        first = retrieval.retrieve(q, got, v, files.Settings(mode=mode, limit=2, dim=64)).filter("rank = 1").join(got.select("id", "text"), "id").first()
        assert "alpha" in first["text"]
    assert retrieval.retrieve(q, got, v, files.Settings(mode=2, dim=64, scopes=("none",))).count() == 0
    both = q.unionByName(q.select(F.lit(2).alias("query_id"), "query", F.lit("/a.md").alias("path"), "vector"))
    assert {r["query_id"] for r in retrieval.route(both, got.withColumn("ts", F.col("timestamp")), v, files.Settings(dim=64), 5).collect()} == {1, 2}


def test_writes_are_whole(spark, tmp_path, monkeypatch):
    """A write that fails before its version is out leaves nothing to be read, in the tables or the index; deletions reach all three."""
    db = store.MemoryStore(spark, str(tmp_path / "db"), dim=2, now=1_700_000_000)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, text string, scope string, vector array<float>")
    found = lambda q: {r["id"] for r in db.search(query=q).collect()}
    db.insert(rows(("a", "alpha beta", "global", [1.0, 0.0]), ("b", "beta gamma", "global", None), (None, "delta", "global", [0.0, 1.0])))
    assert found("beta") == {"a", "b"} and found('"alpha beta"') == {"a"} and found("C++") == set()
    ids = {r["id"] for r in db.memories().collect()}
    assert len(ids) == 3 and {r["memory_id"] for r in db.vectors().collect()} <= ids
    with monkeypatch.context() as m:
        m.setattr(db, "_publish", lambda version: (_ for _ in ()).throw(OSError("lost")))
        for write in (lambda: db.insert(rows(("x", "alpha", "global", None))), lambda: db.delete(spark.createDataFrame([("a",)], "id string"))):
            with pytest.raises(OSError):
                write()
    assert found("alpha") == {"a"} and db.get("x").count() == 0
    db.insert(rows(("c", "alpha", "global", None)))
    assert found("alpha") == {"a", "c"}
    db.delete(spark.createDataFrame([("a",)], "id string"))
    assert found("alpha") == {"c"} and db.vectors().filter("memory_id = 'a'").count() == 0
    db.update(rows(("b", "alpha omega", "global", None)))
    assert found("alpha") == {"b", "c"} and found("gamma") == set()
    db.compact()
    assert found("alpha") == {"b", "c"} and store.MemoryStore(spark, str(tmp_path / "db"), dim=2).memories().count() == 3
    assert db.insert_json('[{"id": "j", "text": "json alpha", "scope": "global"}]') == '{"inserted": 1}'
    assert db.delete_json('["c"]') == '{"deleted": 1}' and found("alpha") == {"b", "j"}


def test_unreadable_tables_raise(spark, tmp_path):
    """Only a missing table counts as empty."""
    from sievelake.operators.posting_index import PostingIndex

    (tmp_path / "ix" / "docs").mkdir(parents=True)
    (tmp_path / "ix" / "docs" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        PostingIndex(spark, str(tmp_path / "ix")).docs().count()
    assert PostingIndex(spark, str(tmp_path / "none")).docs().count() == 0
