"""Cases with known results: vectors, full text, fusion, scoring, paths, trees, reranking."""

import math
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievelake.functions import scoring, text as tx, vectors as vx
from sievelake.operators import fulltext, fusion, path_search, quality, rerank, tree_search, vector_search
from sievelake.operators.posting_index import PostingIndex


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x]).cast("array<float>")


def test_vector_expressions(spark):
    nul = F.lit(None).cast("array<float>")
    r = one(
        spark, vx.cosine(vec(1, 0), vec(1, 0)), vx.cosine(vec(1, 0), vec(0, 1)), vx.cosine(vec(1, 0), vec(-1, 0)), vx.cosine(vec(0, 0), vec(1, 0)), vx.cosine(vec(1), vec(1, 0)),
        vx.cosine(nul, vec(1)), vx.normalize(vec(3, 4)), vx.normalize(vec(0, 0)), vx.dot(vec(1, 2), vec(3, 4)), vx.usable(vec(1, float("nan")), 2), vx.usable(nul, 2), vx.usable(vec(0, 0), 2), vx.usable(vec(0, 1), 2),
    )
    assert [round(x, 6) for x in r[:6]] == [1, 0, -1, 0, 0, 0]
    assert [round(x, 6) for x in r[6]] == [0.6, 0.8] and r[7] == [0, 0] and r[8] == 11
    assert list(r[9:]) == [False, False, False, True]


def test_dequantize_and_codec(spark):
    r = one(spark, vx.dequantize(F.array(F.lit(228), F.lit(128))), vx.from_bytes(F.lit(b"abc")), vx.from_bytes(vx.to_bytes(vec(1.5, -2))))
    assert r[0] == [1, 0] and r[1] is None and r[2] == [1.5, -2]


ROWS = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.7, 0.7, 0.0]), ("bad", None), ("short", [1.0]), ("zero", [0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0])]


def test_vector_topk(spark):
    rows = spark.createDataFrame(ROWS, "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None)], "query_id int, vector array<float>")
    got = [(r["id"], r["score"]) for r in vector_search.vector_topk(q, rows, 3, 2).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("c", 0.707107)]
    assert vector_search.vector_topk(q.limit(0), rows, 3, 2).count() == 0
    assert vector_search.vector_topk(q, rows.limit(0), 3, 2).count() == 0


def test_vector_ties_by_id(spark):
    rows = spark.createDataFrame([(f"r{i}", [1.0, 1.0]) for i in range(9)], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<float>")
    assert [r["id"] for r in vector_search.vector_topk(q, rows, 2, 3).orderBy("rank").collect()] == ["r0", "r1", "r2"]


TEXTS = ["Go 语言很强大", "Python fits data analysis", "Go fits, go wins; Go", "", None, "data data data", "analysis of data in Go", "unrelated words here", "more unrelated text", "nothing else"]


def test_bm25_matches_fts5(spark):
    plain = [(i, t) for i, t in enumerate(TEXTS) if t and t.isascii()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61 remove_diacritics 0')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i + 1, t) for i, t in plain])
    docs = spark.createDataFrame([(str(i), t) for i, t in plain], "id string, text string")
    for q in ("data", "go fits", "unrelated", "go data analysis", "absent"):
        want = {str(i - 1): -r for i, r in db.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (q,))}
        got = {r["id"]: r["score"] for r in fulltext.bm25(docs, spark.createDataFrame([(1, q)], "query_id int, query string")).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[i], max(want[i], 0), abs_tol=1e-9) for i in want)


def test_bm25_nulls_and_phrases(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("id", F.col("id").cast("string"))
    q = spark.createDataFrame([(1, "data analysis"), (2, "语言"), (3, ""), (4, None)], "query_id int, query string")
    assert {(r["query_id"], r["id"]) for r in fulltext.bm25(docs, q).collect()} == {(1, "1"), (1, "6"), (2, "0")}
    assert {(r["query_id"], r["id"], r["starts"]) for r in fulltext.phrase_hits(docs, q).collect()} == {(1, "1", 1), (2, "0", 1)}
    assert fulltext.bm25(docs.limit(0), q).count() == 0
    assert {r["term"]: (r["df"], r["cf"]) for r in fulltext.term_stats(docs).collect()}["data"] == (3, 5)


@pytest.mark.parametrize("raw,out", [("", '""'), ("AND", '"AND"'), ("C++", '"C++"'), ('say "hi"', '"say ""hi"""'), ("a AND b", '"a AND b"'), ("the or of", "the or of")])
def test_escape_query(raw, out):
    assert tx.escape_query(raw) == out


def test_escape_like():
    assert tx.escape_like("a_b%c\\d") == "a\\_b\\%c\\\\d"


def lists(spark, rows):
    return spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate(rows)], "query_id int, id string, score double, rank int")


def test_boost_fusion(spark):
    v, t = lists(spark, [("a", 0.95), ("b", 0.5), ("n", -0.2)]), lists(spark, [("a", 3.0), ("n", 2.0), ("x", 1.5)])
    got = {r["id"]: r["score"] for r in fusion.boost_fusion(v, t, 10).collect()}
    assert got == {"x": 1.5, "a": 1.0, "b": 0.5, "n": -0.23}


def test_rrf(spark):
    out = fusion.rrf([lists(spark, [("a", 1.0), ("b", 0.9), ("c", 0.8)]), lists(spark, [("b", 1.0), ("d", 0.9)])], ["query_id"])
    got = {r["id"]: round(r["score"], 6) for r in out.collect()}
    assert got == {"b": 0.032522, "a": 0.016393, "d": 0.016129, "c": 0.015873}


def test_scoring(spark):
    now = 1_700_000_000
    rows = [("1", 0.8, now - 86400, 0.9, "x" * 9), ("2", 0.7, now - 30 * 86400, 0.5, "x" * 1027), ("3", 0.5, None, None, None)]
    df = spark.createDataFrame(rows, "id string, score double, ts long, importance double, text string")
    out = {r["id"]: r["score"] for r in scoring.apply_scoring(df, now, scoring.ScoringConfig(14, 0.1, 500, 0.35)).collect()}
    assert round(out["1"], 6) == 0.866313 and "2" not in out
    assert round(out["3"], 6) == round(0.6 * 0.91, 6)


def test_paths(spark):
    r = one(spark, *[tx.path_levels(F.lit(p)) for p in ("/project/src/auth", "", "/", None)])
    assert list(r) == [["/project", "/project/src", "/project/src/auth"], [], ["/"], []]
    q = spark.createDataFrame([(1, "/project/src/auth")], "query_id int, path string")
    assert [round(r["weight"], 2) for r in path_search.query_levels(q).orderBy("level").collect()] == [0.64, 0.8, 1.0]
    d = spark.createDataFrame([("1", "/project/src"), ("2", "/project/src2"), ("3", "/a_b/100%"), ("4", None), ("5", "/")], "id string, hierarchy_path string")
    under = {(r["id"], r["level"]) for r in path_search.under_level(d).collect()}
    assert under == {("1", "/project"), ("1", "/project/src"), ("2", "/project"), ("2", "/project/src2"), ("3", "/a_b"), ("3", "/a_b/100%"), ("5", "/")}


def test_path_search_fallback(spark):
    docs = spark.createDataFrame([("in", "alpha beta", "/p/q", 0.7, None), ("near", "alpha", "/p", 0.7, None), ("out", "alpha", "/z", 0.7, None), ("loose", "alpha", None, 0.7, None)], "id string, text string, hierarchy_path string, importance double, ts long")
    vecs = spark.createDataFrame([("in", [1.0, 0.0]), ("near", [0.9, 0.1]), ("out", [1.0, 0.0]), ("loose", [0.0, 1.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, "alpha", "/p/q", [1.0, 0.0]), (2, "alpha", "/p/q", None)], "query_id int, query string, path string, vector array<float>")
    got = {(r["query_id"], r["id"]): r["source"] for r in path_search.path_search(q, docs, vecs, 2, 5, 1_700_000_000).collect()}
    assert set(got) == {(1, "in"), (1, "near"), (2, "in"), (2, "near"), (2, "loose"), (1, "loose")}
    assert got[(2, "loose")] == "global" and got[(1, "in")] == "level"


def test_tree_chain(spark):
    cfg = tree_search.TreeConfig(max_depth=2)
    nodes = pd.DataFrame([("root", None, 0.970143, True), ("c1", "root", 0.919145, False), ("c2", "c1", 0.8, False), ("c3", "c2", 0.9, False)], columns=["id", "parent", "own", "seed"])
    got = dict(tree_search.best_first(nodes, cfg).itertuples(index=False))
    assert set(got) == {"root", "c1", "c2"}
    assert math.isclose(got["c1"], 0.7 * 0.919145 + 0.3 * 0.970143 * 0.9)
    assert math.isclose(got["c2"], 0.7 * 0.8 + 0.3 * got["c1"] * 0.81)


def test_tree_least_score_and_loop(spark):
    nodes = pd.DataFrame([("a", "b", 0.9, True), ("b", "a", 0.2, False), ("k", "b", 0.9, False)], columns=["id", "parent", "own", "seed"])
    got = dict(tree_search.best_first(nodes, tree_search.TreeConfig()).itertuples(index=False))
    assert set(got) == {"a", "b", "k"}
    nodes["own"] = [0.2, 0.2, 0.9]
    assert set(tree_search.best_first(nodes, tree_search.TreeConfig())["id"]) == {"a"}


def test_aggregate_by_source(spark):
    rows = [(1, "x1", 0.8, "doc.md", 0, "First"), (1, "x2", 0.9, "doc.md", 1, "Second"), (1, "x3", 0.7, "doc.md", 2, "Third"), (1, "x5", 0.1, "doc.md", 4, "Fifth"), (1, "o", 0.6, None, None, "Other"), (1, "e", 0.5, "", 3, None)]
    df = spark.createDataFrame(rows, "query_id int, id string, score double, source_file string, chunk_index int, abstract string")
    got = {r["id"]: (r["score"], r["chunk_count"], r["abstract"]) for r in tree_search.aggregate_by_source(df).collect()}
    assert got == {"x2": (0.9, 4, "[Part 1] First\n[Part 2] Second\n[Part 3] Third\n... (+1 more chunks)\n"), "o": (0.6, 1, "Other"), "e": (0.5, 1, "")}


def test_rerank_blend(spark):
    b = lambda s, r, ok=True: rerank.blend(F.lit(s), F.lit(r).cast("double"), F.lit(ok))
    got = [round(x, 6) for x in one(spark, b(0.8, 0.95), b(0.7, 0.85), b(0.8, 0.0), b(0.8, None), b(0.8, 0.9, False), rerank.cosine_fallback(F.lit(0.5), F.lit(1.0)))]
    assert got == [0.89, 0.79, 0.4, 0.64, 0.8, 0.65]


def test_rerank_cut_and_remote(spark):
    assert one(spark, rerank.cut_bytes(F.lit("ab语"), 4))[0] == "ab"
    df = spark.createDataFrame([(1, "a", "q", "x"), (1, "b", "q", "y"), (2, "c", "fail", "z")], "query_id int, id string, query string, doc string")

    def client(query, texts):
        if query == "fail":
            raise OSError
        return [(1, 0.5)]

    assert {(r["id"], r["rerank"]) for r in rerank.rerank_remote(df, client).collect()} == {("a", None), ("b", 0.5), ("c", None)}


def test_mmr(spark):
    rows = [(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.99, [1.0, 0.0]), (1, "c", 0.8, [0.0, 1.0])]
    out = quality.mmr(spark.createDataFrame(rows, "query_id int, id string, score double, vector array<float>"), 2, 0.5)
    assert [r["id"] for r in out.orderBy("rank").collect()] == ["a", "c"]


def test_posting_index_follows_writes(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "ix"))
    frame = lambda *r: spark.createDataFrame(list(r), "id string, text string")
    q = spark.createDataFrame([(1, "data"), (2, "go data"), (3, "absent")], "query_id int, query string")
    assert index.search(q).count() == 0

    def same(now):
        got = {(r["query_id"], r["id"]): round(r["score"], 9) for r in index.search(q).collect()}
        want = {(r["query_id"], r["id"]): round(r["score"], 9) for r in fulltext.bm25(now, q).collect()}
        assert got == want and got

    first = frame(("a", "go data data"), ("b", "data here"), ("c", "go on"), ("d", None), ("e", ""), ("f", "unrelated words"))
    index.add(first, 1)
    same(first)
    index.put(frame(("a", "data only"), ("g", "go data")), 2)
    now = frame(("a", "data only"), ("b", "data here"), ("c", "go on"), ("f", "unrelated words"), ("g", "go data"))
    same(now)
    index.remove(frame(("b", "")), 3)
    same(now.filter("id <> 'b'"))
    index = index.compact(str(tmp_path / "ix2"))
    same(now.filter("id <> 'b'"))


def test_whole_queries(spark, tmp_path):
    """A case is asked with all its words, and any run of a passage counts."""
    from sievelake.plans import catalogue

    text = "one two three four five six"
    spark.createDataFrame([("m1", text, 1), ("m2", "x " + text, 1), ("m3", "other", 1)], "id string, text string, timestamp long").write.parquet(f"{tmp_path}/memories.parquet")
    cases = [("c1", "s_1", "x one two", f"zero {text}", ["one"]), ("c2", "s_2", "absent one two", "p q", ["one"])]
    spark.createDataFrame([(*c, 1, 1, 10, "/a") for c in cases], "item_id string, name string, query string, passage string, expected_terms array<string>, min_results int, topk_relevant int, k int, path string").write.parquet(f"{tmp_path}/eval_cases.parquet")
    ask = lambda q: catalogue.QUERIES[q](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["id"]) for r in ask("bm25_topk_whole")} == {("c1", "m2")}
    assert {r["query_id"]: (r["results"], r["passed"]) for r in ask("precision_at_k_whole")} == {"c1": (1, True), "c2": (0, False)}
    assert {(r["query_id"], r["id"]) for r in ask("bm25_phrase_runs")} == {(f"c1#{s}", m) for s in (2, 3) for m in ("m1", "m2")}
