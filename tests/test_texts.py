"""Sentences, tokens, headings, chunks, summaries."""

import pytest
from pyspark.sql import functions as F

from sievelake.functions import text as tx
from sievelake.functions.embed import embed_udf, hashed_vectors
from sievelake.operators import chunking, summaries


@pytest.mark.parametrize(
    "text,n",
    [("这是第一句话。这是第二句话！这是第三句话？", 3), ("One here. Two here! Three?", 3), ("Hello there. 你好。Again!", 3), ("", 0), (None, 0), ("no end here", 1), ("Dr. Smith came.", 1), ("It is 3.14 now.", 1), ("See example.com now.", 1), ("The U. S. did it.", 1), ("Wait… what", 2), ("a…b", 1), ('He said "no!" Then left.', 2), ('He said "no." Then left.', 1)],
)
def test_sentences(text, n):
    assert len(chunking.split_sentences(text)) == n


def test_sentences_keep_marks():
    assert chunking.split_sentences("这是第一句。」 好") == ["这是第一句。」", "好"]
    assert "".join(chunking.split_sentences("A b. C d! E")) == "A b.C d!E"


def test_token_estimate(spark):
    cases = {"": 0, "hello world": 2, "这是一个测试": 9, "Hello 世界 test 你好": 8, "这是第一句话。": 10}
    r = spark.range(1).select(*[tx.token_estimate(F.lit(t)) for t in [*cases, None]]).first()
    assert list(r) == [*cases.values(), 0]


def test_headings(spark):
    text = "Intro here.\n# Chapter 1\nbody one\n## Section 1.1\nbody two\n# Chapter 2\nlast"
    docs = spark.createDataFrame([(1, text), (2, "Not a #heading"), (3, "")], "doc_id int, text string")
    got = [(r["doc_id"], r["at"], r["title"], r["content"]) for r in chunking.sections(docs).orderBy("doc_id", "at").collect()]
    assert got == [(1, 0, "", "Intro here."), (1, 1, "Chapter 1", "body one"), (1, 2, "Section 1.1", "body two"), (1, 3, "Chapter 2", "last"), (2, 0, "", "Not a #heading"), (3, 0, "", "")]
    assert spark.range(1).select(tx.heading_title(F.lit("  ## Title  "))).first()[0] == "Title"


def test_paragraph_pack(spark):
    r = spark.range(1).select(*[tx.pack_paragraphs(F.lit(t), 5) for t in ("one two\n\nthree four\n\nfive six\n\n\n\nseven", "a b c d e f g h i j", "", None)]).first()
    assert r[0] == ["one two\n\nthree four", "five six\n\nseven"]
    assert list(r[1:]) == [["a b c d e f g h i j"], [], []]


def test_smart_split(spark):
    para = "word " * 120
    docs = spark.createDataFrame([(1, "# A\n" + "\n\n".join([para] * 6) + "\n# B\ntiny", "/d"), (2, "plain", "/e"), (3, None, "/f"), (4, "# only\n", "/g")], "doc_id int, text string, base string")
    rows = chunking.smart_split(docs).orderBy("doc_id", "chunk_index").collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert [r["chunk_index"] for r in one] == list(range(len(one))) and len(one) >= 2
    assert all(r["token_count"] <= 768 for r in rows) and one[-1]["content"].endswith("tiny")
    assert {r["hierarchy"] for r in one} == {"/d/A"}
    assert [r["hierarchy"] for r in rows if r["doc_id"] == 2] == ["/e/chunk_0"]
    assert {r["doc_id"] for r in rows} == {1, 2}


def test_boundaries_and_segments(spark):
    d = [0.0] * 14
    d[4] = d[9] = 1.0
    arr = lambda x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")
    r = spark.range(1).select(
        chunking.boundaries(arr(d)), chunking.boundaries(arr([1, 1])), chunking.boundaries(arr([])),
        chunking.segments(F.array(*map(F.lit, "ABCDEF")), F.array(F.lit(2), F.lit(4))), chunking.segments(F.array(F.lit("A")), F.array(F.lit(0))),
    ).first()
    assert list(r) == [[4, 9], [], [], ["A B C", "D E", "F"], ["A"]]


def test_semantic_split(spark):
    topics = ["red apple pie. " * 1, "blue ocean wave. ", "green forest tree. "]
    text = "".join(t * 6 for t in topics)
    docs = spark.createDataFrame([(1, text), (2, "One. Two."), (3, "")], "doc_id int, text string")
    rows = chunking.semantic_split(docs).orderBy("doc_id", "segment").collect()
    assert [r["doc_id"] for r in rows] == [1, 1, 1, 2]
    assert "blue" in rows[1]["content"] and "red" not in rows[1]["content"]


def test_overlap(spark):
    docs = spark.createDataFrame([(1, "A b. C d. E f. G h. I j."), (2, "x"), (3, None)], "doc_id int, text string")
    got = [(r["doc_id"], r["content"]) for r in chunking.overlapping(docs, 3, 1).orderBy("doc_id", "window").collect()]
    assert got == [(1, "A b. C d. E f."), (1, "E f. G h. I j."), (2, "x")]


def test_summaries(spark):
    cases = {"这是第一句。后面还有更多。": "这是第一句。", "First sentence. More text.": "First sentence.", "no end at all": "no end at all", "v1.2 is out now": "v1.2 is out now", "": ""}
    r = spark.range(1).select(*[tx.l0_by_rule(F.lit(t)) for t in cases]).first()
    assert list(r) == list(cases.values())
    assert len(spark.range(1).select(tx.l0_by_rule(F.lit("a" * 200))).first()[0]) == 80
    assert summaries.overview("一。" * 9).count("。") == 5
    assert summaries.overview("x" * 2000) == "x" * 500 and summaries.overview(None) == "" and summaries.overview("你" * 400) == "你" * 167
    assert spark.range(1).select(tx.first_characters(F.lit("你好世界"), 2)).first()[0] == "你好"


def test_summary_cache_and_client(spark):
    docs = spark.createDataFrame([("1", "One. Two."), ("2", "One. Two."), ("3", None)], "id string, text string")
    keys = spark.range(1).select(summaries.content_key(F.lit("One. Two."), 0).alias("key"), F.lit("cached").alias("summary"), summaries.content_key(F.lit("One. Two."), 1).alias("other"))
    assert keys.first()["key"] != keys.first()["other"]
    got = {r["id"]: (r["abstract"], r["overview"]) for r in summaries.summarized(docs, keys.select("key", "summary")).collect()}
    assert got == {"1": ("cached", "One. Two."), "2": ("cached", "One. Two."), "3": ("", "")}

    def client(t):
        if "One" in t:
            raise OSError
        return "model"

    assert {r["text"]: r["summary"] for r in summaries.summarize_with(docs, client, retries=1, pause=0).collect()} == {"One. Two.": "One. Two.", "": "model"}


def test_embedder(spark):
    df = spark.createDataFrame([("hello world",), ("world hello",), (None,)], "t string").select(embed_udf()("t").alias("v"))
    a, b, c = [r["v"] for r in df.collect()]
    assert a == b and not any(c)
    assert abs((hashed_vectors(["x y"]) ** 2).sum() - 1) < 1e-9
