import os

import pytest
from pyspark.sql import functions as F

from sievelake.llm import mixture as mx

DOC = "doc_id long, source string, tokens long"


def setup(spark, n=3000):
    rows = [(i, "big" if i % 3 else "mid", 10) for i in range(n)] + [(10_000 + i, "small", 10) for i in range(60)] + [(20_000, "unlisted", 10)]
    targets = [("big", 0.4, 1), ("mid", 0.5, 2), ("small", 0.09, 3), ("none", 0.01, 5)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_rates(spark):
    tokens, targets = setup(spark)
    got = {r["source"]: r for r in mx.rates(tokens, targets).collect()}
    total = 30_600
    assert got["big"]["rate"] == pytest.approx(0.4 * total / 20_000) and got["big"]["reachable"]
    assert got["small"]["rate"] == 3 and not got["small"]["reachable"]
    assert got["none"]["rate"] == 0 and not got["none"]["reachable"] and "unlisted" not in got


def test_mixture(spark):
    tokens, targets = setup(spark)
    rate = mx.rates(tokens, targets)
    used = mx.mixture(tokens, rate).join(rate.select("source", "rate", "max_repeats"), "source").collect()
    assert all(r["copies"] <= r["max_repeats"] and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in used)
    share = {r["source"]: r for r in mx.reached_shares(tokens, targets).collect()}
    for s in ("big", "mid"):
        assert share[s]["used_tokens"] == pytest.approx(share[s]["rate"] * {"big": 20_000, "mid": 10_000}[s], rel=0.06)
    assert sum(r["actual_share"] for r in share.values()) == pytest.approx(1)
    again = mx.mixture(tokens.repartition(7), rate)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in mx.mixture(tokens, rate).collect()}
    assert {tuple(r) for r in mx.mixture(tokens, rate, seed=5).collect()} != {tuple(r) for r in again.collect()}
    assert mx.expand(again).count() == again.agg(F.sum("copies")).first()[0]


def test_empty(spark):
    tokens, targets = setup(spark)
    assert {r["rate"] for r in mx.rates(tokens.limit(0), targets).collect()} == {0.0}
    assert {r["actual_share"] for r in mx.reached_shares(tokens.limit(0), targets).collect()} == {None}
    assert mx.rates(tokens, targets.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(mx.TOKENIZER), reason="no vocabulary here")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "a", "hello <|endoftext|> world", 1), (2, "a", None, 1), (3, None, "x", 1), (4, "b", "", 1)], "doc_id long, source string, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in mx.token_table(df).collect()}
    assert set(got) == {1, 2, 4} and got[2] == got[4] == 0 and got[1] > 3
    enc = mx._encoding(mx.TOKENIZER)
    for t in ("Über die Brücke", "向量检索 test", "a  b\n\nc" * 50):
        assert enc.decode(enc.encode_ordinary(t)) == t
