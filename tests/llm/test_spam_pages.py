import random

from sievelake.llm import spam_pages as sp

RNG = random.Random(7)
NOUNS = "server index cache record window query vector token bucket report schema ledger memory shard cursor journal policy folder".split()
VERBS = "keeps stores moves checks merges drops writes splits reads counts ranks trims".split()


def sentence():
    return f"The {RNG.choice(NOUNS)} of the {RNG.choice(NOUNS)} {RNG.choice(VERBS)} every {RNG.choice(NOUNS)} after {RNG.randrange(900)} {RNG.choice(NOUNS)}s, so the {RNG.choice(NOUNS)} {RNG.choice(VERBS)} it again."


def prose(n):
    return " ".join(sentence() for _ in range(n))


def url():
    return f"https://{RNG.choice(NOUNS)}{RNG.randrange(99)}.example/{RNG.choice(NOUNS)}/{RNG.choice(VERBS)}?id={RNG.randrange(9999)}"


PROSE = {i: prose(12) for i in range(30)}
SPAM = {
    100: "cheap cache, buy cache, " * 60, 101: "\n".join(url() for _ in range(30)), 102: " ".join(f'<a href="{url()}">{RNG.choice(NOUNS)} here</a><br>' for _ in range(20)),
    103: " ".join(f"#{RNG.choice(NOUNS)}{RNG.choice(NOUNS)}" for _ in range(120)), 104: "\n".join(f"ABC-{RNG.randrange(9999)}\nwindow cache\nsize M" for _ in range(40)),
    105: prose(2) + "\n\n" + "best price server, free server, " * 40, 106: "便宜缓存价格，下载缓存推荐，" * 40,
}
FINE = {
    200: "\n".join(f"* [{RNG.choice(NOUNS)}]({url()}) - {sentence()}" for _ in range(10)), 201: prose(12) + "\n\nReferences:\n" + "\n".join(f"- {url()}" for _ in range(4)),
    202: "\n".join(f"2024-01-{RNG.randrange(10, 28)} 10:{RNG.randrange(10, 59)} INFO {RNG.choice(NOUNS)} {RNG.choice(VERBS)} {RNG.choice(NOUNS)} in {RNG.randrange(900)} ms" for _ in range(40)),
    203: "\n".join(f"{RNG.choice(NOUNS)}_{RNG.choice(NOUNS)}: {RNG.randrange(999)}" for _ in range(40)), 204: prose(10) + "\n\n" + " ".join(f"#{w}" for w in NOUNS[:8]),
    205: "| name | count |\n" + "\n".join(f"| {RNG.choice(NOUNS)} | {RNG.randrange(999)} |" for _ in range(40)), 206: "", 207: None, 208: "short",
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, RNG.choice(["en", "EN ", None, "e"]), 0.0, 0) for i, t in rows.items()], "doc_id long, text string, lang string, ratio double, chars int")


def test_pages(spark):
    got = {r["doc_id"] for r in sp.stuffed_pages(frame(spark, PROSE | SPAM | FINE)).collect()}
    assert got == set(SPAM)


def test_shares_and_empty(spark):
    got = {r["doc_id"]: r for r in sp.scored_pages(frame(spark, FINE | SPAM)).collect()}
    assert set(got) == set(SPAM) | {i for i, t in FINE.items() if t}
    assert all(r["chars"] == len((FINE | SPAM)[i]) for i, r in got.items())
    assert sp.stuffed_pages(frame(spark, SPAM).limit(0)).count() == 0


def test_blocks_are_the_text():
    for t in [*PROSE.values(), *SPAM.values(), *filter(None, FINE.values()), "x" * 5000, "\n" * 500, "a\n\nb"]:
        assert "".join(sp.blocks(t)) == t
        assert all(len(b) <= 2 * sp.BLOCK for b in sp.blocks(t))


def test_ordered_link_lists(spark):
    """The numbers of a list's items are no record's numbers; those of a numbered log or table are."""
    marks = ("1.", "{}.", "{})", "[{}]", "({})", "- {}.")
    lists = {300 + k: "\n".join(f"{m.format(i + 1)} [{RNG.choice(NOUNS)} {RNG.choice(NOUNS)}]({url()})" for i in range(30)) for k, m in enumerate(marks)}
    records = {
        400: "\n".join(f"[{i + 1}] 10:{RNG.randrange(10, 59)}:{RNG.randrange(10, 59)} INFO {RNG.choice(NOUNS)} {RNG.choice(VERBS)} {RNG.randrange(900)} ms" for i in range(40)),
        401: "\n".join(f"{i + 1}. {RNG.choice(NOUNS)} | {RNG.randrange(999)} | {RNG.randrange(99)}" for i in range(40)),
        402: "\n".join(f"{RNG.randrange(99)}.{RNG.randrange(99)} {RNG.choice(NOUNS)} {RNG.randrange(99)}" for _ in range(60)),
    }
    got = {r["doc_id"] for r in sp.stuffed_pages(frame(spark, PROSE | lists | records)).collect()}
    assert got == set(lists)


def test_the_ratio_decides(spark, monkeypatch):
    """Without the compression test logs, tables and configuration are reported; without the sentences' test nothing else is."""
    rows = frame(spark, PROSE | SPAM | FINE).cache()
    monkeypatch.setattr(sp, "REDUNDANT", 99.0)
    assert {r["doc_id"] for r in sp.stuffed_pages(rows).collect()} >= set(SPAM) | {202, 203, 205}
    rows.unpersist()


def test_hot_repeated_and_clashing(spark):
    """A text under many ids, a repeated row, a very long text and columns with the names used inside."""
    many = [(1000 + i, SPAM[100], "en", 0.5, 1) for i in range(60)] + [(1, PROSE[0] * 300, "en", 0.5, 1), (2, SPAM[106] * 300, "zh", 0.5, 1)] + [(10 + i, t, "en", 0.5, 1) for i, t in PROSE.items()]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, ratio double, size_class int")
    assert {r["doc_id"] for r in sp.stuffed_pages(df).collect()} == {1000 + i for i in range(60)} | {2}
