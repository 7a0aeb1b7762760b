import pytest

from sievelake.llm import lookalike as lk

SAME = [
    ("Ａｂｃ １２", "Abc 12"), ("café", "café"), ("a​b", "ab"), ("a­b", "ab"), ("a b", "a b"), ("a　b", "a b"), ("co‑op", "co-op"), ("раypal", "paypal"),
    ("ﬁne", "fine"), ("ｶﾞ", "ガ"), ("⼀", "一"), ("ⅼ", "l"), ("Ａ̈", "Ä"), ("ё", "ë"), ("x︎", "x"), ("ệ", "ệ"), ("a‍b", "ab"), ("a\r\nb", "a\nb"), ("Ω", "Ω"),
]
DIFFERENT = [
    ("a", "A"), ("é", "e"), ("2", "²"), ("1", "①"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("a\nb", "a b"), ("a b", "ab"), ("a-b", "ab"), ("n", "ñ"), ("\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f3f4"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_form(a, b):
    assert lk.form(a) == lk.form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_form(a, b):
    assert lk.form(a) != lk.form(b)


def test_form_is_stable():
    for a, b in SAME + DIFFERENT:
        for s in (a, b):
            assert lk.form(lk.shown(lk.form(s))) == lk.form(s)
    assert lk.form(None) is None and lk.form("") == ""


SCHEMA = "id string, text string, abstract string, form string, field int, value int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def pairs(df):
    return {tuple(r) for r in lk.alike_pairs(df, "id", ["text", "abstract"]).collect()}


def brute(rows):
    rows = {r for r in rows if r[0] is not None}
    out = set()
    for i, f in enumerate(("text", "abstract"), 1):
        for a in rows:
            for b in rows:
                if a[0] < b[0] and a[i] and b[i] and a[i] != b[i] and lk.form(a[i]) == lk.form(b[i]):
                    out.add((f, a[0], b[0]))
    return out


def test_pairs(spark):
    rows = [("a", "paypal", None), ("b", "раypal", "x"), ("c", "PAYPAL", "х"), ("d", "paypal", ""), ("a", "paypal", None), ("e", None, None), ("f", "раypal", "y"), (None, "paypal", "x"), ("g", "​", "é"), ("h", "­", "é")]
    rows += [(f"s{i}a", x, None) for i, (x, _) in enumerate(SAME + DIFFERENT)] + [(f"s{i}b", y, None) for i, (_, y) in enumerate(SAME + DIFFERENT)]
    rows += [("long1", "word " * 20000, None), ("long2", "wоrd " * 20000, None)]
    assert pairs(frame(spark, rows)) == brute(rows)


def test_empty_and_nothing_alike(spark):
    assert pairs(frame(spark, [])) == set()
    assert pairs(frame(spark, [("a", "x", None), ("b", "y", None)])) == set()


def test_hot_copies_make_no_pairs(spark):
    rows = [(f"k{i:03}", "same text", None) for i in range(400)] + [("z", "same text", None)]
    assert pairs(frame(spark, rows)) == {("text", f"k{i:03}", "z") for i in range(400)}


def test_canonical(spark):
    rows = [("a", "paypal", None), ("b", "раypal", None), ("c", "\U0001f469‍\U0001f4bb", None), ("d", "\U0001f469\U0001f4bb", "")]
    got = {(r["id"], r["field"]): r["canonical"] for r in lk.canonical_values(frame(spark, rows), "id", ["text", "abstract"]).collect()}
    assert got == {("a", "text"): "paypal", ("b", "text"): "paypal", ("c", "text"): rows[2][1], ("d", "text"): rows[3][1]}


def test_collation_joins_forms(spark):
    """Forms that only the collation holds equal are one class."""
    rows = [("a", "xy", None), ("b", "xy", None), ("c", "aก", None)]
    got = lk.with_class(lk.folded(frame(spark, rows + [("d", "b\u0007c", None), ("e", "bc", None)]), "id", ["text"]))
    key = {r["id"]: r["canonical_key"] for r in got.collect()}
    assert key["d"] == key["e"] and len(key) == 5


def test_canonical_is_a_member(spark):
    """Text of another script stays as a row holds it; of several spellings the clean one, else the smallest digest, stands for all."""
    rows = [
        ("a", "вода сорока", None), ("b", "вода сорока", None), ("c", "Ελλάδα", None), ("d", "x\ue000y", None), ("e", "x\u200dy", None),
        ("f", "\ue141", None), ("g", "\U0001f3f4\U000e0041\U000e007f", None), ("h", "раypal", None), ("i", "pаypal", None), ("j", "co\u2011op", None), ("k", "co-op", None), ("k", "co-op", None),
    ]
    got = {r["id"]: r["canonical"] for r in lk.canonical_values(frame(spark, rows), "id", ["text", "abstract"]).collect()}
    texts = {i: t for i, t, _ in rows}
    assert set(got.values()) <= set(texts.values())
    assert got["a"] == got["b"] and got["h"] == got["i"] and got["j"] == got["k"] == "co-op"
    assert all(got[i] == texts[i] for i in "cdefg")
    classes = {(r["canonical"], r["spellings"], r["ids"]) for r in lk.class_counts(frame(spark, rows), "id", ["text", "abstract"]).collect()}
    assert classes == {(got["a"], 2, 2), (got["h"], 2, 2), ("co-op", 2, 2)}


def test_private_use_characters_stay_apart():
    texts = ["\ue000", "\ue001", "\ue141", "\ue001\ue000", "\U0001f469\u200d\U0001f4bb", "\U0001f469\ue000\U0001f4bb", "\U0001f3f4\U000e0041", "\U0001f3f4\ue141"]
    assert len({lk.form(t) for t in texts}) == len(texts)
    assert all(lk.shown(lk.form(t)) == t for t in texts)
