from hypothesis import given
from hypothesis import strategies as st

from chronocount.llm.lookalike import common_form, look_alike_classes, look_alike_pairs, seen, text_forms


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form_key string, n_chars int")
    return {tuple(r) for r in look_alike_pairs(look_alike_classes(text_forms(df, "doc_id", "text"))).collect()}


def rows(*texts):
    return [(i, t, "clash", 1) for i, t in enumerate(texts)]


def test_what_a_reader_sees():
    assert seen("Ｔｅｓｔ　１") == "Test 1" and seen("с​оре") == "cope" and seen("é") == "é" == seen("е́")
    assert seen("x²") == "x²" != seen("x2") and seen("A") != seen("a") and seen("é") != seen("e") and seen("a  b") != seen("a b")
    assert seen("ﬁt") == "fit" and seen("Ω") == seen("Ω") and seen("non‑x") == "non-x" and seen("a b") == "a b"


def test_common_form():
    assert common_form("STRASSE ²") == common_form("straße 2") and common_form("a\nb") == "a b"


@given(st.text(st.sampled_from("aàéÉßſµμΩΩеЕоОıİﬁ²½℃½ \u00a0\u200b\u0301\u034f\u0323ǅ한ﾊﾞ𝐀Ａ\n\r"), max_size=12))
def test_what_looks_the_same_has_one_common_form(text):
    assert common_form(seen(text)) == common_form(text) and common_form(common_form(text)) == common_form(text)


def test_pairs(spark):
    got = pairs(spark, rows("Test one", "Tеst one", "Test one", "test one", "x²", "x2", "x２"))
    assert got == {(0, 1), (1, 2), (5, 6)}


def test_edge_cases(spark):
    assert pairs(spark, rows(None, "", "   ", "​", " ")) == set()
    long = "w\u00f6rd " * 200_000
    assert pairs(spark, rows(long, long.replace("r", "\u0433"), long.replace("\u00f6", "o\u0308"))) == {(0, 2)}
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert text_forms(df, "doc_id", "text").count() == 0


def test_a_hot_text(spark):
    got = pairs(spark, rows(*["same text"] * 50, "samе text"))
    assert got == {(i, 50) for i in range(50)}
