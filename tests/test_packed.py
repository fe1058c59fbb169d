import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chronocount.operators.packed import NAME_DELIMITERS, NONE_WORDS, REFERENCE_DELIMITERS, explode_packed, split_packed


def split(spark, rows, delimiters=NAME_DELIMITERS):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r["v"] for r in df.select("i", split_packed("s", delimiters).alias("v")).orderBy("i").collect()]


def test_forms(spark):
    cases = {
        "['A1', 'B2']": ["A1", "B2"], '"A" and \'B\' and C': ["A", "B", "C"], '"A ""x"" y"; B, "C7"': ['A "x" y', "B", "C7"],
        "A | B,C | D": ["A", "B", "C", "D"], "{A ,B}": ["A", "B"], " 0;nan;A;None": ["A"], '"A/B locus"/C': ["A/B locus", "C"], '""; A': ["A"],
        '"a, b" "c"': ["a, b", "c"], "A;A": ["A", "A"], "don't; x": ["don't", "x"], "(a b)": ["a", "b"], ",,": [], "   ": [], "<1>;'q;r'": ["<1>", "q;r"],
    }
    assert split(spark, cases) == list(cases.values())
    assert split(spark, [None, ""]) == [[], []]


def test_references(spark):
    cases = {'"10.9/a(4)1;2-B";10.9/b': ["10.9/a(4)1;2-B", "10.9/b"], "91 / PMID:9,10.9/a": ["91", "PMID:9", "10.9/a"], "a\tb\nc": ["a", "b", "c"], "a / / b": ["a", "b"], '"N, vol. 1 | fig. 2", 1': ["N, vol. 1 | fig. 2", "1"]}
    assert split(spark, cases, REFERENCE_DELIMITERS) == list(cases.values())


def test_very_long_field(spark):
    assert [len(v) for v in split(spark, ["; ".join(f"'v {i}'" for i in range(5000))])] == [5000]


_value = st.text("abcXYZ01 ,;'\"|/", min_size=1, max_size=8).map(str.strip).filter(lambda v: v and v.lower() not in NONE_WORDS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(_value, min_size=1, max_size=6), min_size=20, max_size=20))
def test_quoting_round_trip(spark, rows):
    packed = ["; ".join('"' + v.replace('"', '""') + '"' for v in r) for r in rows]
    assert split(spark, packed) == rows


def test_explode(spark):
    df = spark.createDataFrame([(1, "A;B", "x"), (1, "A;B", "y"), (2, None, "z"), (None, "C", "z")], "combo_id bigint, ko string, item string")
    got = {tuple(r) for r in explode_packed(df, "combo_id", {"ko": NAME_DELIMITERS}).collect()}
    assert got == {("ko", 1, 2, 1, "A"), ("ko", 1, 2, 2, "B"), ("ko", None, 1, 1, "C")}
    assert explode_packed(df.limit(0), "combo_id", {"ko": NAME_DELIMITERS}).count() == 0
    assert explode_packed(df, "combo_id", {"ko": NAME_DELIMITERS}, distinct=False).count() == 5


def test_no_delimiter_is_left(spark):
    out = split(spark, ["a,b;c|d/e&f+g h and i\tj"])[0]
    assert out == list("abcdefghij") and not any(re.search(NAME_DELIMITERS, v) for v in out)
