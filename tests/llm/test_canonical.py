from hypothesis import given
from hypothesis import strategies as st

from chronocount.llm.canonical import match_names, name_tokens, osa_within, repair_tokens, same_name

GENES = [(0, "Stimulus"), (1, "Kewel55"), (2, "Nih6"), (3, "Nih9a"), (4, "Zok8-2"), (5, "LAGRITvaklu"), (6, "Boqgamma"), (7, "Dec6"), (8, "Kewel5-9"), (9, "QIT6C"), (10, "Nih9b"), (11, None)]


def match(spark, values):
    v = spark.createDataFrame([(x, "clash") for x in values], "value string, tokens string")
    g = spark.createDataFrame(GENES, "gene_id int, gene_name string")
    return {r["value"]: r["ref_id"] for r in match_names(v, g, "gene_id", "gene_name").collect()}


def test_tokens():
    assert name_tokens("gene:Kewel5-9 (mouse)") == ["kewel", "5", "9"] and name_tokens("Boq-γ") == ["boqgamma"]
    assert name_tokens("06-Dec") == name_tokens("Dec-06") == name_tokens("6. Dec") == ["dec", "6"]
    assert name_tokens("12345") == [] == name_tokens("?") and name_tokens("X.Nih9a") == ["nih", "9", "a"] and name_tokens("g_QIT6C") == ["qit", "6", "c"]


def osa(a, b):
    """The distance by dynamic programming."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 2))
def test_slips_against_dynamic_programming(a, b, most):
    assert osa_within(a, b, most) == (osa(a, b) <= most)


def test_same_name():
    assert all(osa_within("kewel", b) for b in ("kewel", "kwel", "kkewel", "kexel", "kweel")) and not osa_within("kewel", "kwle")
    assert same_name(["nih", "9", "a"], ["nih", "9", "b"], 16) and not same_name(["nih", "9"], ["nih", "6"], 16)
    assert same_name(["kexelx", "5"], ["kewel", "5"], 6) and not same_name(["kexelx", "5"], ["kewel", "5"], 16)


def test_repairs(spark):
    tokens = spark.createDataFrame([(t,) for t in ("kewel", "kwel", "9", "98", "n", "", None, "abcdefgh", "bacdefhg")], "token string")
    vocabulary = spark.createDataFrame([(t,) for t in ("kewel", "kewell", "9", "abcdefgh")], "known string")
    got = {(r["token"], r["known"]) for r in repair_tokens(tokens, vocabulary, second_slip_from=8).collect()}
    assert got == {("kewel", "kewel"), ("kwel", "kewel"), ("9", "9"), ("abcdefgh", "abcdefgh"), ("bacdefhg", "abcdefgh")}


def test_matches(spark):
    want = {
        "ｋｅｗｅｌ５５": 1, "Кewel-55": 1, "kweel55 ": 1, "gene:Nh6": 2, "NIH9A": 3, "Zok8.2": 4, "zok8_2_mouse": 4, "lagrit vaklu": 5, "Boqγ": 6, "06-Dec": 7, "Dec-06": 7,
        "Kewel5 9": 8, "Kewel59": None, "Kewel56": None, "qit6s": 9, "QIT6Cc": 9, "unknown": None, "9876543": None, "'Nih6'": 2, "Nih6(-/-)": 2, "​Nih6": 2, "Xq-rs3": None, "stimulus": 0,
    }
    assert match(spark, list(want)) == want


def test_edge_cases(spark):
    assert match(spark, [None, "", "   ", " ", "​"]) == {}
    long = "Nih" + "x" * 20_000 + "6"
    assert match(spark, [long, "Nih6", "Nih6"]) == {long: None, "Nih6": 2}
    v = spark.createDataFrame([("Nih6",)], "value string")
    empty = spark.createDataFrame([], "gene_id int, gene_name string")
    assert [tuple(r) for r in match_names(v, empty, "gene_id", "gene_name").collect()] == [("Nih6", None, None)]
    assert match_names(v.limit(0), spark.createDataFrame(GENES, "gene_id int, gene_name string"), "gene_id", "gene_name").count() == 0
