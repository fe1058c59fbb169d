import random

from chronocount.llm.leak import leaks, words

WORDS = [f"w{i}" for i in range(3000)]


def run(spark, docs, items, share=0.5):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id bigint, item_text string")
    return {(r["doc_id"], r["item_id"]): r["share"] for r in leaks(d, "doc_id", "text", i, "item_id", "item_text", share).collect()}


def brute(item, doc, least=8):
    """Words of the item that lie in a run of ``least`` words that the document has too."""
    a, b = words(item), words(doc)
    runs = {tuple(b[j : j + least]) for j in range(len(b) - least + 1)}
    return len({k for i in range(len(a) - least + 1) if tuple(a[i : i + least]) in runs for k in range(i, i + least)})


def test_words():
    assert words("A <b>bold</b> one,\nfrus-\ntum H<sub>2</sub>O") == words("a bold one frustum H2O")
    assert words("Тest ｆｏｏ") == ["test", "foo"] and words("") == []


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    docs = []
    for _ in range(60):
        doc = [rng.choice(WORDS) for _ in range(80)]
        if rng.random() < 0.7:
            part = items[rng.randrange(12)].split()
            if rng.random() < 0.3:  # taken apart, the second half first
                part = part[len(part) // 2 :] + ["between"] + part[: len(part) // 2]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "changed"
            doc[30:30] = part[rng.randrange(12) :]
        docs.append(" ".join(doc).upper())
    got = run(spark, docs, items)
    want = {(d, i) for d in range(60) for i in range(12) if brute(items[i], docs[d]) >= 0.5 * len(items[i].split())}
    assert set(got) == want and want


def test_edge_cases(spark):
    item = " ".join(WORDS[:20])
    long = " ".join(["filler"] * 100_000) + " " + item
    assert set(run(spark, [None, "", item, item, long, "w0 w1"], [item, None, "", "too short"])) == {(2, 0), (3, 0), (4, 0)}
    assert run(spark, [None], [item]) == {} and run(spark, [item], [None]) == {}


def test_changed_words(spark):
    item = WORDS[:24]
    doc = [*item[:2], "changed", *item[3:]]
    d = spark.createDataFrame([(1, " ".join(["x", *doc, "y"])), (2, " ".join(["changed" if i % 4 == 2 else w for i, w in enumerate(item)]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(item), "clash")], "item_id bigint, item_text string, doc string")
    got = [tuple(r) for r in leaks(d, "doc_id", "text", i, "item_id", "item_text", 0.5, changed_words=True).collect()]
    # One changed word is bridged, every fourth isn't.
    assert got == [(1, 7, 24, 21, 23, 23 / 24)]


def test_rows_of_one_key_are_one_text(spark):
    item = " ".join(WORDS[:40])
    d = spark.createDataFrame([(1, " ".join(WORDS[:12])), (1, " ".join(WORDS[20:32])), (2, " ".join(WORDS[:12]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, item_text string")
    assert [tuple(r)[:4] for r in leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()] == [(1, 7, 40, 24)]
