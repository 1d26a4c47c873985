"""Leaks against brute force; cleaned texts have none left."""

import random

from strandweb.llm.leakage import ItemWindows, cut, leaks, without_leaks, words_of

TEXT, ITEM = "doc_id long, text string, item long", "item_id long, text string"


def grams(text, n):
    words = words_of(text or "")
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def data(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "a", "Bot", "réseau", "x1", "page", "gate", "of"])
    items = [(i, ", ".join(word() for _ in range(rnd.randrange(3, 25)))) for i in range(12)] + [(90, None), (None, "the a bot"), (91, "")]
    items.append((92, items[3][1].upper()))
    docs = []
    for i in range(120):
        words = [rnd.choice([word(), f"w{rnd.randrange(40)}"]) for _ in range(rnd.randrange(30))]
        if rnd.random() < 0.4:
            part = words_of(rnd.choice(items[:12])[1])
            at = rnd.randrange(len(part))
            words[5:5] = part[at : at + rnd.randrange(1, 15)]
        docs.append((i, rnd.choice(["  ", " - ", "\n"]).join(words), 0))
    return docs + [(500, None, 0), (501, "", 0), (0, docs[0][1], 0)], items


def test_leaks(spark):
    docs, items = data(4)
    n = 5
    want = {(d, i) for d, t, _ in docs for i, x in items if i is not None and grams(t, n) & grams(x, n)}
    assert want
    for most in (60, 10**6):
        got = leaks(spark.createDataFrame(docs, TEXT).repartition(4), "doc_id", "text", spark.createDataFrame(items, ITEM), "item_id", "text", n, most)
        assert {(r.record, r.item) for r in got.collect()} == want
    assert leaks(spark.createDataFrame([], TEXT), "doc_id", "text", spark.createDataFrame(items, ITEM), "item_id", "text", n).count() == 0
    assert leaks(spark.createDataFrame(docs, TEXT), "doc_id", "text", spark.createDataFrame([], ITEM), "item_id", "text", n).count() == 0


def test_cleaning(spark):
    docs, items = data(5)
    n = 5
    had = {d for d, t, _ in docs for i, x in items if i is not None and grams(t, n) & grams(x, n)}
    corpus, tests = spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, ITEM)
    whole = without_leaks(corpus, "text", tests, "item_id", "text", n, whole=True).collect()
    assert {r.doc_id for r in whole} == {d for d, _, _ in docs} - had
    results = [{r.doc_id: r.text for r in without_leaks(corpus, "text", tests, "item_id", "text", n, most=most).collect()} for most in (60, 10**6)]
    assert results[0] == results[1]
    left = results[0]
    for d, t, _ in docs:
        assert left[d] == t if d not in had else len(left[d]) < len(t)


def test_cut():
    windows = ItemWindows([(1, "one two three four five".split())], 3)
    own = lambda t: cut(t, windows.hits(t)[0], 3)
    assert own("Zero ONE, two (three) six! one two") == "Zero ) six! one two"
    assert own("one two") == "one two"
    assert own("one two three four five") == ""
    assert words_of("\u0130s ΑΣ.Β_b1") == ["\u0130s".lower(), "ΑΣ".lower(), "β", "b1"]


def test_blocks_meet_in_one_text(spark):
    """Spans of items in different blocks that overlap, and passages that only stand in a text once others are cut out."""
    w = [f"w{i}" for i in range(20)]
    texts = ["head " + " ".join(w) + " tail", " ".join([*(f"a{i}" for i in range(1, 7)), *w[:13], *(f"b{i}" for i in range(1, 8))])]
    items = [("x", " ".join(w[:15])), ("y", " ".join(w[7:])), ("z", " ".join([*(f"a{i}" for i in range(1, 7)), *(f"b{i}" for i in range(1, 8))]))]
    corpus, tests = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], TEXT), spark.createDataFrame(items, "item_id string, text string")
    for most in (3, 10, 10**6):
        left = {r.doc_id: r.text for r in without_leaks(corpus, "text", tests, "item_id", "text", 13, most=most).collect()}
        assert left == {0: "head  tail", 1: "a1 a2 a3 a4 a5 a6  b1 b2 b3 b4 b5 b6 b7"}
        got = {(r.record, r.item): r.windows for r in leaks(corpus, "doc_id", "text", tests, "item_id", "text", 13, most).collect()}
        assert got == {(0, "x"): 3, (0, "y"): 1, (1, "x"): 1}  # textual ids are kept; a long item may be cut over blocks


def test_very_long_text(spark):
    text = "filler word " * 200_000 + "one two three four five"
    corpus = spark.createDataFrame([(1, text, 0)], TEXT)
    got = leaks(corpus, "doc_id", "text", spark.createDataFrame([(7, "one two three four")], ITEM), "item_id", "text", 4).collect()
    assert [tuple(r) for r in got] == [(1, 7, 1)]
