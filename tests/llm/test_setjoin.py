"""The set join against brute force: ties, copies, hot values, blocks, nulls, empty tables, two tables."""

import random
from fractions import Fraction

import pytest

from strandweb.llm import setjoin
from strandweb.llm.setjoin import expand_pairs, members_of, merge_skip, pairs_between, record_sets, similar_sets


def brute(rows, threshold, least):
    sets = {}
    for i, v in rows:
        if i is not None and v is not None:
            sets.setdefault(i, set()).update(x for x in v if x is not None)
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def rows_with_copies(n, seed, vocabulary):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.3:
            base = [x for x in rnd.choice(rows)[1] or [] if x is not None]
            rnd.shuffle(base)
            links = base[: len(base) - rnd.randrange(3)] + [f"n{i}"] * rnd.randrange(2) + [None] * rnd.randrange(2)
        elif kind < 0.6:
            links = ["hot1", "hot2", "hot3", "hot4", *rnd.sample(["h5", "h6", "h7"], rnd.randrange(4))]
        else:
            links = [f"v{int(rnd.random() ** 3 * vocabulary)}" for _ in range(rnd.randrange(12))]
        rows.append((i * 3, links))
    return [*rows, (9001, None), (9002, []), (None, ["hot1"] * 9), (0, ["extra"]), (3, rows[1][1])]


@pytest.mark.parametrize("threshold,least,frequent,block", [("4/5", 5, 256, 4096), ("4/5", 5, 3, 4), ("1/2", 1, 2, 3), ("9/10", 2, 1, 7)])
def test_pairs(spark, threshold, least, frequent, block):
    t = Fraction(threshold)
    rows = rows_with_copies(250, hash(threshold) % 100, 60)
    df = spark.createDataFrame(rows, "id long, v array<string>").repartition(7)
    sets = record_sets(df, "id", "v", least)
    classes, pairs = similar_sets(sets, t, least, frequent, block)
    got = [tuple(r) for r in expand_pairs(pairs, members_of(sets)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, t, least)
    sizes = {r.rep: set(r.tokens) for r in classes.collect()}
    for r in pairs.collect():
        assert r.overlap == len(sizes[r.class_a] & sizes[r.class_b]) and r.size_a == len(sizes[r.class_a])


def test_empty(spark):
    df = spark.createDataFrame([], "id long, v array<string>")
    sets = record_sets(df, "id", "v", 1)
    classes, pairs = similar_sets(sets, Fraction(4, 5), 1)
    assert classes.count() == 0 and pairs.count() == 0


def test_between_two_tables(spark):
    left, right = [(1, ["a", "b", "c"]), (2, ["x", "y"])], [(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, ["q"])]
    a, b = (spark.createDataFrame(r, "id long, v array<string>") for r in (left, right))
    assert sorted(tuple(r) for r in pairs_between(a, b, "id", "id", "v", Fraction(3, 4), 1).collect()) == [(1, 1), (1, 2)]
    assert pairs_between(a, b.limit(0), "id", "id", "v", Fraction(3, 4), 1).count() == 0


def test_hot_class_in_blocks(spark, monkeypatch):
    """A set that a third of all records share, and one similar to it: in blocks of bounded size, with no pair lost."""
    monkeypatch.setattr(setjoin, "COPIES", 16)
    hot, near = ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"]
    rows = [(i, hot if i % 3 == 0 else near if i % 3 == 1 and i < 60 else [f"{i}_{k}" for k in range(5)]) for i in range(450)]
    df = spark.createDataFrame(rows, "id long, v array<string>").repartition(5)
    sets = record_sets(df, "id", "v", 5)
    members = members_of(sets)
    assert members.groupBy("rep", "block").count().agg({"count": "max"}).first()[0] <= 3 * 16
    got = [tuple(r) for r in expand_pairs(similar_sets(sets, Fraction(4, 5), 5)[1], members).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, Fraction(4, 5), 5)
    left, right = df.where("id < 200"), df.where("id >= 200")
    between = {tuple(r) for r in pairs_between(left, right, "id", "id", "v", Fraction(4, 5), 5).collect()}
    assert between == {(x, y) for x, y in got if x < 200 <= y}


def test_merge_skip():
    rnd = random.Random(1)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randrange(1, 20))) for _ in range(rnd.randrange(1, 7))]
        least = rnd.randrange(1, len(lists) + 1)
        counts = {}
        for x in lists:
            for i in x:
                counts[i] = counts.get(i, 0) + 1
        assert dict(merge_skip(lists, [0] * len(lists), least)) == {i: c for i, c in counts.items() if c >= least}
