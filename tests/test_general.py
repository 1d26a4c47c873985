"""Heavy keys, histories and deliveries against brute force, with nulls, ties, repeats, hot keys and empty tables."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweb.operators.delivery import first_copies, packed_rank, surplus_copies
from strandweb.operators.heavy_keys import distinct_members_per_key, rows_per_key, tree_sum, url_host
from strandweb.operators.history import Node, coalesce, join_all, rounds_above, version_history

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
UPDATES = "update_id long, url string, at timestamp, status int, links array<string>, leaf string, number int"


def test_tree_sum_of_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(3000)] + [(None, 1)]
    df = spark.createDataFrame(rows, "key string, total long").repartition(13)
    want = Counter()
    for k, v in rows:
        if k is not None:
            want[k] += v
    for fan_in, chunks in ((2, 13), (4, 1000), (32, 1)):
        got = {r["key"]: r["total"] for r in tree_sum(df, F.col("key"), F.col("total"), fan_in=fan_in, chunks=chunks).collect()}
        assert got == want


def test_members_count_once(spark):
    rows = [(1, ["a", "a", None, "b"]), (1, ["b", "c"]), (2, ["a"]), (None, ["a"]), (3, None), (4, []), (2, ["a"])]
    df = spark.createDataFrame(rows, "member long, keys array<string>")
    got = {r["key"]: r["total"] for r in distinct_members_per_key(df, "member", "keys").collect()}
    assert got == {"a": 2, "b": 1, "c": 1}
    assert distinct_members_per_key(df.limit(0), "member", "keys").count() == 0


def test_host(spark):
    urls = ["https://A.b:80/x", "http://c?d://e", "c/d", None, "://", "x://h#f", "https://u@h:1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    assert [r[0] for r in df.orderBy("i").select(url_host(F.col("url"))).collect()] == ["a.b", "c", None, None, None, "h", "u@h"]
    assert rows_per_key(df, url_host(F.col("url"))).count() == 4


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 100, 5000])
def test_coalescing_rounds(n):
    """Runs of equal neighbours by pairwise rounds, as many as the tree is high, against one pass over the rows."""
    rng = np.random.default_rng(n)
    entity = np.sort(rng.integers(0, max(1, n // 20), n)) if n else np.zeros(0, np.int64)
    h1, h2 = rng.integers(0, 2, n), np.zeros(n, np.int64)
    first, last, snapshots, rounds = coalesce(entity, h1, h2)
    want = []
    for i in range(n):
        if want and (entity[i], h1[i]) == (entity[i - 1], h1[i - 1]):
            want[-1][1], want[-1][2] = i, want[-1][2] + 1
        else:
            want.append([i, i, 1])
    assert list(map(list, zip(first, last, snapshots))) == want
    assert rounds == (math.ceil(math.log2(n)) if n > 1 else 0)


def test_rounds_of_the_tree():
    run = lambda i, payload: {"entity": "e", "h1": payload, "h2": 0, "valid_from": i, "last_seen": i, "snapshots": 1, "next_from": None, "number": 1, "leaf": i}
    nodes = [Node(run(i, i // 10), run(i, i // 10), True) for i in range(37)]
    top, changes, counts, rounds = join_all(nodes)
    assert rounds == 6  # ceil(log2(37))
    assert not top.single and top.tail["number"] == 4 and top.tail["snapshots"] == 7 and top.head["snapshots"] == 10 and top.head["next_from"] == 10
    assert sorted(c["leaf"] for c in changes if c.get("absorbed")) == [i for i in range(37) if i % 10]
    offsets = Counter()
    for child, _, add in counts:
        offsets[child] += add
    assert [offsets[i] for i in range(37)] == [i // 10 for i in range(37)]
    assert [rounds_above(p) for p in (0, 1, 2, 32, 33, 1024, 1025)] == [1, 1, 2, 2, 3, 3, 4]


def brute_history(rows):
    kept = {}
    for r in rows:
        if r[1] is not None and r[2] is not None and ((r[1], r[2]) not in kept or kept[r[1], r[2]][0] < r[0]):
            kept[r[1], r[2]] = r
    out, before = [], None
    for r in sorted(kept.values(), key=lambda r: (r[1], r[2])):
        payload = (r[3], frozenset(x for x in r[4] or [] if x is not None))
        if before is None or before[0] != r[1]:
            out.append([r[1], 1, r[2], None, r[0], r[2], 1])
        elif before[1] != payload:
            out[-1][3] = r[2]
            out.append([r[1], out[-1][1] + 1, r[2], None, r[0], r[2], 1])
        else:
            out[-1][5], out[-1][6] = r[2], out[-1][6] + 1
        before = (r[1], payload)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("partitions,limits", [(1, {}), (1, {"chunk_rows": 10}), (3, {}), (17, {"fan_in": 2}), (40, {"fan_in": 3, "chunk_rows": 5})])
def test_history_with_a_hot_entity(spark, partitions, limits):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if "chunk_rows" in limits else 10_000)
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        url = rnd.choice(["hot", "hot", "a", "b", "c", f"u{i}", None])
        at = None if rnd.random() < 0.03 else T0 + timedelta(minutes=rnd.randrange(900))
        links = rnd.choice([None, [], [None], ["x"], ["x"], ["x", "x"], ["y", "x", None], ["x", "y"]])
        rows.append((i, url, at, rnd.choice([None, 200, 200, 200, 200]), links, "leaf", i))
    df = spark.createDataFrame(rows, UPDATES).repartition(5)
    got = version_history(df, "url", "at", "update_id", ["status"], ["links"], ["leaf", "number"], partitions=partitions, **limits)
    seen = [(r.url, r.version_no, r.valid_from, r.valid_to, r.opened_by, r.last_seen, r.snapshots) for r in got.collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    naive = [tuple(x.replace(tzinfo=None) if isinstance(x, datetime) else x for x in r) for r in brute_history(rows)]
    assert sorted(seen, key=str) == sorted(naive, key=str)


def test_history_of_one_long_run(spark):
    rows = [(i, "u", T0 + timedelta(minutes=i), 200, ["x"], "", 0) for i in range(500)] + [(999, "u", T0 + timedelta(days=9), 404, None, "", 0)]
    got = version_history(spark.createDataFrame(rows, UPDATES), "url", "at", "update_id", ["status"], ["links"], partitions=7).orderBy("version_no").collect()
    assert [(r.version_no, r.snapshots, r.opened_by) for r in got] == [(1, 500, 0), (2, 1, 999)]
    assert got[0].valid_to == got[1].valid_from and got[1].valid_to is None


def test_empty_history(spark):
    assert version_history(spark.createDataFrame([], UPDATES), "url", "at", "update_id", ["status"], ["links"]).count() == 0


def test_deliveries(spark):
    rows = [(1, "a", 5, "x"), (2, "a", 5, "x"), (3, "a", 6, "x"), (4, None, 5, "x"), (5, "a", None, "x"), (6, "a", 5, None), (7, "b", 1, None), (7, "b", 1, None)]
    df = spark.createDataFrame(rows, "message long, k string, depth int, `key.x` string").repartition(4)
    identity = {"k": F.col("k"), "d": F.col("depth")}
    assert sorted(r.message for r in first_copies(df, identity, "message").collect()) == [1, 3, 7]
    assert sorted(r.message for r in surplus_copies(df, identity, "message").collect()) == [2, 6]
    assert first_copies(df.limit(0), identity, "message").count() == 0


def test_hot_message(spark):
    df = spark.range(3000).select(F.col("id").alias("message"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert surplus_copies(df, {"k": F.col("k")}, "message").count() == 999
    assert first_copies(df, {"k": F.col("k")}, "message").count() == 2001


def test_rank_of_deliveries(spark):
    """The packed rank orders like the struct: number, then time with none first; times far off are clamped."""
    times = [None, datetime(1500, 1, 1), datetime(1969, 12, 31, 23), datetime(2025, 1, 1), datetime(2025, 1, 1, 0, 0, 0, 1), datetime(2500, 1, 1)]
    numbers = [-(2**63), -5, 0, 7, 2**63 - 1]
    rows = [(n, t, i * 10 + j) for i, n in enumerate(numbers) for j, t in enumerate(times)]
    df = spark.createDataFrame(rows, "n long, at timestamp, place long")
    ranked = df.select("place", packed_rank(df, "n", "at").alias("rank")).orderBy("rank").collect()
    assert [r.place for r in ranked] == [r[2] for r in rows]
    same = spark.createDataFrame([(1, T0, "k", x) for x in ("p", "q", "r")], "n long, at timestamp, k string, v string")
    assert first_copies(same, {"k": F.col("k")}, "n", "at").count() == 1
    plan = surplus_copies(same, {"k": F.col("k")}, "n", "at")._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_messages_without_number(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (2, "a"), (2, "a"), (5, None)]
    df = spark.createDataFrame(rows, "n long, k string")
    assert [r.n for r in first_copies(df, {"k": F.col("k")}, "n").collect()] == [2]
    assert [r.n for r in surplus_copies(df, {"k": F.col("k")}, "n").collect()] == [3]


def test_history_of_other_types(spark):
    """Entities that are numbers, times that are dates, payloads that are all null."""
    rows = [(i, i % 3 if i % 7 else None, datetime(2025, 1, 1 + i % 25).date(), None, None, "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "update_id long, url int, at date, status int, links array<string>, leaf string, number int")
    got = version_history(df, "url", "at", "update_id", ["status"], ["links"], partitions=5, chunk_rows=4).collect()
    dates = {}
    for i, url, at, *_ in rows:
        if url is not None:
            dates.setdefault(url, {})[at] = i
    assert sorted((r.url, r.version_no, r.snapshots, r.valid_from, r.last_seen) for r in got) == [(u, 1, len(d), min(d), max(d)) for u, d in sorted(dates.items())]
