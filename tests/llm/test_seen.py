"""Ribbon filters, and seen messages against a set, with hot and null keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweb.llm.seen import BITS, RibbonFilter, Shard, seen_messages


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 70_000])
def test_ribbon(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    filter_ = RibbonFilter(np.concatenate([keys, keys]))
    assert filter_.contains(keys).all()
    others = np.setdiff1d(rng.integers(0, 2**63, 400_000).astype(np.uint64), keys)
    assert filter_.contains(others).mean() < 4 / 2**BITS
    assert len(filter_.z) <= 1.25 * len(keys) + 200


HISTORY, TASKS = "run string, url string", "msg_no long, run string, url string, k1 long, generation int"


@pytest.mark.parametrize("limits", [{}, {"seal": 7, "shard_keys": 50}, {"seal": 1}, {"seal": 100, "shard_keys": 10**9}])
def test_seen(spark, limits):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20 if limits else 10_000)  # few repeats meet in a batch
    rnd = random.Random(3)
    key = lambda: (rnd.choice(["a", "b", None]), rnd.choice(["hot", "hot", *(f"u{rnd.randrange(150)}" for _ in range(3)), None]))
    history = [key() for _ in range(100)]
    tasks = [(i * 5, *key(), 0, 0) for i in range(600)]
    known, want = {k for k in history if None not in k}, []
    for m, run, url, *_ in tasks:
        if run is not None and url is not None:
            if (run, url) in known:
                want.append(m)
            known.add((run, url))
    seen, report = seen_messages(
        spark.createDataFrame(history, HISTORY), [F.col("run"), F.col("url")], spark.createDataFrame(tasks, TASKS).repartition(5), "msg_no", [F.col("run"), F.col("url")], **limits
    )
    rows = seen.collect()
    assert sorted(r.message for r in rows if r.certain) == want
    assert len({r.message for r in rows}) == len(rows)
    audit = report.first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert audit.rejected == sum(not r.certain for r in rows) and audit.hits >= len(rows) - len(want)
    assert audit.absent_probes > 0 and audit.wrong_rate < 0.01


def test_no_messages(spark):
    empty = spark.createDataFrame([], TASKS)
    seen, report = seen_messages(spark.createDataFrame([], HISTORY), [F.col("run"), F.col("url")], empty, "msg_no", [F.col("run"), F.col("url")])
    assert seen.count() == 0 and report.first().absent_probes == 0
    one = spark.createDataFrame([(1, "a", "b", 0, 0)], TASKS)
    seen, _ = seen_messages(spark.createDataFrame([("a", "b"), ("a", "b")], HISTORY), [F.col("run"), F.col("url")], one, "msg_no", [F.col("run"), F.col("url")])
    assert [r.message for r in seen.collect()] == [1]


def test_every_message_probes(spark, monkeypatch):
    """Keys that no filter, waiting set or batch knows are new; what the filters take for seen by mistake is rejected."""
    tasks = [(i, "a", f"u{i}", 0, 0) for i in range(300)] + [(1000 + i, "a", f"u{i}", 0, 0) for i in range(300)] * 2
    df = spark.createDataFrame(tasks, TASKS).repartition(4)
    seen, report = seen_messages(spark.createDataFrame([], HISTORY), [F.col("run"), F.col("url")], df, "msg_no", [F.col("run"), F.col("url")], seal=16)
    rows = seen.collect()
    assert sorted(r.message for r in rows if r.certain) == list(range(1000, 1300))
    assert report.first().rejected == sum(not r.certain for r in rows)


def test_shard_answers():
    rng = np.random.default_rng(1)
    shard, known, wrong = Shard(0, 64, 100), set(), 0
    for _ in range(40):
        keys = rng.integers(0, 3000, 50).astype(np.uint64)
        got = shard.seen(keys)
        for k, g in zip(keys.tolist(), got.tolist()):
            assert g or k not in known  # never new by mistake
            wrong += g and k not in known
            known.add(k)
    assert len(shard.filters) > 10 and wrong < 5 and len(shard.waiting) < 64


def test_messages_without_number_or_key(spark):
    """No number or no whole key: no message. Rows of one number and key are one message; a number may have two keys."""
    tasks = [(None, "a", "u", 0, 0), (1, "a", "u", 0, 0), (1, "a", "u", 0, 0), (2, "a", "u", 0, 0), (2, "a", "v", 0, 0), (3, None, "u", 0, 0), (4, "a", None, 0, 0), (5, "a", "v", 0, 0), (-7, "a", "w", 0, 0)]
    for partitions in (1, 9):
        df = spark.createDataFrame(tasks, TASKS).repartition(partitions)
        seen, report = seen_messages(spark.createDataFrame([("a", "w"), (None, "u"), ("a", "w")], HISTORY), [F.col("run"), F.col("url")], df, "msg_no", [F.col("run"), F.col("url")])
        assert sorted(r.message for r in seen.collect() if r.certain) == [-7, 2, 5]
        assert report.first().rejected == 0
