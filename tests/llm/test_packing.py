"""Containers: nothing lost, nothing over capacity, nothing split without need, little space unused."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweb.llm.packing import TokenCounter, containers, pack, read_vocabulary, token_counts

VOCABULARY = read_vocabulary()
TEXTS = ["", "plain text", "It's 12 o'clock,\n\n  isn't it?  ", "übergröße – ½ naïve", "a\x1cb \x1d", "tab\t\tand  spaces   ", "x" * 500, "日本語 text", " line", "''s's"]


def test_counts_equal_the_encoder():
    counter = TokenCounter(*read_vocabulary())
    assert [counter.count(t) for t in TEXTS] == [len(counter.encoding.encode_ordinary(t)) for t in TEXTS]
    assert counter.count(None) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(text):
    counter = TokenCounter.shared(*VOCABULARY)
    assert counter.count(text) == len(counter.encoding.encode_ordinary(text))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=120))
def test_pack(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    where = pack(sizes, 40)
    if len(sizes):
        held = np.bincount(where, weights=sizes)
        assert held.max() <= 40 and len(where) == len(sizes)
        assert len(held) <= max(1, 2 * -(-int(sizes.sum()) // 40))


def test_two_small_ones_replace_a_larger_one():
    # Greedy fills 6 + 3 of 10; the 3 gives way to 2 + 2.
    sizes = np.array([6, 3, 2, 2])
    where = pack(sizes, 10)
    assert where[0] == where[2] == where[3] != where[1]


@pytest.mark.parametrize("group", [50, 10**6])
def test_containers(spark, group):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(np.minimum(rng.lognormal(3, 1.3, 400), 900))] + [(1000, None), (1001, ""), (1002, "word " * 1000)]
    counts = token_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    sizes = {r.record: r.tokens for r in counts.collect()}
    assert sizes[1000] == sizes[1001] == 0
    got = containers(counts, 128, group).collect()
    held, pieces = {}, {}
    for r in got:
        held[r.container] = held.get(r.container, 0) + r.size
        pieces.setdefault(r.record, []).append((r.begin, r.size))
    assert max(held.values()) <= 128
    for record, tokens in sizes.items():
        own = sorted(pieces[record])
        assert sum(s for _, s in own) == tokens and len(own) == max(1, -(-tokens // 128))
        assert [b for b, _ in own] == list(range(0, max(tokens, 1), 128))[: len(own)]
    total = sum(sizes.values())
    assert len(held) <= 1.03 * total / 128 + 2 * (403 / group + 1)


def test_numbers_do_not_follow_the_partitioning(spark):
    df = spark.createDataFrame([(i % 50, 40 * i) for i in range(200)], "record long, tokens long")
    one, other = (sorted(tuple(r) for r in containers(d, 512, 60).collect()) for d in (df.repartition(3), df.orderBy(F.desc("tokens"))))
    assert one == other and len({r[0] for r in one if r[4] == 512}) == sum(r[4] == 512 for r in one)


def test_documents_are_packed_tightly(spark):
    """Unused space over the documents of a table; greedy filling alone is the yardstick."""
    counts = token_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    rows = containers(counts).groupBy("container").agg(F.sum("size").alias("held")).collect()
    unused = 1 - sum(r.held for r in rows) / (2048 * len(rows))
    print(f"{len(rows)} containers, {unused:.5f} unused")
    assert max(r.held for r in rows) <= 2048 and unused < 0.005


def test_no_texts(spark):
    assert containers(token_counts(spark.createDataFrame([], "id long, text string"), "id", "text")).count() == 0
