"""N-gram counts against Counters, marks, hot terms, null terms, long sequences."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from strandweb.llm.terms import marked, ngram_counts

SCHEMA = "id long, terms array<string>, occurrences string"


def brute(rows, n):
    occurrences, records = Counter(), Counter()
    for _, seq, _ in rows:
        own = Counter(tuple(seq[i : i + k]) for i in range(len(seq or [])) for k in range(1, n + 1) if i + k <= len(seq) and None not in seq[i : i + k])
        occurrences.update(own)
        records.update(own.keys())
    return {g: (c, records[g]) for g, c in occurrences.items()}


@pytest.mark.parametrize("n,routes", [(1, 4), (2, 1), (2, 5), (3, 3)])
def test_counts(spark, n, routes):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([None, [], [rnd.choice(["hot", "hot", "hot", "a", "b", None, f"t{i}", ""]) for _ in range(rnd.randrange(9))]]), "x") for i in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [(tuple(r.terms), (r.occurrences, r.records)) for r in ngram_counts(df, "terms", n, routes).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(rows, n)


def test_marks(spark):
    rows = [(i, ["all", "half"] if i % 2 else ["all", f"one{i}"], "") for i in range(100)]
    counts = marked(ngram_counts(spark.createDataFrame(rows, SCHEMA), "terms", 1), 100, common=0.5)
    got = {r.terms[0]: (r.is_rare, r.is_common) for r in counts.collect()}
    assert got["all"] == (False, True) and got["half"] == (False, False) and got["one2"] == (True, False)


def test_long_and_empty(spark):
    long = [f"w{i % 7}" for i in range(20_000)]
    got = {tuple(r.terms): (r.occurrences, r.records) for r in ngram_counts(spark.createDataFrame([(1, long, "")], SCHEMA), "terms", 2).collect()}
    assert got == brute([(1, long, "")], 2)
    assert ngram_counts(spark.createDataFrame([], SCHEMA), "terms", 1).count() == 0


def test_equal_suffixes_meet_on_the_stack(spark, monkeypatch):
    """Chunks of a few positions leave many rows of a term: only the stack sums them. Without it the counts are partial."""
    from strandweb.llm import terms

    rows = [(i, ["hot", "a", "hot", f"t{i % 4}"], "") for i in range(40)]
    table = pa.chunked_array([pa.array([r[1] for r in rows[:3]])])
    assert terms.combined_suffixes(table, 1).to_pydict() == {"t1": ["hot", "a", "t0", "t1", "t2"], "occurrences": [6, 3, 1, 1, 1], "r1": [3, 3, 1, 1, 1]}
    parts = [pa.record_batch({"t1": ["hot", "hot", "hot", "a"], "occurrences": [6, 2, 4, 1], "r1": [3, 1, 2, 1]}), pa.record_batch({"t1": ["a", "Z"], "occurrences": [5, 1], "r1": [4, 1]})]
    out = pa.Table.from_batches(list(terms._stacked(iter(parts), 1))).to_pydict()
    assert out == {"terms": [["hot"], ["a"], ["Z"]], "occurrences": [12, 6, 1], "records": [6, 5, 1]}
    monkeypatch.setattr(terms.Stack, "put", lambda self, own, same, n, flags: [x.append(v) for x, v in zip(self.out, (own, n, flags[0]))])
    skipped = pa.Table.from_batches(list(terms._stacked(iter(parts), 1))).to_pydict()
    assert skipped["occurrences"] == [6, 2, 4, 1, 5, 1]


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, ["a"], "")], SCHEMA)
    plan = ngram_counts(df, "terms", 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "DESC" in plan
