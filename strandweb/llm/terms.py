"""Frequencies of all terms and n-grams, and of the records that hold them, by suffix sorting.

Each position of a record's term sequence gives one suffix, truncated to ``max_n`` terms, so an n-gram is a prefix of the
suffixes that begin where it occurs. The steps:

1. Each map task cuts its records into suffixes and combines equal ones of a chunk of ``CHUNK`` positions, so that a
   term that a third of all records share leaves one row for each chunk.
2. The suffixes are routed by their first term: the only shuffle.
3. A task sorts its suffixes in reverse lexicographic order and reads them once with a stack, whose entries are the
   counts of the prefixes of the current suffix. Equal suffixes of different chunks meet on the stack and are summed there; when a
   prefix ends it is complete, comes off, is put out, and its occurrences pass to the prefix below (:class:`Stack`).

Record sets travel as *first-occurrence flags*: a suffix carries, for each prefix length, in how many records it is the
first to have that prefix. Summed over the suffixes that share a prefix they give the number of records, without
holding a set of record ids for any term, however common.

With ``max_n > 1`` a hot first term may have many different suffixes: they are routed by first and second term's hash
(``ROUTES`` ways), and the one-term prefixes of the routes are summed at the end.

Defined cases: null terms break the sequence (no n-gram spans one) and count nowhere; null and empty sequences are records
without terms; repeated rows are records of their own; an empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ways in which the suffixes of one first term are spread, by their second term.
ROUTES = 64
#: Positions whose suffixes a map task combines at a time, about.
CHUNK = 1 << 19
#: N-grams of a batch that leaves the stack.
BATCH = 8192
#: A term is rare in so few records, common in more than this share of all records.
RARE_RECORDS, COMMON_SHARE = 1, 0.05


def _columns(max_n: int) -> list[str]:
    return [*(f"t{k}" for k in range(1, max_n + 1)), "occurrences", *(f"r{k}" for k in range(1, max_n + 1))]


def combined_suffixes(terms: pa.ChunkedArray, max_n: int) -> pa.Table:
    """The distinct truncated suffixes of some records: ``t1..tn`` (null beyond its end), ``occurrences``, ``r1..rn``."""
    lists = terms.combine_chunks()
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    record = np.repeat(np.arange(len(lists)), size)
    coded = pc.dictionary_encode(lists.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64)
    n = len(code)
    # ids[k]: a number for the first k + 1 terms from each position; -1 where the record or the run of terms ends before.
    wide, ids = code, [code]
    for k in range(1, max_n):
        following = np.full(n, -1, np.int64)
        if n > k:
            following[:-k] = np.where(record[k:] == record[:-k], code[k:], -1)
        whole = (ids[-1] >= 0) & (following >= 0)
        wide = np.where(whole, ids[-1] * (len(coded.dictionary) + 1) + following, -1)
        _, numbers = np.unique(wide, return_inverse=True)
        ids.append(np.where(whole, numbers, -1))
    longest, offset = ids[0].copy(), len(coded.dictionary)
    for own in ids[1:]:  # the suffix itself: its longest prefix
        longest = np.where(own >= 0, own + offset, longest)
        offset += n + 1
    held = np.flatnonzero(code >= 0)
    _, at, which, occurrences = np.unique(longest[held], return_index=True, return_inverse=True, return_counts=True)
    at = held[at]
    columns: dict[str, pa.Array] = {}
    for k in range(max_n):
        here = np.minimum(at + k, max(n - 1, 0))
        columns[f"t{k + 1}"] = coded.dictionary.take(pa.array(code[here], mask=ids[k][at] < 0))
    columns["occurrences"] = pa.array(occurrences, pa.int64())
    for k in range(max_n):
        has = np.flatnonzero(ids[k][held] >= 0)
        _, first = np.unique(record[held[has]] * (int(ids[k].max(initial=0)) + 1) + ids[k][held[has]], return_index=True)
        columns[f"r{k + 1}"] = pa.array(np.bincount(which[has[first]], minlength=len(at)).astype(np.int64))
    return pa.table(columns)


def _cut(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    positions = 0
    for batch in batches:
        held.append(batch)
        positions += len(batch.column(0).flatten())
        if positions >= CHUNK:
            yield from combined_suffixes(pa.chunked_array([b.column(0) for b in held]), max_n).to_batches()
            held, positions = [], 0
    if held:
        yield from combined_suffixes(pa.chunked_array([b.column(0) for b in held]), max_n).to_batches()


class Stack:
    """Counts of the prefixes of the current suffix, which come in reverse lexicographic order."""

    def __init__(self):
        self.path: list[str] = []
        self.occurrences: list[int] = []
        self.records: list[int] = []
        self.out: tuple[list, list, list] = ([], [], [])

    def put(self, terms: list[str], same: int, occurrences: int, flags: list[int]) -> None:
        """``terms`` share their first ``same`` ones with the suffix before."""
        self.close(same)
        for t in terms[same:]:
            self.path.append(t)
            self.occurrences.append(0)
            self.records.append(0)
        self.occurrences[-1] += occurrences
        for k in range(len(terms)):
            self.records[k] += flags[k]

    def close(self, depth: int) -> None:
        """Take the prefixes of more than ``depth`` terms off: they are complete."""
        while len(self.path) > depth:
            count = self.occurrences.pop()
            self.out[0].append(list(self.path))
            self.out[1].append(count)
            self.out[2].append(self.records.pop())
            self.path.pop()
            if self.path:
                self.occurrences[-1] += count

    def flush(self) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(self.out[0], pa.list_(pa.string())), pa.array(self.out[1], pa.int64()), pa.array(self.out[2], pa.int64())], ["terms", "occurrences", "records"])
        self.out = ([], [], [])
        return batch


def _stacked(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    """N-grams of the sorted suffixes of one partition."""
    stack = Stack()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(f"t{k}") for k in range(1, max_n + 1)]
        # How many terms a row has, and shares with the row before: found for the whole batch at once.
        size = sum(np.asarray(pc.is_valid(c).to_numpy(zero_copy_only=False)).astype(int) for c in columns)
        shared, still = np.zeros(batch.num_rows, int), np.ones(batch.num_rows - 1, bool)
        for c in columns:
            still &= np.asarray(pc.fill_null(pc.equal(c.slice(1), c.slice(0, len(c) - 1)), False).to_numpy(zero_copy_only=False), bool)
            shared[1:] += still
        texts = [c.to_pylist() for c in columns]
        flags = [batch.column(f"r{k}").to_pylist() for k in range(1, max_n + 1)]
        first = [t[0] for t in texts][: size[0]]
        while shared[0] < min(len(first), len(stack.path)) and stack.path[shared[0]] == first[shared[0]]:
            shared[0] += 1
        for row, (n, same, occurrences) in enumerate(zip(size.tolist(), shared.tolist(), batch.column("occurrences").to_pylist())):
            stack.put([t[row] for t in texts[:n]], same, occurrences, [f[row] for f in flags])
            if len(stack.out[0]) >= BATCH:
                yield stack.flush()
    stack.close(0)
    if stack.out[0]:
        yield stack.flush()


def ngram_counts(df: DataFrame, terms: str, max_n: int, routes: int = ROUTES) -> DataFrame:
    """``terms array<string>, occurrences, records``: all n-grams of up to ``max_n`` terms."""
    kinds = {**{f"t{k}": "string" for k in range(1, max_n + 1)}, **{c: "long" for c in _columns(max_n)[max_n:]}}
    own = df.select(F.col(terms).alias("s")).where(F.size("s") > 0).mapInArrow(lambda batches: _cut(batches, max_n), ", ".join(f"{c} {kinds[c]}" for c in _columns(max_n)))
    route = [F.col("t1")]
    if max_n > 1:
        route.append(F.when(F.col("t2").isNotNull(), F.pmod(F.xxhash64("t2"), F.lit(routes))).otherwise(0))
    placed = own.repartition(*route).sortWithinPartitions(*[F.col(f"t{k}").desc() for k in range(1, max_n + 1)])
    counted = placed.mapInArrow(lambda batches: _stacked(batches, max_n), "terms array<string>, occurrences long, records long")
    if max_n == 1:
        return counted
    short = counted.where(F.size("terms") == 1).groupBy("terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counted.where(F.size("terms") > 1).unionByName(short)


def marked(counts: DataFrame, n_records: int, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """``counts`` with ``is_rare`` and ``is_common`` (of ``n_records`` records). In a tiny table a term may be both."""
    return counts.withColumns({"is_rare": F.col("records") <= rare, "is_common": F.col("records") > F.lit(common * n_records)})
