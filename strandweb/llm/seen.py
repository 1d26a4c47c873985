"""Has this key been seen before? Ribbon filters over sealed batches, probed generation by generation.

1. Each map task drops the repeats of a key within one Arrow batch of messages (a bounded exact set, compared on 128 bits): the smallest
   message number stands for the key there, and the others have certainly been seen. So a key with a third of all rows sends one
   row for each batch.
2. What is left is routed by key to shards and sorted by message number, the keys of the past first.
3. A shard reads its rows once, in blocks. Every message probes the filters of all sealed generations and the bounded exact
   set of the keys that wait to be sealed; a key that none of them knows is new and joins that set. When ``SEAL`` keys
   wait, they are sealed in a ribbon filter: a banded linear system over GF(2), ``z[s..s+63] . c = fingerprint`` for each
   key's start ``s`` and coefficients ``c``, solved by elimination along the band. A key that a filter knows by mistake needn't be
   added, as the same filter will know it again: there are no false "new" answers.
4. Hits, and only they, are confirmed: on all 128 bits, against the first place of their key among all rows.

In memory are a shard's filters, about 1.15 * ``BITS`` bits for each key, its waiting keys and one block. The wrong "seen" answers
have a rate of about generations / 2**BITS. The rate is measured twice: by the hits that the confirmation rejects, and
by keys that are certainly absent and probe all filters of each shard.

Defined cases: a null in any part of a key, or no number, is no message; repeated keys are fine; rows with one number and one key
are one message and get one answer; empty tables give empty results and an audit of no probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandweb.session import checkpointed

BITS, WIDTH = 16, 64
#: Rows of a shard, about, and keys of a sealed generation.
SHARD_KEYS, SEAL = 65_536, 16_384
#: Certainly absent keys that probe each shard.
AUDIT_KEYS = 20_000

_MASK = (1 << WIDTH) - 1
_REPEAT = sum(1 << (WIDTH * b) for b in range(BITS))
_FULL = (1 << (WIDTH * BITS)) - 1
_WITHOUT_TOP = _REPEAT * (_MASK >> 1)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) of ``keys``, another one for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & _MASK)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class RibbonFilter:
    """An immutable filter of 64-bit keys: ``contains`` never misses a key and errs with a rate of ``2**-BITS``."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.uint64))
        self.size, self.seed, slack = len(keys), 1, 1.12
        while not self._solve(keys, int(len(keys) * slack) + 2 * WIDTH):
            self.seed, slack = self.seed + 1, slack * 1.03

    def _equations(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(keys, self.seed)
        start = ((h >> np.uint64(32)) * np.uint64(self.slots - WIDTH + 1) >> np.uint64(32)).astype(np.int64)
        return start, mixed(h, 101) | np.uint64(1), (mixed(h, 202) >> np.uint64(64 - BITS)).astype(np.uint16)

    def _solve(self, keys: np.ndarray, slots: int) -> bool:
        self.slots = slots
        start, coefficient, fingerprint = self._equations(keys)
        order = np.argsort(start, kind="stable")
        rows, sums = [0] * slots, [0] * slots
        for s, c, f in zip(start[order].tolist(), coefficient[order].tolist(), fingerprint[order].tolist()):
            while True:
                own = rows[s]
                if not own:
                    rows[s], sums[s] = c, f
                    break
                c, f = c ^ own, f ^ sums[s]
                if not c:
                    if f:
                        return False  # contradicting equations: another seed, more slots
                    break
                gap = (c & -c).bit_length() - 1
                s, c = s + gap, c >> gap
        # Back substitution with all BITS columns side by side in one integer: WIDTH bits of solution for each column.
        spread = [0] * (1 << 8)
        for v in range(1 << 8):
            spread[v] = sum(1 << (WIDTH * b) for b in range(8) if v >> b & 1)
        high = WIDTH * 8
        window, packed = 0, bytearray(slots * BITS * 8)
        z = np.zeros(slots, np.uint16)
        block = BITS * 8
        for i in range(slots - 1, -1, -1):
            row = rows[i]
            if row:
                x = (row >> 1) * _REPEAT & window
                for shift in (32, 16, 8, 4, 2, 1):
                    x ^= x >> shift
                f = sums[i]
                bits = (x & _REPEAT) ^ spread[f & 255] ^ (spread[f >> 8] << high)
            else:
                bits = 0
            window = ((window & _WITHOUT_TOP) << 1) | bits
            packed[i * block : (i + 1) * block] = bits.to_bytes(block, "little")
            if i % 65536 == 0:  # fold what was packed so far; bounds the memory of the build
                end = min(i + 65536, slots)
                part = np.frombuffer(packed, np.uint8, (end - i) * block, i * block).reshape(end - i, BITS, 8)[:, :, 0]
                z[i:end] = (part.astype(np.uint16) << np.arange(BITS, dtype=np.uint16)).sum(axis=1, dtype=np.uint16)
        self.z = z
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        start, coefficient, fingerprint = self._equations(keys)
        found = np.zeros(len(keys), np.uint16)
        for j in range(WIDTH):
            found ^= self.z[start + j] * ((coefficient >> np.uint64(j)) & np.uint64(1)).astype(np.uint16)
        return found == fingerprint


class Shard:
    """The filters of one shard's sealed generations, and the keys that wait to be sealed."""

    def __init__(self, shard: int, seal: int, audit: int):
        self.seal = seal
        self.filters: list[RibbonFilter] = []
        self.waiting = np.zeros(0, np.uint64)  # sorted
        self.absent = mixed(np.arange(audit, dtype=np.uint64), (shard + 1) * 7919)

    def seen(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key is known to a filter, waits, or came before in ``keys``; the new ones are kept."""
        self.absent = self.absent[~np.isin(self.absent, keys)]  # what is left of them is in no filter
        known = np.isin(keys, self.waiting)
        for f in self.filters:
            known |= f.contains(keys)
        ask = np.flatnonzero(~known)
        new, first = np.unique(keys[ask], return_index=True)
        known[ask] = True
        known[ask[first]] = False
        self.waiting = np.union1d(self.waiting, new)
        if len(self.waiting) >= self.seal:
            self.filters.append(RibbonFilter(self.waiting))
            self.waiting = np.zeros(0, np.uint64)
        return known

    def audit(self) -> tuple[int, int]:
        """Probes of certainly absent keys, and wrong answers; what still waits is sealed for it."""
        filters = [*self.filters, *([RibbonFilter(self.waiting)] if len(self.waiting) else [])]
        wrong = np.zeros(len(self.absent), bool)
        for f in filters:
            wrong |= f.contains(self.absent)
        return len(self.absent), int(wrong.sum())


def _shards(batches: Iterator[pa.RecordBatch], schema: pa.Schema, seal: int, audit: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and message, keys of the past first; out come the messages taken for seen, and each shard's audit."""

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {**{c: table[c] for c in ("k1", "k2", "message", "repeat")}, **{c: pa.nulls(table.num_rows, pa.int64()) for c in ("probes", "wrong")}}
        yield from pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema).combine_chunks().to_batches()

    def report(own: Shard) -> pa.RecordBatch:
        counts = dict(zip(("probes", "wrong"), own.audit()))
        return pa.record_batch([pa.array([counts.get(f.name)], f.type) for f in schema], schema=schema)

    own, current, last = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        places = np.column_stack([np.asarray(pc.fill_null(batch.column(c), -1).cast(pa.int64())) for c in ("shard", "message", "k1", "k2")])
        once = np.append(last is None or bool((places[0] != last).any()), (places[1:] != places[:-1]).any(axis=1))
        last = places[-1]
        batch = batch.filter(pa.array(once))  # rows of one message are neighbours
        shard = np.asarray(batch.column("shard"))
        for begin, end in zip([0, *(cuts := (np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist())], [*cuts, len(shard)]) if len(shard) else []:
            if current != shard[begin]:
                if own:
                    yield report(own)
                current = int(shard[begin])
                own = Shard(current, seal, audit)
            for at in range(begin, end, seal):  # no block is larger than a generation
                block = pa.Table.from_batches([batch.slice(at, min(seal, end - at))])
                repeat = np.asarray(block["repeat"])
                taken = repeat.copy()
                asks = np.flatnonzero(~repeat)
                taken[asks] = own.seen(np.asarray(block["k1"]).view(np.uint64)[asks])
                taken &= np.asarray(block["message"].is_valid())
                if taken.any():
                    yield from rows(block.filter(pa.array(taken)))
    if own:
        yield report(own)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch with ``repeat``: whether its key came with a smaller number in the batch. Repeated rows and keys of the past go."""
    for batch in batches:
        k1, k2 = (np.asarray(batch.column(c)) for c in ("k1", "k2"))
        message = np.asarray(pc.fill_null(batch.column("message"), np.iinfo(np.int64).min))
        order = np.lexsort((message, k2, k1))
        key = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
        again, once = np.zeros(len(order), bool), np.ones(len(order), bool)
        again[order[1:]] = key
        once[order[1:]] = ~(key & (message[order[1:]] == message[order[:-1]]))
        again &= np.asarray(batch.column("message").is_valid())
        out = pa.record_batch([*batch.columns, pa.array(again)], [*batch.schema.names, "repeat"])
        yield out.filter(pa.array(once))


def _key(parts: list[Column]) -> list[Column]:
    """128 bits in two halves; the filters work on the first, exact comparison on both."""
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second half"), *parts).alias("k2")]


def _present(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))


def keyed(history: DataFrame, history_key: list[Column], messages: DataFrame, message: str, message_key: list[Column]) -> DataFrame:
    """``message, k1, k2`` of all rows that have a key; ``message`` is null for the keys of the past."""
    now = messages.where(_present(message_key) & F.col(message).isNotNull()).select(F.col(message).cast("long").alias("message"), *_key(message_key))
    past = history.where(_present(history_key)).select(F.lit(None).cast("long").alias("message"), *_key(history_key))
    return past.unionByName(now)


def probe(rows: DataFrame, shard_keys: int = SHARD_KEYS, seal: int = SEAL, audit: int = AUDIT_KEYS) -> tuple[DataFrame, DataFrame]:
    """``(taken, audit)``: ``k1, k2, message, repeat`` of the messages taken for seen, and each shard's ``probes`` and ``wrong`` answers.

    Repeats within a batch need no probe; they pass through a shard that follows from the message, not from the key.
    """
    shards = max(1, -(-rows.count() // shard_keys))
    combined = rows.mapInArrow(_combined, "message long, k1 long, k2 long, repeat boolean")
    shard = F.pmod(F.when(F.col("repeat"), F.xxhash64("message")).otherwise(F.xxhash64("k2")), F.lit(shards)).cast("int")
    placed = combined.withColumn("shard", shard).repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", F.col("message").asc_nulls_first(), "k1", "k2")
    shape = "k1 long, k2 long, message long, repeat boolean, probes long, wrong long"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], shape).schema)
    answers = checkpointed(placed.mapInArrow(lambda batches: _shards(batches, schema, seal, audit), shape))
    return answers.where("probes is null").drop("probes", "wrong"), answers.where("probes is not null").select("probes", "wrong")


def seen_messages(history: DataFrame, history_key: list[Column], messages: DataFrame, message: str, message_key: list[Column], **limits: int) -> tuple[DataFrame, DataFrame]:
    """``(seen, report)``: ``message, certain`` of each message that was taken for seen, and the rates of wrong answers.

    ``certain`` tells the true ones. The report: ``hits`` that had to be confirmed, ``rejected`` ones among them, and the
    audit (``absent_probes, wrong_answers, wrong_rate``).
    """
    rows = keyed(history, history_key, messages, message, message_key)
    taken, audit = probe(rows, **limits)
    hits = taken.where("not repeat")
    # The place where a key comes first: below all numbers if it is of the past. One state for each key and map task.
    first = rows.groupBy("k1", "k2").agg(F.min(F.when(F.col("message").isNull(), F.lit(0)).otherwise(1)).alias("now"), F.min("message").alias("first"))
    checked = hits.join(first, ["k1", "k2"]).select("message", ((F.col("now") == 0) | (F.col("first") < F.col("message"))).alias("certain"))
    seen = taken.where("repeat").select("message", F.lit(True).alias("certain")).unionByName(checked)
    said = audit.select("probes", "wrong", F.lit(0).alias("hits"), F.lit(0).alias("rejected"))
    said = said.unionByName(checked.select(F.lit(0).cast("long").alias("probes"), F.lit(0).cast("long").alias("wrong"), F.lit(1).alias("hits"), F.when(F.col("certain"), 0).otherwise(1).alias("rejected")))
    sums = {"absent_probes": "probes", "wrong_answers": "wrong", "hits": "hits", "rejected": "rejected"}
    report = said.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])
    return seen, report.withColumn("wrong_rate", F.when(F.col("absent_probes") > 0, F.col("wrong_answers") / F.col("absent_probes")).otherwise(F.lit(0.0)))
