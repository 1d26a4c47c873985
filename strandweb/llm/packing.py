"""Lay texts, measured in tokens, into containers of fixed capacity: best-two-fit.

Texts longer than a container are cut into whole containers and a rest; nothing else is split. The pieces are spread by
hash over groups of bounded size, each packed by itself in one task, so the work is one shuffle of small rows and the number of
groups grows with the data; each group leaves one container partly filled at most, or few.

In a group: bins are filled greedily, each time with the largest piece that fits. Then the bin's smallest piece is tried
against every pair of unpacked pieces that fits the gap it would leave; if a pair fills it more tightly, the best such pair
takes its place and the piece goes back to the unpacked ones. Sizes are whole tokens, so the unpacked pieces are kept as
a histogram and a pair is searched for in one vector operation over the capacity.

Container numbers follow from the pieces (group, place in the group's packing), not from the partitioning. The vocabulary file is read
once, on the driver, and broadcast (about a megabyte), so executors need no copy of it.

Defined cases: null and empty texts have no tokens and take no space; they are listed in the first container of their
group with size 0. Repeated rows are packed each. Very long texts give as many pieces as they need; whole pieces are containers by themselves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Pieces of a packing group, about.
GROUP = 100_000
#: Place of the public vocabulary (ranks of a byte-level BPE); a parameter, never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries of the count cache of a Python worker; beyond it the cache is emptied.
CACHE = 1_000_000

#: Control characters that only some engines take for white space.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
_COUNTERS: dict[str, "TokenCounter"] = {}


class TokenCounter(dict):
    """Number of tokens of a text. BPE never crosses the pattern's pieces, so counts of pieces are remembered.

    That pays where the standard library's regular expressions can cut the pieces, in ASCII texts; others are encoded.
    """

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        super().__init__()
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
        ascii_pattern = pattern.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.pieces = re.compile(ascii_pattern).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() or not _SEPARATORS.isdisjoint(text):
            return len(self.encoding.encode_ordinary(text))
        return sum(map(self.__getitem__, self.pieces(text)))

    @classmethod
    def shared(cls, ranks: bytes, pattern: str) -> "TokenCounter":
        """One for each Python worker and vocabulary."""
        key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
        if key not in _COUNTERS:
            _COUNTERS[key] = cls(ranks, pattern)
        return _COUNTERS[key]


def read_vocabulary(path: str = VOCABULARY) -> tuple[bytes, str]:
    """The rank file, and the pattern that cuts texts before its merges."""
    import public_tokenizers

    with open(path, "rb") as lines:
        return lines.read(), public_tokenizers.PATTERN


def token_counts(df: DataFrame, record: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``record, tokens`` of each row; ``vocabulary`` is a file of the driver."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter.shared(*shared.value)
        for t in texts:
            yield pd.Series([counter.count(x) for x in t], dtype="int64")

    return df.select(F.col(record).alias("record"), count(F.col(text)).alias("tokens"))


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece; ``sizes`` are from 0 to ``capacity``."""
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(np.bincount(sizes, minlength=capacity + 1))
    begins = ends - np.bincount(sizes, minlength=capacity + 1)
    left = (ends - begins).astype(np.int64)  # unpacked pieces of each size; 0 is packed apart
    left[0] = 0
    # biggest[x]: the largest unpacked size <= x, or 0. Kept as a union-find style table of next smaller sizes.
    biggest = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    def refresh(size: int) -> None:
        """After a size ran out or came back: the table above it, up to the next unpacked size."""
        value = size if left[size] else int(biggest[size - 1]) if size else 0
        above = np.argmax(left[size + 1 :] > 0) if size < capacity and (left[size + 1 :] > 0).any() else capacity - size
        biggest[size : size + 1 + above] = value

    bins: list[list[int]] = []
    waiting = int(left.sum())
    while waiting:
        held: list[int] = []
        gap = capacity
        while (size := int(biggest[gap])) > 0:
            held.append(size)
            gap -= size
            left[size] -= 1
            if not left[size]:
                refresh(size)
        waiting -= len(held)
        if gap and waiting > 1:
            smallest = held[-1]  # pieces are taken from large to small
            room = gap + smallest
            present = np.flatnonzero(left[1 : room // 2 + 1]) + 1  # the smaller one of a pair
            if len(present):
                other = biggest[room - present]
                single = (other == present) & (left[present] < 2)
                if single.any():
                    other = np.where(single, biggest[np.minimum(room - present, present - 1)], other)
                sums = np.where(other > 0, present + other, 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    held.pop()
                    for size in (int(present[best]), int(other[best])):
                        held.append(size)
                        left[size] -= 1
                        if not left[size]:
                            refresh(size)
                    left[smallest] += 1
                    if left[smallest] == 1:
                        refresh(smallest)
                    waiting -= 1
        bins.append(held)
    where = np.zeros(len(sizes), np.int64)
    at = begins.copy()
    for number, held in enumerate(bins):
        for size in held:
            where[order[at[size]]] = number
            at[size] += 1
    return where


def _pack_groups(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = np.asarray(table["size"])
        whole = sizes == capacity
        where = np.empty(len(sizes), np.int64)
        where[~whole] = pack(sizes[~whole], capacity)
        where[whole] = where[~whole].max(initial=-1) + 1 + np.arange(whole.sum())
        container = (np.int64(table["part"][0].as_py()) << np.int64(32)) + where
        yield from pa.table({"container": pa.array(container), **{c: table[c] for c in ("record", "piece", "begin", "size")}}).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        part = np.asarray(batch.column("part"))
        at = 0
        for cut in [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []:
            if held and part[at] != current:
                yield from work(pa.Table.from_batches(held))
                held = []
            current = int(part[at])
            held.append(batch.slice(at, cut - at))
            at = cut
    if held:
        yield from work(pa.Table.from_batches(held))


def containers(counts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``container, record, piece, begin, size``: the pieces of each container; ``begin`` is the piece's first token.

    ``counts`` are :func:`token_counts` rows; they are read twice (to size the groups), so a checkpoint is advisable.
    """
    pieces = counts.select("record", F.explode(F.expr(f"sequence(0L, greatest(0L, (tokens - 1) div {capacity}))")).alias("piece"), "tokens")
    pieces = pieces.select("record", "piece", (F.col("piece") * capacity).alias("begin"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("size"))
    n = counts.agg(F.coalesce(F.sum(F.expr(f"greatest(1L, (tokens + {capacity - 1}) div {capacity})")), F.lit(0))).first()[0]
    groups = max(1, -(-n // group))
    kind = counts.schema["record"].dataType.simpleString()
    spread = pieces.withColumn("part", F.pmod(F.xxhash64("record", "piece"), F.lit(groups)).cast("int"))
    spread = spread.repartition(min(groups, 100_000), "part").sortWithinPartitions("part", "size", "record", "piece")
    return spread.mapInArrow(lambda batches: _pack_groups(batches, capacity), f"container long, record {kind}, piece long, begin long, size int")
