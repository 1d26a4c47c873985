"""Evaluation texts that leaked into a corpus, fully or partly: common runs of ``n`` words.

The test items' words get codes, their windows of ``n`` words go into a hash set that is broadcast, and every training
text is scanned once: its words are coded, windows with a word that no item has are skipped, the others' hashes are looked
up, and hits are verified on the words themselves. The corpus isn't shuffled at all.

The broadcast is bounded: items are taken in blocks of at most ``MOST_WINDOWS`` windows (a longer item is cut into overlapping
pieces), and the corpus is scanned once for each block, so any number of items works. Cleaning gathers the hits of all blocks in the
original texts and then cuts once, so its result doesn't depend on the blocks.

Words are longest runs of letters and digits (Unicode), in lower case. Defined cases: null and empty texts, and those with
fewer than ``n`` words, leak nothing; an item found several times in a text is one leak; items with equal passages all
leak; ids are of any type; of several rows with one id, of the corpus or of the items, the leaks count together; texts are scanned whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandweb.session import checkpointed

WINDOW = 13
#: Windows of test items in one broadcast (about 50 MB with their words).
MOST_WINDOWS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_FACTOR = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[str]:
    """Words in lower case. Letters whose lower case isn't one letter, or depends on the next word, are lowered word by word."""
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) and "\u03a3" not in text else [w.lower() for w in _WORD.findall(text)]


class ItemWindows:
    """The windows of a block of test items, which are given as lists of words; ``ids`` are theirs, ``owner`` their places."""

    def __init__(self, items: list[tuple[object, list[str]]], n: int):
        self.n, self.codes, self.ids = n, {}, [item for item, _ in items]
        starts, owners, coded = [], [], []
        length = 0
        for place, (_, words) in enumerate(items):
            if len(words) >= n:
                coded.extend(self.codes.setdefault(w, len(self.codes) + 1) for w in words)
                starts.extend(range(length, length + len(words) - n + 1))
                owners.extend([place] * (len(words) - n + 1))
                length += len(words)
        self.words = np.array(coded, np.int32)
        self.powers = np.array([pow(_FACTOR, j + 1, 1 << 64) for j in range(n)], np.uint64)
        at = np.array(starts, np.int64)
        hashes = self.hashed(self.words, at)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.owner = hashes[order], at[order], np.array(owners, np.int64)[order]

    def hashed(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j, power in enumerate(self.powers):
            out = (out ^ (out >> np.uint64(29))) + words[at + j].astype(np.uint64) * power
        return out

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """``(positions, places)`` of the text's windows that are an item's too; positions count words, places the block's items."""
        none = np.zeros(0, np.int64)
        words = words_of(text)
        if len(words) < self.n:
            return none, none
        coded = np.fromiter(map(self.codes.get, words, itertools.repeat(0)), np.int32, len(words))
        gaps = np.concatenate([[-1], np.flatnonzero(coded == 0), [len(coded)]])
        runs = np.flatnonzero(np.diff(gaps) > self.n)  # stretches of known words that are long enough
        if not len(runs):
            return none, none
        at = np.concatenate([np.arange(gaps[r] + 1, gaps[r + 1] - self.n + 1) for r in runs])
        own = self.hashed(coded, at)
        low, high = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        found = np.flatnonzero(high > low)
        if not len(found):
            return none, none
        counts = high[found] - low[found]
        position = np.repeat(at[found], counts)
        match = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        same = np.ones(len(position), bool)
        for j in range(self.n):
            same &= coded[position + j] == self.words[self.at[match] + j]
        return position[same], self.owner[match[same]]


def _blocks(items: DataFrame, item: str, text: str, n: int, most: int) -> Iterator[list[tuple[object, list[str]]]]:
    """The items' words in blocks of at most ``most`` windows, one block at a time on the driver."""
    known = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (4 * most)))
    for p in range(parts):
        rows = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p) if parts > 1 else known
        block, windows = [], 0
        for row in rows.toLocalIterator():
            words = words_of(row["text"])
            for at in range(0, len(words) - n + 1, most):
                piece = words[at : at + most + n - 1]
                own = len(piece) - n + 1
                if block and windows + own > most:
                    yield block
                    block, windows = [], 0
                block.append((row["item"], piece))
                windows += own
        if block:
            yield block


def leaks(corpus: DataFrame, record: str, text: str, items: DataFrame, item: str, item_text: str, n: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """``record, item, windows``: each text and item with a window in common, and the number of the text's windows that are the item's."""
    kinds = [corpus.schema[record].dataType, items.schema[item].dataType]
    rows = corpus.select(F.col(record).alias("record"), F.col(text).alias("text")).where(F.col("record").isNotNull() & F.col("text").isNotNull())
    shape = f"record {kinds[0].simpleString()}, item {kinds[1].simpleString()}, windows long"
    out = corpus.sparkSession.createDataFrame([], shape)
    item_type = to_arrow_type(kinds[1])
    for block in _blocks(items, item, item_text, n, most):
        shared = corpus.sparkSession.sparkContext.broadcast(ItemWindows(block, n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            ids = pa.array(windows.ids, item_type)
            for batch in batches:
                at, places, counts = [], [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    position, own = windows.hits(t)
                    if len(own):
                        found, n_own = np.unique(np.unique(np.stack([own, position]), axis=1)[0], return_counts=True)
                        at.extend([i] * len(found))
                        places.extend(found.tolist())
                        counts.extend(n_own.tolist())
                yield pa.record_batch([batch.column("record").take(pa.array(at, pa.int64())), ids.take(pa.array(places, pa.int64())), pa.array(counts, pa.int64())], ["record", "item", "windows"])

        out = out.unionByName(rows.mapInArrow(scan, shape))
    return out.groupBy("record", "item").agg(F.sum("windows").alias("windows"))


#: So many texts' spans are broadcast at most, and so many positions; beyond it the join shuffles.
BROADCAST_TEXTS, BROADCAST_POSITIONS = 50_000, 5_000_000


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def leaked_positions(corpus: DataFrame, text: str, items: DataFrame, item: str, item_text: str, n: int, most: int) -> DataFrame:
    """``digest, positions``: the first words of the leaked windows of each different text that has any, over all blocks."""
    rows = corpus.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    out = corpus.sparkSession.createDataFrame([], "text_key binary, position long")
    for block in _blocks(items, item, item_text, n, most):
        shared = corpus.sparkSession.sparkContext.broadcast(ItemWindows(block, n))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, positions = [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    own = np.unique(shared.value.hits(t)[0])
                    at.extend([i] * len(own))
                    positions.extend(own.tolist())
                yield pa.record_batch([batch.column("text_key").take(pa.array(at, pa.int64())), pa.array(positions, pa.int64())], ["text_key", "position"])

        out = out.unionByName(rows.select("text", _digest(F.col("text")).alias("text_key")).mapInArrow(scan, "text_key binary, position long"))
    return out.groupBy(F.col("text_key").alias("digest")).agg(F.collect_set("position").alias("positions"))  # no more than the text's words


def without_leaks(corpus: DataFrame, text: str, items: DataFrame, item: str, item_text: str, n: int = WINDOW, whole: bool = False, most: int = MOST_WINDOWS) -> DataFrame:
    """``corpus`` without the leaked spans of ``text`` (or, with ``whole``, without the rows that have any).

    A span reaches from the first to the last word of overlapping windows, whichever items they are of. Rows without text stay as they are.
    """
    found = checkpointed(leaked_positions(corpus, text, items, item, item_text, n, most))
    texts, positions = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()
    if texts <= BROADCAST_TEXTS and positions <= BROADCAST_POSITIONS:
        found = F.broadcast(found)
    keyed = corpus.withColumn("__digest", _digest(F.col(text)))
    joined = keyed.join(found.select(F.col("digest").alias("__digest"), F.col("positions").alias("__positions")), "__digest", "left")
    if whole:
        return joined.where(F.col("__positions").isNull()).select(*[F.col(f"`{c}`") for c in corpus.columns])
    # Only texts with a hit go to Python and come back.
    cleaned = F.when(F.col("__positions").isNull(), F.col(text)).otherwise(_cleaned(n)(F.when(F.col("__positions").isNotNull(), F.col(text)), F.col("__positions")))
    return joined.withColumn("__text", cleaned).select(*[F.col("__text").alias(c) if c == text else F.col(f"`{c}`") for c in corpus.columns])


def _cleaned(n: int) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("string")
    def cleaned(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, positions in columns:
            yield pd.Series([None if t is None else cut(t, np.asarray(p, np.int64), n) for t, p in zip(texts, positions)], dtype=object)

    return cleaned


def cut(text: str, position: np.ndarray, n: int) -> str:
    """``text`` without the windows of ``n`` words that begin at the positions."""
    if not len(position):
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    drop = np.zeros(len(spans) + 1, np.int32)
    np.add.at(drop, position, 1)
    np.add.at(drop, position + n, -1)
    inside = np.cumsum(drop[:-1]) > 0
    parts, at, i = [], 0, 0
    while i < len(spans):
        if inside[i]:
            j = i
            while j + 1 < len(spans) and inside[j + 1]:
                j += 1
            parts.append(text[at : spans[i][0]])
            at, i = spans[j][1], j + 1
        else:
            i += 1
    return "".join([*parts, text[at:]])
