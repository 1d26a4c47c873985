"""The page cache: a table of urls with the time of writing, valid for a time to live. A hit doesn't renew it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_HOURS = 12


def live(cache: DataFrame, as_of: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    return cache.where(F.col("cached_at") + F.expr(f"INTERVAL {ttl_hours} HOURS") > as_of)


def write(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``cache`` with the rows of ``new`` (url, links, cached_at) in place of older ones of the same url."""
    both = cache.select("url", "links", "cached_at").unionByName(new.select("url", "links", "cached_at"))
    return both.where(F.col("url").isNotNull()).groupBy("url").agg(F.max_by("links", "cached_at").alias("links"), F.max("cached_at").alias("cached_at"))


def _misses(batches: Iterator[pa.RecordBatch], ttl_us: int) -> Iterator[pa.RecordBatch]:
    """The misses' times of each key; keys and different times come sorted. From a miss on, the next one is found by bisection."""
    key, until = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        times = np.asarray(pc.cast(batch.column("time"), pa.int64()))
        change = np.flatnonzero(np.append(True, pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)))
        missed = []
        for start, end in zip(change.tolist(), [*change[1:].tolist(), len(times)]):
            if (name := keys[start].as_py()) != key:
                key, until = name, None
            at = start if until is None else start + int(np.searchsorted(times[start:end], until, "left"))
            while at < end:
                missed.append(at)
                until = int(times[at]) + ttl_us
                at = start + int(np.searchsorted(times[start:end], until, "left"))
        yield batch.take(pa.array(missed, pa.int64()))


def lookups(df: DataFrame, key: str, time: str, order: list[str], ttl_hours: int = TTL_HOURS) -> DataFrame:
    """``df`` with ``hit``: whether a cache that is written on each miss, and only then, would know ``key`` at ``time``.

    Rows without key or time drop out. Which *times* of a key are misses follows from its different times alone: these (combined on the map
    side, 8 bytes each) are streamed through in order, key by key, one batch in memory. The rows themselves are never gathered by key: they meet the
    misses' times by key and time, and the first row (by ``order``) of a missed time is the miss.
    """
    kept = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = kept.withColumns({"__key": F.col(key), "__time": F.col(time).cast("timestamp")})
    times = rows.select(F.col("__key").alias("key"), F.col("__time").alias("time")).distinct()
    placed = times.repartition("key").sortWithinPartitions("key", "time")
    ttl_us = ttl_hours * 3_600_000_000
    misses = placed.mapInArrow(lambda batches: _misses(batches, ttl_us), times.schema)
    place = F.struct(*order, F.xxhash64(F.to_json(F.struct(*df.columns))))
    asked = rows.withColumn("__place", place).join(misses.select(F.col("key").alias("__key"), F.col("time").alias("__time"), F.lit(True).alias("__missed")), ["__key", "__time"], "left")
    first = F.row_number().over(Window.partitionBy("__key", "__time").orderBy("__place"))  # looks of one key at one instant
    return asked.withColumn("hit", F.col("__missed").isNull() | (first > 1)).select(*[F.col(f"`{c}`") for c in df.columns], "hit")
