"""Streams: run messages in, crawls and graph versions out, and a cache gate with state.

Delivery is at least once with idempotent results: offsets are checkpointed, a batch writes its own graph version under
its number, and a repeated batch writes the same version again. Nothing is dropped on a slow consumer; backpressure
is left to the source's limits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandweb.operators.runs import in_slots, observed
from strandweb.plans.crawl import crawl
from strandweb.schemas import RUN
from strandweb.sources.codec import decode_runs, encode
from strandweb.sources.fetch import Fetcher

#: Messages of a produced batch, and seconds until one is flushed anyway.
PRODUCE_BATCH, FLUSH_SECONDS = 50, 1


def read_messages(spark: SparkSession, source: str, path: str | None = None, **options: str) -> DataFrame:
    """``value``: a stream of JSON messages from text files (``source="text"``), or from Kafka where its connector is installed
    (options ``kafka.bootstrap.servers``, ``subscribe``, ``kafka.sasl.*`` and so on)."""
    reader = spark.readStream.format(source).options(**{"maxFilesPerTrigger": "100"} | options if source == "text" else options)
    return reader.load(path).select(F.col("value").cast("string").alias("value")) if path else reader.load().select(F.col("value").cast("string").alias("value"))


def _messages(df: DataFrame, sink: str, columns: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Messages and the options that make batches of them: files of at most ``PRODUCE_BATCH``, or Kafka's own batching."""
    options = {"maxRecordsPerFile": str(PRODUCE_BATCH)} if sink == "text" else {"kafka.linger.ms": str(1000 * FLUSH_SECONDS)} if sink == "kafka" else {}
    return encode(df, *columns), options


def write_messages(df: DataFrame, path: str | None, checkpoint: str, *columns: str, once: bool = False, sink: str = "text", **options: str) -> StreamingQuery:
    """Rows of a stream as JSON messages, flushed each second or, with ``once``, until the input is used up.

    To text files in ``path``, or to any other ``sink`` that is installed (Kafka: options ``kafka.bootstrap.servers``, ``topic`` and so on).
    """
    messages, own = _messages(df, sink, columns)
    writer = messages.writeStream.format(sink).option("checkpointLocation", checkpoint).options(**own | options)
    writer = writer.option("path", path) if path else writer
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")).start()


class MessageQueue:
    """Where tasks and runs are sent: a folder of text files, or a sink that is installed. For batches of a stream, and for whole tables."""

    def __init__(self, path: str | None = None, sink: str = "text", **options: str):
        self.path, self.sink, self.options = path, sink, options

    def send(self, df: DataFrame, *columns: str) -> None:
        messages, own = _messages(df, self.sink, columns)
        writer = messages.write.format(self.sink).mode("append").options(**own | self.options)
        writer.save(self.path) if self.path else writer.save()

    def send_tasks(self, tasks: DataFrame) -> None:
        self.send(tasks, "url", "current_depth", "run")

    def send_runs(self, runs: DataFrame) -> None:
        self.send(runs, *(f.name for f in RUN))


class GraphStore:
    """Versions of the graph and the caches in a shared folder; each batch writes a version of its own, the newest complete one counts.

    The newest ``keep`` complete versions stay, so that a repeated batch finds the one before it. ``measures`` has what was
    observed of the last batch's pages while they were written.
    """

    TABLES = ("nodes", "edges", "cache", "robots")

    def __init__(self, spark: SparkSession, folder: str, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder, max(keep, 2)
        self.measures: dict[str, int] = {}

    def _file_system(self) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._file_system()
        root = path(self.folder)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(path(f"{self.folder}/{n}/_COMPLETE")))

    def read(self, before: int | None = None) -> dict[str, DataFrame | None]:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return dict.fromkeys(self.TABLES)
        path, fs = self._file_system()
        held = {t: f"{self.folder}/v{known[-1]}/{t}" for t in self.TABLES}
        return {t: self.spark.read.parquet(place) if fs.exists(path(place)) else None for t, place in held.items()}

    def write(self, version: int, pages: DataFrame | None = None, **tables: DataFrame | None) -> None:
        path, fs = self._file_system()
        for name, df in tables.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        if pages is not None:
            observation = Observation()
            observed(pages, observation).write.mode("overwrite").parquet(f"{self.folder}/v{version}/pages")
            self.measures = observation.get
        fs.create(path(f"{self.folder}/v{version}/_COMPLETE"), True).close()
        for old in self.versions()[: -self.keep]:
            fs.delete(path(f"{self.folder}/v{old}"), True)


def crawl_runs(
    messages: DataFrame, store: GraphStore, fetcher: Fetcher, checkpoint: str, robots: DataFrame | None = None, as_of: Callable[[], datetime] | None = None, once: bool = False,
    slots: int | None = None, requeue: MessageQueue | None = None, done: Callable[[int, DataFrame], None] | None = None, robots_fetcher: Fetcher | None = None, **limits: int,
) -> StreamingQuery:
    """Crawl the runs of a message stream, batch by batch; malformed messages are skipped.

    With ``slots`` and ``requeue`` so many runs of a batch are crawled, and the others are sent back to the queue. With ``robots_fetcher``
    rules are fetched as needed and their cache is kept in the store. ``done`` is called with a batch's number and the
    outcomes of its runs once they are stored.
    """
    clock = as_of or (lambda: datetime.now(timezone.utc))

    def batch(rows: DataFrame, number: int) -> None:
        runs = decode_runs(rows).where("id != ''").dropDuplicates(["id"]).persist()
        if not runs.isEmpty():
            now = runs
            if slots and requeue:
                now, later = in_slots(runs, slots)
                if not later.isEmpty():
                    requeue.send_runs(later)
            state = store.read(before=number)
            rules = robots if robots is not None else state["robots"]
            result = crawl(now, fetcher, clock(), rules, state["nodes"], state["edges"], state["cache"], robots_fetcher=robots_fetcher, **limits)
            store.write(number, pages=result.pages, nodes=result.nodes, edges=result.edges, cache=result.cache, robots=result.robots if robots_fetcher else None)
            if done:
                done(number, result.outcomes())
        runs.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Rows of a frame that leaves the gate.
FRAME = 10_000


def gate_stream(tasks: DataFrame, key: str, time: str, ttl_hours: int = 12, late_hours: int = 24) -> DataFrame:
    """``key, time, hit`` of a stream of look-ups: known if the key's last miss is younger than the time to live.

    A hit doesn't renew the entry. The state of a key is the time of its last miss; it is dropped when the watermark has passed the
    end of its life, as no look-up can find it any more. Rows of one key and batch are taken in order of time; rows that are
    more than ``late_hours`` behind the newest one are too late to be looked up.
    """
    ttl = pd.Timedelta(hours=ttl_hours)

    def one(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        # The frames of a key aren't ordered: its times of this batch are put in order together, 8 bytes each.
        times = np.sort(np.concatenate([frame["time"].to_numpy("datetime64[us]") for frame in frames]))
        hits = np.ones(len(times), bool)
        at = 0 if last is None else int(np.searchsorted(times, np.datetime64(last + ttl, "us")))
        while at < len(times):
            hits[at] = False
            last = pd.Timestamp(times[at])
            at = int(np.searchsorted(times, np.datetime64(last + ttl, "us")))
        for begin in range(0, len(times), FRAME):
            yield pd.DataFrame({"key": group[0], "time": times[begin : begin + FRAME], "hit": hits[begin : begin + FRAME]})
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int((last + ttl).value // 1_000_000), state.getCurrentWatermarkMs() + 1))

    rows = tasks.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"))
    rows = rows.withWatermark("time", f"{late_hours} hours")
    return rows.groupBy("key").applyInPandasWithState(one, "key string, time timestamp, hit boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
