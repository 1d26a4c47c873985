"""Depth-limited crawls, level by level.

One level: drop what the cache knows, ask the robots rules, fetch, extract links, write the results, admit the children. Work is done once for each different url of a
level; its result goes to all tasks that want it. Two tables are written for a level, its frontier and its results, so lineage doesn't grow; what
earlier levels have saved is one scan over their results' addresses, and what a run has used up is the last number of its latest tasks. A
run ends when none of its children is admitted; the loop takes at most ``max(max_depth)`` rounds.

Every admitted task has one outcome: saved, cache_hit, robots_denied or fetch_error. Of tasks of one level that use the cache
and share a url the first (by run and order) does the work; the others are cache hits if it was saved, else they fail
alike. Rejected children are counted as limit_rejected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweb.functions.sniff import content_type_column
from strandweb.functions.udfs import correct_scheme_of, links_of
from strandweb.operators.admission import admit, within_depth
from strandweb.operators.cache import TTL_HOURS, live, write
from strandweb.operators.graph import upsert_edges, upsert_nodes
from strandweb.operators.robots_cache import RobotsSource, robots_verdict
from strandweb.operators.scan import numbered
from strandweb.schemas import CACHE
from strandweb.session import WrittenTable, written
from strandweb.sources.fetch import Fetcher, Renderer

AGENT = "strandweb"


@dataclass
class Crawl:
    """``pages``: one row per saved task; ``tasks``: run_id, url, depth, seq, outcome; ``rejected``: run_id, refused; then the state after the crawl (``robots``: the rules' cache)."""

    pages: DataFrame
    tasks: DataFrame
    rejected: DataFrame
    nodes: DataFrame
    edges: DataFrame
    cache: DataFrame
    robots: DataFrame | None = None

    def outcomes(self) -> DataFrame:
        """``run_id, outcome, n``."""
        counted = self.tasks.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
        refused = self.rejected.where("refused > 0").select("run_id", F.lit("limit_rejected").alias("outcome"), F.col("refused").alias("n"))
        return counted.unionByName(refused)


def run_limits(runs: DataFrame) -> DataFrame:
    """Runs with zero values for what is null, flags flat."""
    flag = lambda f: F.coalesce(F.col(f"extra_flags.{f}"), F.lit(False))
    return runs.where(F.col("id").isNotNull()).select(
        F.col("id").alias("run_id"), F.coalesce("use_cache_flag", F.lit(False)).alias("use_cache"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"),
        F.coalesce("max_links", F.lit(0)).alias("max_links"), flag("parse_rendered_html").alias("render"), F.coalesce("start_url", F.lit("")).alias("start_url"),
    )


class _Level:
    """What is done with the frontier of one level."""

    def __init__(self, fetcher: Fetcher, allow: Callable[[DataFrame], DataFrame], known: DataFrame | None, done: WrittenTable, extract: Callable[[Column, Column], Column], renderer: Renderer | None):
        self.fetcher, self.allow, self.known, self.done, self.renderer = fetcher, allow, known, done, renderer
        # Expressions are built once for all levels. The type is that of the body as it was fetched, not of the rendered one.
        body = F.when(F.col("render"), F.coalesce("rendered_html", "body")).otherwise(F.col("body"))
        links = F.array_sort(F.coalesce(extract(F.col("url"), body), F.array().cast("array<string>")))
        self.loaded = ["url", "render", F.lit(True).alias("allowed"), F.col("status").cast("int").alias("status"), links.alias("links"), F.coalesce("content_type", content_type_column(F.col("body"))).alias("content_type")]
        wants = lambda render, cached: F.max(F.when(F.col("render") == render, F.col("use_cache") == cached))
        self.per_url = [
            F.max("known").alias("known"), F.min(F.when(F.col("use_cache"), F.struct("run_id", "seq"))).alias("first"),
            *[F.coalesce(wants(r, c), F.lit(False)).alias(f"{'rendered' if r else 'plain'}_{'cached' if c else 'always'}") for r in (True, False) for c in (True, False)],
        ]
        ways = [F.when(F.col(f"{w}_cached") | F.col(f"{w}_always"), F.struct(F.lit(w == "rendered").alias("render"), (F.col(f"{w}_always") | ~F.col("known")).alias("needed"))) for w in ("plain", "rendered")]
        self.way = F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("way")

    def results(self, frontier: DataFrame) -> DataFrame:
        """The frontier with outcome, status, links and content type."""
        asks = frontier.select("url", "run_id", "seq", "use_cache", "render", F.lit(False).alias("known"))
        # What this crawl has saved so far is in the cache too, and fresh.
        cached = [*([] if self.known is None else [self.known]), *([self.done.read().where("outcome = 'saved'").select("url")] if self.done.parts else [])]
        for urls in cached:
            nothing = [F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in ("run_id", "seq", "use_cache", "render")]
            asks = asks.unionByName(urls.select("url", *nothing, F.lit(True).alias("known")))
        # One row for each url, and then for each way in which its tasks want it.
        wanted = asks.groupBy("url").agg(*self.per_url).select("url", "known", "first", self.way).select("url", "known", "first", "way.*")
        work = self.allow(wanted.where("needed").select("url", "render"))
        fetched = self.fetcher.fetch(work.where("allowed").select("url", "render"))
        if self.renderer:
            fetched = self.renderer.render(fetched)
        loaded = fetched.select(*self.loaded)
        denied = work.where("not allowed").select("url", "render", "allowed", *[F.lit(None).cast(loaded.schema[c].dataType).alias(c) for c in ("status", "links", "content_type")])
        results = wanted.join(loaded.unionByName(denied), ["url", "render"], "left")
        joined = frontier.join(results, ["url", "render"], "left")
        hit = F.col("use_cache") & F.col("known")
        later = F.coalesce(F.col("use_cache") & (F.col("first") != F.struct("run_id", "seq")), F.lit(False))
        outcome = F.when(hit, "cache_hit").when(F.col("allowed").isNull(), "fetch_error").when(~F.col("allowed"), "robots_denied").when(later, "cache_hit").otherwise("saved")
        rows = joined.withColumn("outcome", outcome)
        saved = F.col("outcome") == "saved"
        return rows.select("run_id", "url", "depth", "seq", "outcome", *[F.when(saved, F.col(c)).alias(c) for c in ("status", "links", "content_type")])


def crawl(
    runs: DataFrame, fetcher: Fetcher, as_of: datetime, robots: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, cache: DataFrame | None = None,
    agent: str = AGENT, ttl_hours: int = TTL_HOURS, max_concurrent_runs: int | None = None, extract: Callable[[Column, Column], Column] = links_of,
    robots_fetcher: Fetcher | None = None, renderer: Renderer | None = None,
) -> Crawl:
    """Crawl all ``runs`` at once, or ``max_concurrent_runs`` after each other in order of their ids, later ones seeing the cache of earlier ones.

    ``robots`` is a table of all rules, or, with ``robots_fetcher``, a cache of rules: what it lacks is fetched. ``renderer`` makes the rendered
    documents of the tasks that ask for them, where the fetcher brings none.
    """
    spark = runs.sparkSession
    limits = written(run_limits(runs))
    now = F.lit(as_of).cast("timestamp")
    source = RobotsSource(robots_fetcher, robots, now, ttl_hours) if robots_fetcher else None
    allow = (lambda urls: source.verdict(urls, agent)) if source else (lambda urls: robots_verdict(urls, robots, agent))
    if max_concurrent_runs:
        limits = written(numbered(limits, ["run_id"], "number").withColumn("batch", F.expr(f"(number - 1) div {max_concurrent_runs}")))
        batches = (limits.agg(F.max("batch")).first()[0] or 0) + 1
        groups = [limits.where(F.col("batch") == b) for b in range(batches)]
    else:
        groups = [limits]
    done = WrittenTable(spark)
    level = _Level(fetcher, allow, None if cache is None else live(cache, now, ttl_hours).select("url"), done, extract, renderer)
    for group in groups:
        _crawl_group(group, level, done)
    tasks = done.read()
    saved = tasks.where("outcome = 'saved'")
    # A run asks for its seed and for each link of its pages; what it was not given was refused.
    entered = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("entered"), F.sum(F.when(F.col("outcome") == "saved", F.size(F.filter("links", lambda x: x.isNotNull()))).otherwise(0)).alias("found"))
    rejected = limits.select("run_id").join(entered, "run_id", "left").select("run_id", (F.lit(1) + F.coalesce("found", F.lit(0)) - F.coalesce("entered", F.lit(0))).alias("refused"))
    pages = saved.select("url", "status", "links", F.col("run_id").alias("last_run_id"), now.alias("last_updated_at"), now.alias("found_at"), "content_type", "seq", "depth")
    latest = pages.withColumn("seq", F.col("depth") * F.lit(1 << 40).cast("long") + F.col("seq"))
    cached = saved.groupBy("url").agg(F.max_by("links", F.struct("run_id", "seq")).alias("links")).withColumn("cached_at", now)
    return Crawl(
        pages, tasks.select("run_id", "url", "depth", "seq", "outcome"), rejected, upsert_nodes(nodes, latest), upsert_edges(edges, pages),
        write(spark.createDataFrame([], CACHE) if cache is None else cache, cached), source.cache() if source else robots,
    )


def _crawl_group(limits: DataFrame, level: _Level, done: WrittenTable) -> None:
    """Crawl some runs at once; each level's results are added to ``done``. One number comes to the driver for each level: whether it has tasks."""
    zero = F.lit(0).cast("long")
    run = limits.select("run_id", "max_depth", F.col("max_links").cast("long").alias("max_links"), "use_cache", "render")
    asked = run.join(limits.select("run_id", correct_scheme_of(F.col("start_url")).alias("url")), "run_id").select("*", F.lit(0).alias("depth"), zero.alias("parent"), zero.alias("used"))
    most = limits.agg(F.max("max_links")).first()[0] or 0
    while True:
        admitted = admit(asked.where(within_depth(F.col("depth"), F.col("max_depth"))), "run_id", ["parent", "url"], F.col("max_links") - F.col("used"), max(most, 0))
        frontier = written(admitted.select("run_id", "url", "depth", (F.col("used") + F.col("rank")).alias("seq"), "use_cache", "render"))
        empty = frontier.isEmpty()
        if empty and done.parts:
            return
        results = done.append(level.results(frontier))
        if empty:
            return
        used = results.groupBy("run_id").agg(F.max("seq").alias("used"))
        children = results.where("outcome = 'saved'").select("run_id", (F.col("depth") + 1).alias("depth"), F.col("seq").alias("parent"), F.explode("links").alias("url")).where(F.col("url").isNotNull())
        asked = children.join(run.join(used, "run_id"), "run_id")
