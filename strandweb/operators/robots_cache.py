"""Robots rules by origin: from a cache with a time to live, or fetched.

A table of rules has ``origin, status, body, cached_at``. Defined cases: rules without a time never expire; of several rows for one
origin the newest counts; a file that doesn't exist (404) allows everything and isn't cached; a file that couldn't be
fetched (a null status) denies everything and isn't cached; any other status has its body taken for rules and cached; an
address without origin is denied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweb.functions.udfs import origin_of, robots_allow, robots_rules_of
from strandweb.schemas import ROBOTS
from strandweb.session import written
from strandweb.sources.fetch import Fetcher

TTL_HOURS = 12


def live_rules(cache: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """The rules that are still valid."""
    return cache.where(F.col("cached_at").isNull() | (F.col("cached_at") + F.expr(f"INTERVAL {ttl_hours} HOURS") > now))


def fetch_rules(origins: DataFrame, fetcher: Fetcher, now: Column) -> DataFrame:
    """Rules of each of the distinct ``origin`` rows, fetched now; a null status where that failed."""
    asked = origins.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url"))
    got = fetcher.fetch(asked).select("origin", F.col("status").cast("int").alias("status"), "body")
    return asked.select("origin").join(got, "origin", "left").select("origin", "status", "body", now.alias("cached_at"))


def cacheable(rules: DataFrame) -> DataFrame:
    return rules.where("status is not null and status <> 404")


def refreshed(cache: DataFrame, urls: DataFrame, fetcher: Fetcher, now: Column, ttl_hours: int = TTL_HOURS) -> tuple[DataFrame, DataFrame]:
    """``(rules, cache)``: the rules of all origins of ``urls``, fetched where the cache has no valid ones, and the cache after that."""
    origins = urls.select(origin_of(F.col("url")).alias("origin")).where("origin <> ''").distinct()
    known = live_rules(cache, now, ttl_hours)
    fetched = written(fetch_rules(origins.join(known.select("origin"), "origin", "left_anti"), fetcher, now))
    columns = ["origin", "status", "body", "cached_at"]
    kept = cache.join(cacheable(fetched).select("origin"), "origin", "left_anti").select(*columns)
    return known.join(origins, "origin", "left_semi").select(*columns).unionByName(fetched), kept.unionByName(cacheable(fetched))


def robots_verdict(urls: DataFrame, robots: DataFrame | None, agent: str) -> DataFrame:
    """``urls`` with ``allowed``: by the rules of the url's origin; all if no table is given, none if the origin is not in it.

    The files are parsed once for each origin; only the lines that hold for the agent are joined to the addresses.
    """
    if robots is None:
        return urls.withColumn("allowed", F.lit(True))
    newest = robots.groupBy("origin").agg(F.max_by(F.struct("status", "body"), F.struct("cached_at", "status")).alias("rule"))
    rules = newest.select("origin", F.col("rule.status").alias("__status"), robots_rules_of(agent)(F.coalesce("rule.body", F.lit(""))).alias("__rules"))
    known = urls.withColumn("origin", origin_of(F.col("url"))).join(rules, "origin", "left")
    verdict = F.when(F.col("origin").isNull() | F.col("__status").isNull(), False).when(F.col("__status") == 404, True)
    return known.withColumn("allowed", verdict.otherwise(robots_allow(F.col("__rules"), F.col("url")))).drop("origin", "__status", "__rules")


class RobotsSource:
    """Rules for a crawl that fetches them itself: each origin is asked once, if the cache has no valid rules."""

    def __init__(self, fetcher: Fetcher, cache: DataFrame | None, now: Column, ttl_hours: int = TTL_HOURS):
        self.fetcher, self.before, self.now, self.ttl_hours = fetcher, cache, now, ttl_hours
        self.tables: list[DataFrame] = [] if cache is None else [live_rules(cache, now, ttl_hours).select("origin", "status", "body", "cached_at")]
        self.fetched: list[DataFrame] = []

    def verdict(self, urls: DataFrame, agent: str) -> DataFrame:
        origins = urls.select(origin_of(F.col("url")).alias("origin")).where("origin <> ''").distinct()
        for known in self.tables:
            origins = origins.join(known.select("origin"), "origin", "left_anti")
        new = written(fetch_rules(origins, self.fetcher, self.now))
        self.tables.append(new)
        self.fetched.append(new)
        return robots_verdict(urls, reduce(DataFrame.unionByName, self.tables), agent)

    def cache(self) -> DataFrame | None:
        """The cache after the crawl."""
        if not self.fetched:
            return self.before
        new = cacheable(reduce(DataFrame.unionByName, self.fetched))
        if self.before is None:
            return new
        return self.before.join(new.select("origin"), "origin", "left_anti").select(*new.columns).unionByName(new)


def no_rules(spark) -> DataFrame:
    return spark.createDataFrame([], ROBOTS)
