"""Runs: made, seeded, observed and taken from a queue.

Defined cases: a run without id gets a random one of 40 hexadecimal digits; null limits are zero; flags may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandweb.functions.udfs import correct_scheme_of
from strandweb.operators.scan import numbered
from strandweb.schemas import RUN


def random_id() -> Column:
    """40 random hexadecimal digits, another one for each row."""
    return F.sha1(F.expr("uuid()").cast("binary"))


def new_runs(urls: DataFrame, url: str, max_depth: int, max_links: int, screenshot: bool | None = None, rendered: bool | None = None, use_cache: bool = True, id_: Column | None = None) -> DataFrame:
    """One run for each row of ``urls``, with the cache on unless told otherwise; flags only if one is given."""
    flags = F.lit(None) if screenshot is None and rendered is None else F.struct(F.lit(bool(screenshot)).alias("should_screenshot"), F.lit(bool(rendered)).alias("parse_rendered_html"))
    made = {"id": random_id() if id_ is None else id_, "use_cache_flag": F.lit(use_cache), "max_depth": F.lit(max_depth), "max_links": F.lit(max_links), "extra_flags": flags, "start_url": F.col(url)}
    return urls.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in RUN])


def seed_tasks(runs: DataFrame) -> DataFrame:
    """The first task of each run, as a message carries it."""
    return runs.select(correct_scheme_of(F.coalesce("start_url", F.lit(""))).alias("url"), F.lit(0).alias("current_depth"), F.struct(*[F.col(f.name) for f in RUN]).alias("run"))


def child_tasks(tasks: DataFrame, links: str = "links") -> DataFrame:
    """The tasks of a task's links: one level deeper, of the same run. Null and empty lists give none."""
    flat = tasks.select(F.explode(links).alias("url"), (F.coalesce("current_depth", F.lit(0)) + 1).alias("current_depth"), "run")
    return flat.where(F.col("url").isNotNull())


def in_slots(runs: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """``(now, later)``: the first runs by id, as many as there are slots, and those that go back to the queue."""
    placed = numbered(runs, ["id"], "__place")
    return placed.where(F.col("__place") <= slots).drop("__place"), placed.where(F.col("__place") > slots).drop("__place")


def drained(messages: DataFrame, capacity: int) -> DataFrame:
    """At most ``capacity`` messages of those that wait."""
    return messages.limit(capacity)


def page_measures() -> dict[str, Column]:
    """What is measured of saved pages."""
    size = F.coalesce(F.size("links"), F.lit(0))
    return {"n_pages": F.count(F.lit(1)), "n_links": F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)), "most_links": F.coalesce(F.max(size), F.lit(0)), "without_run": F.coalesce(F.sum(F.when(F.coalesce("last_run_id", F.lit("")) == "", 1).otherwise(0)), F.lit(0))}


def observed(pages: DataFrame, observation: Observation) -> DataFrame:
    """``pages`` with :func:`page_measures` taken in passing, by whatever action reads them."""
    return pages.observe(observation, *[c.alias(name) for name, c in page_measures().items()])
