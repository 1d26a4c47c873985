"""The page graph: upserts of crawled pages, and reads.

A page overwrites its node's columns and keeps the node's ``found_at``; a link target that has no node becomes a stub with
the linking page's ``found_at``; edges are only ever added. Of several pages with one url the one with the highest
``(last_updated_at, seq)`` counts, of rows equal in both any one. Pages without url are no pages; null links are none; a page that links itself has that
edge. Applying the same batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERWRITTEN = ["status", "links", "last_run_id", "last_updated_at", "content_type"]


def page_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of the pages' links."""
    flat = pages.where(F.col("url").isNotNull()).select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    return flat.where(F.col("dst").isNotNull()).distinct()


def upsert_edges(edges: DataFrame | None, pages: DataFrame) -> DataFrame:
    new = page_edges(pages)
    return new if edges is None else edges.select("src", "dst").unionByName(new).distinct()


#: Places of the packed rank: bits of the time in microseconds since 1700 (0: none) and of ``seq``.
_TIME_BITS, _SEQ_BITS = 54, 64
_OFFSET_US, _SPAN_US = 8_520_336_000_000_000, 15_778_800_000_000_000


def _rank(new: int, seq: Column) -> Column:
    """``(new, last_updated_at, seq)`` as one decimal of the same order (no time lowest), which aggregates in place."""
    since = F.unix_micros("last_updated_at") + _OFFSET_US
    at = F.when(F.col("last_updated_at").isNotNull(), F.greatest(F.lit(0), F.least(since, F.lit(_SPAN_US))) + 1).otherwise(F.lit(0).cast("long"))
    high = (at + F.lit(new << _TIME_BITS)).cast("decimal(17,0)") * F.lit(str(1 << _SEQ_BITS)).cast("decimal(20,0)")
    return (high + F.coalesce(seq, F.lit(-(1 << 63))).cast("decimal(19,0)")).cast("decimal(38,0)")


def upsert_nodes(nodes: DataFrame | None, pages: DataFrame) -> DataFrame:
    """Nodes after the batch.

    One hash aggregation by url over the old nodes, the pages and their link targets, which moves ranks and times only; the rows that
    count are joined to it once, by url and rank.
    """
    seq = F.col("seq").cast("long") if "seq" in pages.columns else F.lit(0).cast("long")
    moment, number = "timestamp", "decimal(38,0)"
    known = pages.where(F.col("url").isNotNull())
    rows = known.select("url", *OVERWRITTEN, _rank(1, seq).alias("rank"), F.col("found_at").alias("new_found"), F.lit(None).cast(moment).alias("old_found"))
    targets = known.select(F.explode("links").alias("url"), F.col("found_at").alias("new_found")).where(F.col("url").isNotNull())
    if nodes is not None:
        crawled = F.col("last_updated_at").isNotNull() | F.col("links").isNotNull() | F.col("status").isNotNull()
        rows = rows.unionByName(nodes.select("url", *OVERWRITTEN, F.when(crawled, _rank(0, F.lit(0).cast("long"))).alias("rank"), F.lit(None).cast(moment).alias("new_found"), F.col("found_at").alias("old_found")))
    light = rows.select("url", "rank", "new_found", "old_found").unionByName(targets.select("url", F.lit(None).cast(number).alias("rank"), "new_found", F.lit(None).cast(moment).alias("old_found")))
    merged = light.groupBy("url").agg(F.max("rank").alias("top"), F.coalesce(F.min("old_found"), F.min("new_found")).alias("found_at"))
    # Joined by url alone, whose partitioning the aggregation has; the ranks are compared on the way. Stubs have no rank.
    payload = rows.where("rank is not null").select(F.col("url").alias("own"), "rank", *OVERWRITTEN)
    joined = merged.join(payload, (F.col("url") == F.col("own")) & (F.col("rank") >= F.col("top")), "left")
    return joined.dropDuplicates(["url"]).select("url", "status", "links", "last_run_id", "last_updated_at", "found_at", "content_type")


def in_degree(edges: DataFrame) -> DataFrame:
    """``dst, in_degree``; the edges are distinct, and the count is combined on the map side."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))
