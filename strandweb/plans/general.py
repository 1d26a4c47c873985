"""Queries of the core data-processing operators (problems 4, 6 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweb.operators.delivery import first_copies, surplus_copies
from strandweb.operators.heavy_keys import distinct_members_per_key, member_pairs, rows_per_key, tree_sum, url_host
from strandweb.operators.history import version_history
from strandweb.session import input_chunks, table

#: Shares from which a host (of all rows) or a link target (of all pairs) is heavy.
HEAVY_HOST, HEAVY_LINK = 0.02, 0.01


def p4_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_data")
    return rows_per_key(pages, url_host(F.col("url"))).select(F.col("key").alias("host"), F.col("total").alias("n_pages"))


def p4_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_data")
    return distinct_members_per_key(pages, "page_id", "links").select(F.col("key").alias("target"), F.col("total").alias("n_referrers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with at least 2 % of all rows, links with at least 1 % of all distinct (page, link) pairs.

    The totals are over all rows; that of the pairs is a scalar subquery on the tree's own result, so the links are exploded once.
    """
    pages = table(spark, sf_dir, "page_data")
    hosts = rows_per_key(pages, url_host(F.col("url")))
    pairs = member_pairs(pages, "page_id", "links")
    links = tree_sum(pairs, F.col("key"), F.lit(1), chunks=input_chunks(pages))
    n_pairs = links.agg(F.sum("total").alias("n")).scalar()
    heavy = lambda d, name, least: d.where(F.col("total") >= least).select(F.lit(name).alias("column_name"), F.col("key").alias("heavy_value"))
    return heavy(hosts, "url", F.lit(HEAVY_HOST * pages.count())).unionByName(heavy(links, "links", n_pairs * HEAVY_LINK))


def p6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per version with its period; ``links`` as text, sorted, so that plain engines can compare it."""
    versions = _versions(spark, sf_dir)
    status = F.col("status")
    return versions.select("url", "version_no", "valid_from", "valid_to", "opened_by", "snapshots", "last_seen", status, F.size("links").alias("n_links"), F.col("last_run_id").alias("opened_by_run"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "page_updates")
    versions = version_history(updates, "url", "last_updated_at", "update_id", ["status"], ["links"], ["last_run_id"])
    clean = F.array_distinct(F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return versions.withColumn("links", F.array_sort(clean))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "page_updates")
    versions = version_history(updates, "url", "last_updated_at", "update_id", ["status"], ["links"])
    return versions.select("url", F.col("version_no").cast("int").alias("version_no"), "opened_by")


def _identity() -> dict:
    return {"run": F.col("run.id"), "url": F.col("url"), "depth": F.col("current_depth")}


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "tasks")
    kept = first_copies(tasks, _identity(), "msg_no", "received_at")
    return kept.select("msg_no", "batch_no", "received_at", "url", "current_depth", F.col("run.id").alias("run_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_copies(table(spark, sf_dir, "tasks"), _identity(), "msg_no", "received_at")


QUERIES = {f.__name__: f for f in (p4_found, p4_hosts, p4_link_targets, p6_found, p6_history, p7_found, p7_messages)}

_HOST = "nullif(lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), ':[0-9]*$', '')), '')"
_HOSTS = f"SELECT {_HOST} AS host, count(*) AS n_pages FROM page_data WHERE {_HOST} IS NOT NULL GROUP BY 1"
_TARGETS = "SELECT target, count(*) AS n_referrers FROM (SELECT DISTINCT page_id, unnest(links) AS target FROM page_data) WHERE target IS NOT NULL GROUP BY 1"
_VERSIONS = """
WITH kept AS (
    SELECT *, list_sort(list_distinct(coalesce(links, []))) AS held FROM page_updates WHERE url IS NOT NULL AND last_updated_at IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY url, last_updated_at ORDER BY update_id DESC) = 1
), flagged AS (
    SELECT *, CASE WHEN row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w OR held IS DISTINCT FROM lag(held) OVER w THEN 1 ELSE 0 END AS opens
    FROM kept WINDOW w AS (PARTITION BY url ORDER BY last_updated_at)
), numbered AS (
    SELECT *, CAST(sum(opens) OVER (PARTITION BY url ORDER BY last_updated_at) AS BIGINT) AS version_no FROM flagged
)"""

SQL = {
    "p4_hosts": _HOSTS,
    "p4_link_targets": _TARGETS,
    "p4_found": f"""SELECT 'url' AS column_name, host AS heavy_value FROM ({_HOSTS}) WHERE n_pages >= {HEAVY_HOST} * (SELECT count(*) FROM page_data)
        UNION ALL SELECT 'links', target FROM ({_TARGETS}) WHERE n_referrers >= {HEAVY_LINK} * (SELECT sum(n_referrers) FROM ({_TARGETS}))""",
    "p6_found": _VERSIONS + " SELECT url, CAST(version_no AS INTEGER) AS version_no, update_id AS opened_by FROM numbered WHERE opens = 1",
    "p6_history": _VERSIONS
    + """, runs AS (
        SELECT url, version_no, min(last_updated_at) AS valid_from, max(last_updated_at) AS last_seen, count(*) AS snapshots, arg_min(update_id, last_updated_at) AS opened_by FROM numbered GROUP BY 1, 2
    ) SELECT r.url, r.version_no, r.valid_from, lead(r.valid_from) OVER (PARTITION BY r.url ORDER BY r.version_no) AS valid_to, r.opened_by, r.snapshots, r.last_seen, n.status,
        CAST(len(n.held) AS INTEGER) AS n_links, n.last_run_id AS opened_by_run FROM runs r JOIN numbered n ON n.update_id = r.opened_by""",
    "p7_found": """SELECT msg_no FROM tasks WHERE run.id IS NOT NULL AND url IS NOT NULL AND current_depth IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run.id, url, current_depth ORDER BY msg_no) > 1""",
    "p7_messages": """SELECT msg_no, batch_no, received_at, url, current_depth, run.id AS run_id FROM tasks WHERE msg_no IN (
        SELECT min(msg_no) FROM tasks WHERE run.id IS NOT NULL AND url IS NOT NULL AND current_depth IS NOT NULL GROUP BY run.id, url, current_depth)""",
}
