"""The crawl loop on the hand-derived mini-site; graph, cache, admission, scans, codecs."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strandweb.operators.admission import admit
from strandweb.operators.cache import lookups
from strandweb.operators.graph import page_edges, upsert_edges, upsert_nodes
from strandweb.operators.robots_cache import no_rules, refreshed, robots_verdict
from strandweb.operators.scan import numbered, running_total
from strandweb.plans.crawl import crawl
from strandweb.schemas import PAGE, ROBOTS, RUN, TASK, WEB
from strandweb.sources.codec import decode_runs, decode_tasks, encode
from strandweb.sources.fetch import FunctionRenderer, SnapshotFetcher
from test_extractors import M1, M2, M3, M4

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
S = "https://site.test"


@pytest.fixture(scope="module")
def site(spark):
    pages = [(S + "/", M1), (S + "/a", M2), (S + "/b.html", "<p>no links</p>"), (S + "/api/data.json", M3), ("http://cdn.test/lib.js", M4)]
    web = spark.createDataFrame([(u, 200, b, None, None) for u, b in pages], WEB)
    robots = spark.createDataFrame([(S, 200, "User-agent: *\nDisallow: /private/\nAllow: /private/ok", None), ("http://cdn.test", 404, "", None), ("https://other.test", None, None, None)], "origin string, status int, body string, cached_at timestamp")
    return SnapshotFetcher(web), robots


def run(spark, *rows):
    return spark.createDataFrame([(i, c, d, n, None, u) for i, c, d, n, u in rows], RUN)


def outcomes(result):
    return {(r.run_id, r.outcome): r.n for r in result.outcomes().collect()}


@pytest.mark.parametrize(
    "limit,levels,want,nodes,edges",
    [
        (15, {0: 1, 1: 7, 2: 7}, {"saved": 5, "fetch_error": 10, "limit_rejected": 9}, (5, 17), 23),
        (30, {0: 1, 1: 7, 2: 16}, {"saved": 6, "fetch_error": 13, "robots_denied": 3, "cache_hit": 2, "limit_rejected": 4}, (6, 16), 27),
    ],
)
def test_mini_site(spark, site, limit, levels, want, nodes, edges):
    fetcher, robots = site
    result = crawl(run(spark, ("test", True, 3, limit, "site.test/")), fetcher, T0, robots)
    assert {r.depth: r["count"] for r in result.tasks.groupBy("depth").count().collect()} == levels
    assert outcomes(result) == {("test", k): n for k, n in want.items()}
    rows = result.nodes.collect()
    assert (sum(r.last_updated_at is not None for r in rows), sum(r.last_updated_at is None for r in rows)) == nodes
    assert all(r.found_at is not None for r in rows) and len({r.url for r in rows}) == len(rows)
    assert result.edges.count() == edges
    kinds = {r.url: r.content_type for r in rows if r.content_type}
    assert kinds[S + "/"] == "text/html; charset=utf-8" and kinds["http://cdn.test/lib.js"] == "text/plain; charset=utf-8"


def test_limits_and_cache(spark, site):
    fetcher, robots = site
    none = crawl(run(spark, ("a", True, 0, 9, "site.test/"), ("b", True, 9, 0, "site.test/"), ("c", None, None, None, None)), fetcher, T0, robots)
    assert outcomes(none) == {(i, "limit_rejected"): 1 for i in "abc"} and none.nodes.count() == 0
    seed = crawl(run(spark, ("s", True, 1, 9, S + "/")), fetcher, T0, robots)
    assert outcomes(seed) == {("s", "saved"): 1, ("s", "limit_rejected"): 7}
    again = crawl(run(spark, ("t", True, 2, 30, "site.test/")), fetcher, T0 + timedelta(hours=11), robots, seed.nodes, seed.edges, seed.cache)
    assert outcomes(again) == {("t", "cache_hit"): 1}
    late = crawl(run(spark, ("u", True, 1, 9, "site.test/")), fetcher, T0 + timedelta(hours=12), robots, seed.nodes, seed.edges, seed.cache)
    assert outcomes(late)["u", "saved"] == 1
    node = late.nodes.where(F.col("url") == S + "/").first()
    assert node.found_at != node.last_updated_at and node.last_run_id == "u" and late.edges.count() == 7


def test_several_runs(spark, site):
    fetcher, robots = site
    runs = run(spark, ("a", True, 2, 30, "site.test/"), ("b", True, 2, 30, "site.test/"), ("n", False, 2, 30, S + "/"))
    both = outcomes(crawl(runs, fetcher, T0, robots))
    assert both["b", "cache_hit"] == 1 and ("b", "saved") not in both and both["a", "saved"] == both["n", "saved"] == 5
    after = outcomes(crawl(runs, fetcher, T0, robots, max_concurrent_runs=1))
    assert after["b", "cache_hit"] == 1 and after["n", "saved"] == 5


def test_loop_without_cache(spark):
    fetcher = SnapshotFetcher(spark.createDataFrame([("http://h/", 200, '<a href="/"> <a href="/x">', None, None)], WEB))
    got = outcomes(crawl(run(spark, ("r", False, 50, 9, "http://h/")), fetcher, T0))
    assert sum(n for (_, o), n in got.items() if o != "limit_rejected") == 9
    assert got["r", "saved"] == 5


def page(url, links, at, found=None, status=200):
    return (url, status, links, "r", T0 + timedelta(hours=at), T0 + timedelta(hours=found if found is not None else at), "t")


def test_graph(spark):
    first = spark.createDataFrame([page("a", ["b", None, "a", "b"], 1), page("a", ["c"], 0), page(None, ["z"], 0), page("d", None, 5)], PAGE)
    nodes, edges = upsert_nodes(None, first), upsert_edges(None, first)
    rows = {r.url: r for r in nodes.collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["a"].links == ["b", None, "a", "b"] and rows["b"].status is None
    hours = lambda r: (r.found_at - T0.replace(tzinfo=None)).total_seconds() / 3600
    assert (hours(rows["a"]), hours(rows["b"]), hours(rows["c"])) == (0, 1, 0)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("a", "a"), ("a", "c")}
    second = spark.createDataFrame([page("b", ["a"], 9), page("a", [], 0, status=404)], PAGE)
    nodes2, edges2 = upsert_nodes(nodes, second), upsert_edges(edges, second)
    rows2 = {r.url: r for r in nodes2.collect()}
    assert rows2["b"].status == 200 and hours(rows2["b"]) == 1 and rows2["a"].links == [] and hours(rows2["a"]) == 0
    assert rows2["a"].status == 404 and edges2.count() == 4
    assert sorted(map(str, upsert_nodes(nodes2, second).collect())) == sorted(map(str, nodes2.collect()))
    assert upsert_nodes(None, first.limit(0)).count() == 0 and page_edges(first.limit(0)).count() == 0


def test_admit(spark):
    rows = [(r, i, n) for r, n in (("a", 3), ("b", 0), ("c", 99)) for i in range(10)]
    df = spark.createDataFrame(rows, "run string, i int, n int")
    for most, in_task in ((None, 10), (99, 1000), (99, 98)):
        assert sorted((r.run, r.i) for r in admit(df, "run", ["i"], F.col("n"), most, in_task).collect()) == [("a", 0), ("a", 1), ("a", 2), *(("c", i) for i in range(10))]


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_running_total(spark, partitions):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "x", None, f"g{i % 9}"]), i, rnd.choice([1, -1])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    total, want = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + v
        want[i] = total[g]
    assert {r.i: r.total for r in running_total(df, ["g"], ["i"], F.col("v"), "total", partitions).collect()} == want
    assert [r.n for r in numbered(df, ["i"], "n", partitions).orderBy("i").collect()] == list(range(1, 401))


def test_lookups(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["k", "k", "l", None]), None if rnd.random() < 0.05 else T0 + timedelta(hours=rnd.randrange(200)), "x") for i in range(500)]
    want, until = {}, {}
    for i, k, t, _ in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[2], r[0])):
        want[i] = k in until and t < until[k]
        if not want[i]:
            until[k] = t + timedelta(hours=12)
    df = spark.createDataFrame(rows, "i int, key string, t timestamp, hit_ string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        assert {r.i: r.hit for r in lookups(df, "key", "t", ["i"]).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert lookups(df.limit(0), "key", "t", ["i"]).count() == 0


def test_codec(spark):
    good = '{"id":"test","use_cache_flag":true,"max_depth":3,"max_links":15,"start_url":"https://example.com/","more":[1]}'
    df = spark.createDataFrame([(good,), ("{not json",), ('{"id":"x","max_depth":"x"}',), ("{}",), (None,), ("",), ("null",), ("[1]",), ('"a"',)], "value string")
    rows = decode_runs(df).orderBy("id").collect()
    assert [r.id for r in rows] == ["", "test"] and rows[0].max_depth == 0 and rows[0].use_cache_flag is False and rows[1].max_links == 15 and rows[1].extra_flags is None
    tasks = spark.createDataFrame([("u", 1, ("r", True, 2, 3, (True, False), "s")), ("v", 0, ("q", False, 0, 0, None, ""))], TASK)
    assert sorted(map(str, decode_tasks(encode(tasks)).collect())) == sorted(map(str, tasks.collect()))
    assert decode_tasks(df).count() == 4 - 1


def test_hot_keys_are_spread(spark):
    """A run, a url and a cache key with a third of all rows: ranked, upserted and looked up right, and no task gets them all."""
    n = 3000
    df = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("run"), F.lit(700).alias("n")).repartition(6)
    ranked = running_total(df, ["run"], ["i"], F.lit(1), "rank", partitions=12)
    assert max(r["count"] for r in df.repartitionByRange(12, "run", "i").groupBy(F.spark_partition_id()).count().collect()) < n // 6
    admitted = admit(df, "run", ["i"], F.col("n"), 700, in_task=10)
    assert admitted.where("run = 'hot'").count() == 700 == ranked.where("run = 'hot' and rank <= 700").count()
    looks = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"), F.timestamp_seconds(F.col("id") % 100 * 3600).alias("t"))
    want, until = {}, {}
    for r in sorted(looks.collect(), key=lambda r: (r.key, r.t, r.i)):
        want[r.i] = r.key in until and r.t < until[r.key]
        if not want[r.i]:
            until[r.key] = r.t + timedelta(hours=12)
    assert {r.i: r.hit for r in lookups(looks.repartition(5), "key", "t", ["i"]).collect()} == want
    # What a task may get of the hot key are its different times, not its rows.
    assert looks.where("key = 'hot'").select("t").distinct().count() == 100


def test_upsert_moves_no_links_by_url(spark):
    first = spark.createDataFrame([page("a", ["b"], 1), page("a", ["c"], 1), page("a", None, 0)], PAGE)
    rows = {r.url: r for r in upsert_nodes(None, first.withColumn("seq", F.lit(None).cast("long"))).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"].links in (["b"], ["c"])
    plan = upsert_nodes(None, first)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and plan.count("SortAggregate") <= 2  # dropDuplicates on rows that are sorted already


def test_robots_cache(spark):
    """Valid rules are kept, stale and unknown ones fetched; missing files and errors aren't cached; the edge of the time to live; empty tables."""
    hours = lambda h: T0 - timedelta(hours=h)
    cache = spark.createDataFrame([("http://a", 200, "A", hours(11)), ("http://b", 200, "B", hours(12)), ("http://z", 200, "Z", hours(1))], ROBOTS)
    web = SnapshotFetcher(spark.createDataFrame([("http://b/robots.txt", 500, "new", None, None), ("http://c/robots.txt", 404, "", None, None)], WEB))
    asked = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://b/1",), ("http://c/1",), ("http://d/1",), ("nonsense",), (None,)], "url string")
    rules, after = refreshed(cache, asked, web, F.lit(T0))
    assert {r.origin: (r.status, r.body) for r in rules.collect()} == {"http://a": (200, "A"), "http://b": (500, "new"), "http://c": (404, ""), "http://d": (None, None)}
    assert {r.origin: r.body for r in after.collect()} == {"http://a": "A", "http://b": "new", "http://z": "Z"}
    verdicts = {r.url: r.allowed for r in robots_verdict(asked.where("url is not null"), rules, "bot").collect()}
    assert verdicts == {"http://a/1": True, "http://a/2": True, "http://b/1": True, "http://c/1": True, "http://d/1": False, "nonsense": False}
    rules, after = refreshed(no_rules(spark), asked.limit(0), web, F.lit(T0))
    assert rules.count() == 0 == after.count()


def test_crawl_fetches_rules_and_renders(spark, site):
    pages = [("http://r/", 200, '<a href="/app">', None, None), ("http://r/app", 200, "<p>script only</p>", None, None), ("http://r/secret", 200, "x", None, None), ("http://r/robots.txt", 200, "User-agent: strandweb\nDisallow: /secret", None, None)]
    fetcher = SnapshotFetcher(spark.createDataFrame(pages, WEB))
    renderer = FunctionRenderer(lambda url, body: body + '<a href="/secret">' if url.endswith("app") else None)
    runs = spark.createDataFrame([("plain", False, 3, 9, None, "http://r/"), ("wide", False, 3, 9, (False, True), "http://r/")], RUN)
    result = crawl(runs, fetcher, T0, robots_fetcher=fetcher, renderer=renderer)
    assert outcomes(result) == {("plain", "saved"): 2, ("wide", "saved"): 2, ("wide", "robots_denied"): 1}
    assert [tuple(r) for r in result.robots.select("origin", "status").collect()] == [("http://r", 200)]
    late = crawl(run(spark, ("u", True, 1, 9, "http://r/secret")), SnapshotFetcher(spark.createDataFrame(pages[:3], WEB)), T0 + timedelta(hours=11), result.robots, robots_fetcher=SnapshotFetcher(spark.createDataFrame([], WEB)))
    assert outcomes(late) == {("u", "robots_denied"): 1}
