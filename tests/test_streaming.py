"""Streams over files: runs to graph versions, messages out, the gate's state across batches, SQL functions."""

import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from strandweb.functions.udfs import register
from strandweb.schemas import WEB
from strandweb.sources.codec import decode_tasks
from strandweb.sources.fetch import HttpFetcher, SnapshotFetcher
from strandweb.operators.runs import child_tasks, drained, new_runs, seed_tasks
from strandweb.streaming.stream import GraphStore, MessageQueue, crawl_runs, gate_stream, read_messages, write_messages

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def test_runs_to_graph(spark, tmp_path):
    inbox, store = tmp_path / "in", GraphStore(spark, str(tmp_path / "graph"))
    inbox.mkdir()
    fetcher = SnapshotFetcher(spark.createDataFrame([("http://h/", 200, '<a href="/a">', None, None), ("http://h/a", 200, '<a href="/">', None, None)], WEB))
    go = lambda at: crawl_runs(read_messages(spark, "text", str(inbox)), store, fetcher, str(tmp_path / "offsets"), as_of=lambda: at, once=True).awaitTermination(120)
    (inbox / "1.json").write_text('{"id":"r1","use_cache_flag":true,"max_depth":1,"max_links":5,"start_url":"http://h/"}\n{not json\n{"id":"r0","max_depth":"x"}\n')
    assert go(T0)
    assert store.versions() == [0] and store.read()["nodes"].count() == 2 and store.read()["edges"].count() == 1
    (inbox / "2.json").write_text('{"id":"r2","use_cache_flag":true,"max_depth":2,"max_links":5,"start_url":"http://h/a"}\n')
    assert go(T0 + timedelta(hours=1))
    nodes = {r.url: r for r in store.read()["nodes"].collect()}
    assert store.versions() == [0, 1] and nodes["http://h/a"].last_run_id == "r2" and nodes["http://h/"].last_run_id == "r1"
    assert store.read()["edges"].count() == 2 and store.read(before=1)["edges"].count() == 1


def test_messages_out(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("u", 1), ("v", None)], "url string, current_depth int").write.json(str(source))
    rows = spark.readStream.schema("url string, current_depth int").json(str(source))
    assert write_messages(rows, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination(60)
    assert sorted((r.url, r.current_depth) for r in decode_tasks(spark.read.text(str(tmp_path / "out"))).collect()) == [("u", 1), ("v", 0)]


def test_gate(spark, tmp_path):
    source, schema = tmp_path / "in", "k string, t timestamp"
    source.mkdir()
    stream = gate_stream(spark.readStream.schema(schema).parquet(str(source)), "k", "t")
    batches = [[("a", 0), ("a", 11), ("b", 1), (None, 1)], [("a", 12), ("a", 13), ("b", 12.9)], [("b", 13), ("a", 24)]]
    got = []
    for rows in batches:
        spark.createDataFrame([(k, T0 + timedelta(hours=h)) for k, h in rows], schema).coalesce(1).write.mode("append").parquet(str(source))
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    hours = lambda t: (t - T0.replace(tzinfo=None)).total_seconds() / 3600
    assert {(r.key, hours(r.time)): r.hit for r in got} == {("a", 0): False, ("a", 11): True, ("b", 1): False, ("a", 12): False, ("a", 13): True, ("b", 12.9): True, ("b", 13): False, ("a", 24): False}


def test_slots_requeue_callback_and_measures(spark, tmp_path):
    """Runs beyond the slots go back to the queue; each batch's outcomes are told; pages are measured; old versions go; rules are cached."""
    inbox, store, told = tmp_path / "in", GraphStore(spark, str(tmp_path / "graph"), keep=2), []
    inbox.mkdir()
    queue = MessageQueue(str(inbox))
    pages = [("http://h/", '<a href="/a"> <a href="/no">'), ("http://h/a", '<a href="/">'), ("http://h/robots.txt", "User-agent: *\nDisallow: /no")]
    fetcher = SnapshotFetcher(spark.createDataFrame([(u, 200, b, None, None) for u, b in pages], WEB))
    runs = new_runs(spark.createDataFrame([("http://h/",), ("h/a",), ("http://h/",), (None,)], "u string"), "u", 3, 9)
    assert all(len(r.id) == 40 and r.use_cache_flag and r.extra_flags is None for r in runs.collect())
    queue.send_runs(runs.withColumn("id", F.concat(F.lit("r"), F.monotonically_increasing_id())))
    for _ in range(4):
        stream = crawl_runs(
            read_messages(spark, "text", str(inbox)), store, fetcher, str(tmp_path / "offsets"), as_of=lambda: T0, once=True, slots=1, requeue=queue,
            done=lambda n, outcomes: told.append({(r.run_id, r.outcome): r.n for r in outcomes.collect()}), robots_fetcher=fetcher,
        )
        assert stream.awaitTermination(200)
    assert len(told) == 4 and len({r for t in told for r, _ in t}) == 4
    assert sum(t.get((r, "saved"), 0) for t in told for r, _ in t) >= 2 and any(o == "robots_denied" for t in told for _, o in t)
    assert len(store.versions()) == 2 and store.read()["robots"].count() == 1 and set(store.measures) == {"n_pages", "n_links", "most_links", "without_run"}


def test_tasks_to_a_queue(spark, tmp_path):
    runs = new_runs(spark.createDataFrame([("h/x",)], "u string"), "u", 3, 9, rendered=True, id_=F.lit("r"))
    seeds = seed_tasks(runs)
    children = child_tasks(seeds.withColumn("links", F.array(F.lit("http://h/1"), F.lit(None), F.lit("http://h/2"))))
    queue = MessageQueue(str(tmp_path / "tasks"))
    queue.send_tasks(seeds)
    queue.send_tasks(children)
    queue.send_tasks(children.limit(0))
    got = decode_tasks(spark.read.text(str(tmp_path / "tasks")))
    assert sorted((r.url, r.current_depth, r.run.id, r.run.extra_flags.parse_rendered_html) for r in got.collect()) == [("http://h/1", 1, "r", True), ("http://h/2", 1, "r", True), ("https://h/x", 0, "r", True)]
    many = spark.range(230).select(F.col("id").cast("string").alias("url"), F.lit(0).alias("current_depth"), F.lit(None).cast(seeds.schema["run"].dataType).alias("run")).coalesce(1)
    MessageQueue(str(tmp_path / "many")).send_tasks(many)
    assert max(len(f.read_text().splitlines()) for f in (tmp_path / "many").glob("part-*")) == 50
    assert drained(spark.read.text(str(tmp_path / "many")), 7).count() == 7


@pytest.mark.parametrize("rows", [4, 10_000])
def test_gate_is_in_order_whatever_the_frames(spark, tmp_path, rows):
    """Look-ups of one key come out of order and in small frames: the misses are those of the times in order."""
    source, schema = tmp_path / "in", "k string, t timestamp"
    hours = [17, 3, 9, 0, 13, 6, 25, 11, 2, 20, 12, 5, 24]
    spark.createDataFrame([("a", T0 + timedelta(hours=h)) for h in hours], schema).coalesce(1).write.parquet(str(source))
    got = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        stream = gate_stream(spark.readStream.schema(schema).parquet(str(source)), "k", "t")
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.time - T0.replace(tzinfo=None)).total_seconds() / 3600 for r in got if not r.hit) == [0, 12, 24] and len(got) == len(hours)


def test_sql_functions(spark):
    register(spark)
    rows = spark.sql("""SELECT d.n, l.link FROM VALUES (1, 'http://h/', '<a href="/x">'), (2, 'http://h/a.js', 'fetch("y")'), (3, 'http://h/', NULL) d(n, url, body), LATERAL document_links(d.url, d.body) l""").collect()
    assert sorted(map(tuple, rows)) == [(1, "http://h/x"), (2, "http://h/y")]
    assert spark.sql("SELECT normalize_url(' //a ') a, resolve_url('x', 'http://h') b, url_origin('http://h/x') c, correct_scheme('h') d").first() == ("http://a", "http://h/x", "http://h", "https://h")


def test_live_fetcher_drops_errors(spark):
    got = HttpFetcher(timeout=1).fetch(spark.createDataFrame([("http://127.0.0.1:9/", 1), ("nonsense", 2)], "url string, n int"))
    assert got.count() == 0 and {"status", "body", "n"} <= set(got.columns)


@pytest.mark.parametrize("name", ["kafka"])
def test_other_sources_are_an_option(spark, name):
    with pytest.raises(Exception, match="(?i)kafka"):
        read_messages(spark, name, subscribe="runs")


def test_live_fetcher(spark):
    """Requests to a server of our own: any status counts, redirects are followed, the type is sniffed, fragments aren't sent."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = {"/page": (200, b"<html> \xc3\xa4"), "/gone": (404, b"none"), "/data": (200, b"%PDF-1"), "/empty": (200, b"")}.get(self.path, (302, b""))
            self.send_response(status)
            if status == 302:
                self.send_header("Location", "/page")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        home = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(home + p, i) for i, p in enumerate(["/page#top", "/gone", "/data", "/empty", "/moved"])], "url string, n int").repartition(3)
        got = {r.n: (r.status, r.body, r.content_type) for r in HttpFetcher(timeout=10).fetch(urls).collect()}
    finally:
        server.shutdown()
    html = "text/html; charset=utf-8"
    assert got == {0: (200, "<html> ä", html), 1: (404, "none", "text/plain; charset=utf-8"), 2: (200, "%PDF-1", "application/pdf"), 3: (200, "", "application/octet-stream"), 4: (200, "<html> ä", html)}
