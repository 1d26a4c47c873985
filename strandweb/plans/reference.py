"""Queries of the crawl engine's operators over whole tables, and their SQL.

The tables hold pages and links but no documents; queries that need a document build it from a page's links.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweb.functions import urls
from strandweb.functions.html_links import ADDRESS_ATTRIBUTES
from strandweb.functions.sniff import content_type_column
from strandweb.functions.udfs import correct_scheme_of, html_links_of, json_links_of, script_links_of
from strandweb.operators import cache as page_cache
from strandweb.operators.admission import admit, within_depth
from strandweb.operators.graph import in_degree, page_edges, upsert_nodes
from strandweb.operators.heavy_keys import url_host
from strandweb.operators.scan import numbered, running_total
from strandweb.operators.robots_cache import live_rules, refreshed, robots_verdict
from strandweb.operators.runs import child_tasks, new_runs, page_measures, seed_tasks
from strandweb.plans.crawl import Crawl, crawl
from strandweb.schemas import CACHE, RUN
from strandweb.session import spread, table
from strandweb.sources.codec import decode_runs, decode_tasks, encode
from strandweb.sources.fetch import SnapshotFetcher

AS_OF = datetime(2025, 10, 1, tzinfo=timezone.utc)
ROBOTS_TEXT = "User-agent: *\nDisallow: /search\nAllow: /search/ok\nDisallow: /login$\nDisallow: /*.html$\nAllow: /wiki/*.html$\n"


def _anchors(links: Column) -> Column:
    return F.concat(F.lit("<!doctype html><html><body>"), F.array_join(F.transform(links, lambda x: F.concat(F.lit('<a href="'), x, F.lit('">go</a>\n'))), ""), F.lit("</body></html>"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for extraction, on all cores."""
    return spread(table(spark, sf_dir, "page_data").where(F.col("url").isNotNull()))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page's document, extracted from HTML."""
    pages = _pages(spark, sf_dir)
    return pages.select("page_id", F.explode(html_links_of(_anchors(F.col("links")), F.col("url"))).alias("link"))


def srcset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of image candidate lists that hold the pages' link paths."""
    path = lambda x: F.regexp_replace(x, "^https?://[^/?#]*", "")
    listed = F.array_join(F.transform(F.col("links"), lambda x, i: F.concat(path(x), F.lit(" "), i.cast("string"), F.lit("x"))), ", ")
    body = F.concat(F.lit("<img srcset='"), listed, F.lit("'>"))
    return _pages(spark, sf_dir).select("page_id", F.explode(html_links_of(body, F.col("url"))).alias("link"))


def json_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page's JSON: neither cut at fragments nor cleaned."""
    body = F.to_json(F.struct(F.col("page_id").alias("/id"), F.struct("links", F.col("content_type").alias("kind")).alias("page")))
    return _pages(spark, sf_dir).select("page_id", F.explode(json_links_of(body, F.col("url"))).alias("link"))


def script_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a script that requests the page's own path in several ways."""
    head, path = F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.regexp_replace("url", "^https?://[^/?#]*", "")
    number = F.col("page_id").cast("string")
    body = F.concat(
        F.lit('var base = "'), head, F.lit('";\nfunction load(){ return fetch(base + "'), path, F.lit('"); }\nconst x = new XMLHttpRequest(); x.open("GET", `/api/${'), number,
        F.lit('}`);\n$.ajax({type: "POST", url: "jq?id=" + '), number, F.lit("}); $.ajax(base);"),
    )
    return _pages(spark, sf_dir).select("page_id", F.explode(script_links_of(body, F.col("url"))).alias("link"))


def attribute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of elements that hold each page's link paths in every attribute there is for addresses."""
    end = {"srcset": " 2x", "data-srcset": " 2x, "}
    held = lambda x: [p for a in ADDRESS_ATTRIBUTES for p in (F.lit(f' {a}="/x'), x, F.lit(f'/{a}{end.get(a, "")}"'))]
    element = lambda x: F.concat(F.lit("<i"), *held(F.regexp_replace(x, "^https?://[^/?#]*|[?#].*$", "")), F.lit(">"))
    body = F.array_join(F.transform("links", element), "\n")
    return _pages(spark, sf_dir).select("page_id", F.explode(html_links_of(body, F.col("url"))).alias("link"))


def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a script in an HTML page that asks for the page's own number through objects, calls with options and other libraries."""
    number = F.col("page_id").cast("string")
    pieces = (
        '<p>no link</p><script type=" Text/JavaScript "> const cfg = {api: "/api/', number, '", deep: 1}; axios.get(cfg.api); $.get("g?x=', number, '"); $.post(cfg["api"] + "/p"); jQuery.ajax({type: "GET", url: "/j/', number,
        '"}); axios({url: `/ax/${', number, '}`}); $.getJSON("/n/" + ', number, ' + ".json"); other("plain"); let y; y = "/late/" + ', number, '; fetch(y);</script><script type="text/template"> fetch("/never") </script>',
    )
    body = F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in pieces])
    return _pages(spark, sf_dir).select("page_id", F.explode(html_links_of(body, F.col("url"))).alias("link"))


#: Beginnings of bodies, and the types that they make.
_BEGINNINGS = [
    ("%PDF-", "application/pdf"), ("%!PS-Adobe-", "application/postscript"), ("BM", "image/bmp"), ("GIF87a", "image/gif"), ("GIF89a", "image/gif"), (".snd", "audio/basic"), ("OggS\0", "application/ogg"),
    ("MThd\0\0\0\6", "audio/midi"), ("ID3", "audio/mpeg"), ("\0\1\0\0", "font/ttf"), ("OTTO", "font/otf"), ("ttcf", "font/collection"), ("wOFF", "font/woff"), ("wOF2", "font/woff2"), ("PK\3\4", "application/zip"),
    ("Rar!\x1a\7\0", "application/x-rar-compressed"), ("\0asm", "application/wasm"), ("\0\0\1\0", "image/x-icon"), ("\0\0\2\0", "image/x-icon"), ("RIFF1234WEBPVP", "image/webp"), ("RIFF1234AVI ", "video/avi"),
    ("RIFF1234WAVE", "audio/wave"), ("FORM1234AIFF", "audio/aiff"), ("\0\0\0\x18ftypisom1234mp42abcd", "video/mp4"), ("\t <?xml ", "text/xml; charset=utf-8"), ("\ufeffx", "text/plain; charset=utf-8"), ("\n<!--", "text/html; charset=utf-8"),
    ("<Br>", "text/html; charset=utf-8"), ("<brx ", "text/plain; charset=utf-8"), ("a\1", "application/octet-stream"), ("{", "text/plain; charset=utf-8"),
]


def sniffed_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of all documents after each got one of the beginnings."""
    begun = F.get(F.array(*[F.lit(b) for b, _ in _BEGINNINGS]), F.pmod("doc_id", F.lit(len(_BEGINNINGS))).cast("int"))
    bodies = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(len(_BEGINNINGS))).cast("int").alias("beginning"), F.concat(begun, F.coalesce("text", F.lit(""))).alias("body"))
    return bodies.groupBy("beginning", content_type_column(F.col("body")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_edges(table(spark, sf_dir, "page_data"))


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("url", "status", F.coalesce(F.size("links"), F.lit(-1)).alias("n_links"), "last_run_id", "last_updated_at", "found_at", "content_type")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(upsert_nodes(None, table(spark, sf_dir, "page_data").withColumn("seq", F.col("page_id"))))


def graph_remerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after a second batch, the page updates."""
    nodes = upsert_nodes(None, table(spark, sf_dir, "page_data").withColumn("seq", F.col("page_id")))
    return _shown(upsert_nodes(nodes, table(spark, sf_dir, "page_updates").withColumn("seq", F.col("update_id"))))


def in_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 pages with most incoming edges."""
    return in_degree(page_edges(table(spark, sf_dir, "page_data"))).orderBy(F.desc("in_degree"), "dst").limit(100)


def host_link_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = page_edges(table(spark, sf_dir, "page_data"))
    hosts = edges.select(url_host(F.col("src")).alias("src_host"), url_host(F.col("dst")).alias("dst_host"))
    return hosts.where("src_host is not null and dst_host is not null").groupBy("src_host", "dst_host").agg(F.count(F.lit(1)).alias("n_edges"))


def url_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "page_data").select("url").unionByName(table(spark, sf_dir, "tasks").select("url"))
    return both.where("url is not null").groupBy(urls.origin_column(F.col("url")).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def url_correct_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start urls, and page urls that lost their scheme."""
    bare = _pages(spark, sf_dir).select(F.regexp_replace("url", "^https?://", "").alias("given"))
    given = table(spark, sf_dir, "runs").select(F.col("start_url").alias("given")).where("given is not null").unionByName(bare)
    return given.select("given", correct_scheme_of(F.col("given")).alias("corrected"))


def script_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = page_edges(table(spark, sf_dir, "page_data"))
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).select("dst", "n", urls.is_script_url_column(F.col("dst")).alias("is_script"))


def screenshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only for tasks whose flags ask for one; flags may be null."""
    tasks = table(spark, sf_dir, "tasks").where(F.col("run.extra_flags").isNotNull() & F.col("run.extra_flags.should_screenshot") & F.col("url").isNotNull())
    return tasks.select("msg_no", urls.screenshot_name_column(F.col("url")).alias("path"))


def normalize_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link in the ways in which markup spells it."""
    link = F.col("link")
    rest = F.regexp_replace(link, "^https?:", "")
    forms = F.array(
        link, F.concat(F.lit(" \n'"), link, F.lit("#top' ")), rest, F.regexp_replace(link, "^https?://[^/]*", ""), F.regexp_replace(link, "^https?://", ""), F.concat(F.lit("mailto:"), rest), F.concat(F.lit("#"), link),
        F.concat(link, F.lit("!),.")), F.upper(link),
    )
    flat = page_edges(table(spark, sf_dir, "page_data")).select(F.col("dst").alias("link")).distinct().select("link", F.posexplode(forms).alias("form", "raw"))
    return flat.select("link", "form", urls.normalize_column(F.col("raw")).alias("normalized"))


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of pages, and whether each is taken for a path."""
    pages = table(spark, sf_dir, "page_data")
    strings = pages.select(F.explode(F.concat(F.array("content_type", F.regexp_replace("url", "^https?://[^/]*", "")), F.coalesce(F.split("url", "[/?#]"), F.array()))).alias("s"))
    return strings.where("s is not null").distinct().select("s", urls.looks_like_relative_path_column(F.col("s")).alias("is_path"))


def content_type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "page_dumps").select(F.col("body").alias("text")))
    html = _pages(spark, sf_dir).select(_anchors(F.coalesce("links", F.array().cast("array<string>"))).alias("text"))
    return bodies.unionByName(html).groupBy(content_type_column(F.col("text")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tasks may be fetched, with rules for each origin: none on plain http, unknown ones for the ``.example`` hosts with a port."""
    tasks = table(spark, sf_dir, "tasks").where("url is not null").select("msg_no", "url")
    origins = tasks.select(urls.origin_column(F.col("url")).alias("origin")).where("origin is not null").distinct()
    status = F.when(F.col("origin").startswith("http:"), 404).when(F.col("origin").rlike("(?i)[.]example:"), F.lit(None)).otherwise(200)
    rules = origins.select("origin", status.alias("status"), F.lit(ROBOTS_TEXT).alias("body"), F.lit(None).cast("timestamp").alias("cached_at"))
    verdicts = robots_verdict(tasks.select("url").distinct(), rules, "strandweb")
    return tasks.join(verdicts, "url").select("msg_no", "allowed")


def cache_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cache of 12 hours knows a task's url; read in order of arrival times."""
    return page_cache.lookups(table(spark, sf_dir, "tasks").select("msg_no", "url", "received_at"), "url", "received_at", ["msg_no"]).select("msg_no", "hit")


def run_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "tasks").where("run.id is not null").select("msg_no", F.col("current_depth").alias("depth"), F.col("run.id").alias("run_id"), F.coalesce("run.max_links", F.lit(0)).alias("max_links"), F.col("run.max_depth").alias("max_depth"))
    most = tasks.agg(F.max("max_links")).first()[0] or 0
    return admit(tasks.where(within_depth(F.col("depth"), F.col("max_depth"))), "run_id", ["msg_no"], F.col("max_links"), most).select("msg_no", "run_id", "rank")


def active_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks of each run: a message without a depth closes one, any other opens one."""
    tasks = table(spark, sf_dir, "tasks").select("msg_no", F.col("run.id").alias("run_id"), "current_depth")
    step = F.when(F.col("current_depth").isNull(), -1).otherwise(1)
    return running_total(tasks, ["run_id"], ["msg_no"], step, "active").select("msg_no", "active")


def run_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in the batches of three in which they get slots."""
    runs = numbered(table(spark, sf_dir, "runs").select("id"), ["id"], "number")
    return runs.select("id", F.expr("(number - 1) div 3").alias("batch"))


def task_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks written as messages and read back, among as many messages that are cut off."""
    messages = encode(table(spark, sf_dir, "tasks"), "url", "current_depth", "run")
    cut = messages.select(F.expr("substr(value, 1, length(value) - 1)").alias("value"))
    tasks = decode_tasks(messages.unionByName(cut))
    return tasks.select("url", "current_depth", F.col("run.id").alias("run_id"), F.col("run.max_depth").alias("max_depth"), F.col("run.max_links").alias("max_links"), F.col("run.use_cache_flag").alias("use_cache_flag"), F.col("run.start_url").alias("start_url"))


def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as messages and read back, among messages with a limit that is no number."""
    messages = encode(table(spark, sf_dir, "runs"), *(f.name for f in RUN))
    bad = messages.select(F.regexp_replace("value", '"max_depth":[0-9]+', '"max_depth":"deep"').alias("value")).where(F.col("value").contains('"deep"'))
    runs = decode_runs(messages.unionByName(bad))
    flags = [F.col(f"extra_flags.{c}").alias(c) for c in ("should_screenshot", "parse_rendered_html")]
    return runs.select("id", "use_cache_flag", "max_depth", "max_links", "start_url", *flags)


def run_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first task of runs made for all pages' hosts."""
    hosts = table(spark, sf_dir, "page_data").select(url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    runs = new_runs(hosts, "host", 3, 100, rendered=True, id_=F.sha1(F.col("host")))
    return seed_tasks(runs).select("url", "current_depth", F.col("run.id").alias("run_id"), F.col("run.use_cache_flag").alias("use_cache"), F.col("run.extra_flags.parse_rendered_html").alias("rendered"), F.col("run.extra_flags.should_screenshot").alias("screenshot"))


def child_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of all links of the pages that a task message asked for, one level deeper, through messages and back."""
    pages = table(spark, sf_dir, "page_data").where("url is not null").groupBy("url").agg(F.min_by("links", "page_id").alias("links"))
    asked = table(spark, sf_dir, "tasks").where("url is not null and run.id is not null").join(pages, "url").select("url", "current_depth", "run", "links")
    back = decode_tasks(encode(child_tasks(asked), "url", "current_depth", "run"))
    return back.groupBy(F.col("run.id").alias("run_id"), "current_depth").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("url").alias("n_urls"))


def page_measures_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what is observed of pages that are saved."""
    return table(spark, sf_dir, "page_data").agg(*[c.alias(name) for name, c in page_measures().items()])


def cache_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page cache after the pages and then their updates were written to it, by the time of writing."""
    rows = lambda name: table(spark, sf_dir, name).where("last_updated_at is not null").select("url", "links", F.col("last_updated_at").alias("cached_at"))
    cache = page_cache.write(page_cache.write(spark.createDataFrame([], CACHE), rows("page_data")), rows("page_updates"))
    return page_cache.live(cache, F.lit(AS_OF).cast("timestamp"), 24 * 20).select("url", "cached_at")


def robots_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of all tasks' origins from a cache in which a third are valid and a third are out of date; what isn't valid is fetched: no file on plain
    http, none to be had from the ``.example`` hosts with a port."""
    tasks = table(spark, sf_dir, "tasks").where("url is not null").select("url")
    origins = tasks.select(urls.origin_column(F.col("url")).alias("origin")).where("origin is not null").distinct()
    now, third = F.lit(AS_OF).cast("timestamp"), F.length("origin") % 3
    cache = origins.where(third < 2).select("origin", F.lit(200).alias("status"), F.lit("User-agent: *").alias("body"), (now - F.when(third == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 12 HOURS"))).alias("cached_at"))
    status = F.when(F.col("origin").startswith("http:"), 404).otherwise(200)
    files = origins.where(~F.col("origin").rlike("(?i)^https.*[.]example:")).select(F.concat("origin", F.lit("/robots.txt")).alias("url"), status.alias("status"), F.lit(ROBOTS_TEXT).alias("body"))
    rules, after = refreshed(cache, tasks, SnapshotFetcher(files), now)
    valid = live_rules(after, now).select("origin", F.lit(True).alias("in_cache"))
    return rules.join(valid, "origin", "left").select("origin", F.coalesce("status", F.lit(-1)).alias("status"), F.length("body").alias("n_chars"), F.coalesce("in_cache", F.lit(False)).alias("in_cache"))


def _part_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web of one page per part, each with links to two others, and to a third one once it is rendered; and its rules for robots."""
    parts = table(spark, sf_dir, "part")
    n = parts.count()
    k = F.pmod(F.col("p_partkey"), F.lit(n))
    link = lambda to: F.concat(F.lit('<a href="/'), F.pmod(to, F.lit(n)).cast("string"), F.lit('">'))
    body = F.concat(link(k * 2), link(k * 3 + 1))
    pages = parts.select(F.concat(F.lit("http://w.test/"), k.cast("string")).alias("url"), F.lit(200).alias("status"), body.alias("body"), F.concat(body, link(k * 5 + 2)).alias("rendered_html"))
    return pages.unionByName(spark.createDataFrame([("http://w.test/robots.txt", 200, "User-agent: *\nDisallow: /*7$\n", None)], pages.schema))


def _part_crawl(spark: SparkSession, sf_dir: str, cached: bool, depth: int, rendered: bool = False, robots: bool = False) -> Crawl:
    runs = spark.createDataFrame([("bfs", cached, depth, 1_000_000, (False, rendered), "http://w.test/1")], RUN)
    fetcher = SnapshotFetcher(_part_web(spark, sf_dir))
    return crawl(runs, fetcher, AS_OF, robots_fetcher=fetcher if robots else None)


def crawl_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a crawl that fetches the rules itself and asks them, saved or denied, with the first level of each."""
    tasks = _part_crawl(spark, sf_dir, True, 7, robots=True).tasks
    return tasks.where("outcome in ('saved', 'robots_denied')").groupBy("url", "outcome").agg(F.min("depth").alias("depth"))


def crawl_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page rows of a crawl that reads rendered documents."""
    pages = _part_crawl(spark, sf_dir, True, 5, rendered=True).pages
    return pages.select("url", "depth", "status", F.size("links").alias("n_links"), "last_run_id", "content_type", (F.col("last_updated_at") == F.col("found_at")).alias("new"))


def crawl_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of four runs, one after the other: the second finds its seed in the cache, the third uses none, the last may not do anything."""
    rows = [("a", True, 4, 1000, None, "http://w.test/1"), ("b", True, 4, 1000, None, "http://w.test/1"), ("c", False, 4, 1000, None, "http://w.test/1"), ("d", True, 4, 0, None, "http://w.test/1")]
    return crawl(spark.createDataFrame(rows, RUN), SnapshotFetcher(_part_web(spark, sf_dir)), AS_OF, max_concurrent_runs=1).outcomes()


def crawl_bfs_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a crawl that meets each once, with the level at which it does."""
    return _part_crawl(spark, sf_dir, True, 8).tasks.where("outcome = 'saved'").select("url", "depth")


def crawl_bfs_nocache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches per page and level of a crawl without cache: one for each path."""
    return _part_crawl(spark, sf_dir, False, 6).tasks.groupBy("url", "depth").agg(F.count(F.lit(1)).alias("n_fetches"))


def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all runs, crawled at once over the known pages."""
    pages = _pages(spark, sf_dir).select("url", "page_id", F.coalesce("status", F.lit(200)).alias("status"), _anchors(F.col("links")).alias("body"), "content_type")
    return crawl(table(spark, sf_dir, "runs"), SnapshotFetcher(pages, "page_id"), AS_OF).outcomes()


QUERIES = {
    f.__name__: f
    for f in (
        page_links, srcset_links, json_links, script_links, attribute_links, script_calls, sniffed_beginnings, graph_edges, graph_nodes, graph_remerge, in_degree_topk, host_link_matrix, url_origin, url_correct_scheme, script_urls, screenshot_paths, normalize_links,
        relative_paths, content_type_sniff, robots_filter, cache_gate, run_admission, active_balance, run_batches, task_roundtrip, run_roundtrip, run_seeds,
        child_messages, page_measures_all, cache_write, robots_cache, crawl_bfs_cached, crawl_bfs_nocache, crawl_robots, crawl_rendered, crawl_slots, run_outcomes,
    )
}


def _escaped(part: str) -> str:
    """SQL: a path (or fragment) as an address is written, kept if it is plain."""
    out = f"url_encode(url_decode({part}))"
    for code, char in (("2F", "/"), ("3A", ":"), ("40", "@"), ("24", "$"), ("26", "&"), ("2B", "+"), ("2C", ","), ("3B", ";"), ("3D", "=")):
        out = f"replace({out}, '%{code}', '{char}')"
    return f"CASE WHEN regexp_full_match({part}, '[!-~]*') THEN {part} ELSE {out} END"


_HEAD = "regexp_extract({0}, '^[a-z]+://[^/?#]*')"
_PATH = "regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1)"
_FRAGMENT = "regexp_extract({0}, '#(.*)$', 1)"


def _resolved(link: str, keep_fragment: bool = False) -> str:
    """SQL: an absolute link as :func:`resolve` writes it."""
    path = _PATH.format(link)
    tail = f" || CASE WHEN {_FRAGMENT.format(link)} = '' THEN '' ELSE '#' || ({_escaped(_FRAGMENT.format(link))}) END" if keep_fragment else ""
    return f"({_HEAD.format(link)} || CASE WHEN {path} = '' THEN '/' ELSE ({_escaped(path)}) END || {_QUERY.format(link)}{tail})"


_FLAT = "SELECT page_id, url, unnest(links) AS l FROM page_data WHERE url IS NOT NULL"
_EDGES = "SELECT DISTINCT url AS src, unnest(links) AS dst FROM page_data WHERE url IS NOT NULL"
_OWN_PATH = "regexp_replace({0}, '^https?://[^/?#]*', '')"
_IS_PATH = """CASE WHEN {0} = '' OR starts_with({0}, 'data:') OR regexp_matches({0}, '[ \\t\\n"<>]') THEN false WHEN regexp_matches({0}, '^[/?#]') OR contains({0}, '/') THEN true
    ELSE regexp_matches({0}, '(?s)^.+[.][^.]+$') END"""
_DIRECTORY = "regexp_replace(" + _PATH.format("url") + ", '[^/]*$', '')"


def _nodes(name: str, seq: str) -> str:
    return f"""{name}_own AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_updated_at DESC NULLS LAST, {seq} DESC) AS r FROM {name} WHERE url IS NOT NULL),
    {name}_found AS (SELECT url, min(found_at) AS found_at FROM (SELECT url, found_at FROM {name}_own UNION ALL SELECT unnest(links), found_at FROM {name}_own) WHERE url IS NOT NULL GROUP BY 1),
    {name}_nodes AS (SELECT f.url, o.url IS NOT NULL AS crawled, status, coalesce(len(links), -1) AS n_links, last_run_id, last_updated_at, f.found_at, content_type FROM {name}_found f LEFT JOIN {name}_own o ON o.url = f.url AND o.r = 1)"""


_BOTH_COLUMNS = ", ".join(f"CASE WHEN n.crawled THEN n.{c} ELSE o.{c} END AS {c}" for c in ("status", "last_run_id", "last_updated_at", "content_type"))
_WEB = "n AS (SELECT count(*) AS n FROM part)"

#: Levels that the SQL of a crawl is written out for; no test run goes deeper.
_LEVELS = 12


def _crawl_sql() -> str:
    """The outcomes of all runs, level by level: what recursion can't say, as it needs windows and all earlier levels."""
    given = "coalesce(start_url, '')"
    seed = f"""CASE WHEN starts_with({given}, ' ') OR regexp_matches({given}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN {given} ELSE {_HEAD.format("('https://' || " + given + ")")} || ({_escaped(_PATH.format("('https://' || " + given + ")"))})
        || {_QUERY.format(given)} || CASE WHEN {_FRAGMENT.format(given)} = '' THEN '' ELSE '#' || ({_escaped(_FRAGMENT.format(given))}) END END"""
    parts = [
        f"""docs AS (SELECT key, page_id FROM (SELECT split_part(url, '#', 1) AS key, min(page_id) AS page_id FROM page_data WHERE url IS NOT NULL GROUP BY 1)),
        out AS MATERIALIZED (SELECT DISTINCT d.key, {_resolved('l')} AS link FROM docs d JOIN ({_FLAT}) f ON f.page_id = d.page_id WHERE l IS NOT NULL),
        lim AS (SELECT id AS r, coalesce(use_cache_flag, false) AS c, coalesce(max_depth, 0) AS md, coalesce(max_links, 0) AS ml, {seed} AS url FROM runs WHERE id IS NOT NULL),
        asked0 AS (SELECT r, c, md, ml, url, CAST(0 AS BIGINT) AS parent, CAST(0 AS BIGINT) AS used FROM lim), seen0 AS (SELECT CAST(NULL AS VARCHAR) AS url WHERE false)"""
    ]
    for d in range(_LEVELS):
        parts.append(
            f"""in{d} AS (SELECT *, used + row_number() OVER (PARTITION BY r ORDER BY parent, url) AS seq FROM asked{d} WHERE {d} < md QUALIFY seq <= ml),
        res{d} AS MATERIALIZED (SELECT i.*, CASE WHEN c AND i.url IN (SELECT url FROM seen{d}) THEN 'cache_hit' WHEN k.key IS NULL THEN 'fetch_error'
            WHEN c AND row_number() OVER (PARTITION BY i.url, c ORDER BY r, seq) > 1 THEN 'cache_hit' ELSE 'saved' END AS outcome FROM in{d} i LEFT JOIN docs k ON k.key = split_part(i.url, '#', 1)),
        seen{d + 1} AS MATERIALIZED (SELECT url FROM seen{d} UNION SELECT url FROM res{d} WHERE outcome = 'saved'),
        asked{d + 1} AS (SELECT s.r, s.c, s.md, s.ml, o.link AS url, s.seq AS parent, u.used FROM res{d} s JOIN out o ON o.key = split_part(s.url, '#', 1) JOIN (SELECT r, max(seq) AS used FROM res{d} GROUP BY 1) u ON u.r = s.r WHERE s.outcome = 'saved')"""
        )
    tasks = " UNION ALL ".join(f"SELECT r, outcome FROM res{d}" for d in range(_LEVELS))
    asked = " UNION ALL ".join(f"SELECT r FROM asked{d}" for d in range(_LEVELS + 1))
    return f"""WITH {', '.join(parts)}, t AS ({tasks}), n AS (SELECT r, count(*) AS n FROM ({asked}) GROUP BY 1), e AS (SELECT r, count(*) AS n FROM t GROUP BY 1)
        SELECT r AS run_id, outcome, count(*) AS n FROM t GROUP BY 1, 2 UNION ALL SELECT n.r, 'limit_rejected', n.n - coalesce(e.n, 0) FROM n LEFT JOIN e ON e.r = n.r WHERE n.n > coalesce(e.n, 0)"""


_CHILDREN = "CASE WHEN 2 * k % (SELECT n FROM n) = (3 * k + 1) % (SELECT n FROM n) THEN [2 * k % (SELECT n FROM n)] ELSE [2 * k % (SELECT n FROM n), (3 * k + 1) % (SELECT n FROM n)] END"

SQL = {
    "page_links": f"SELECT DISTINCT page_id, {_resolved('l')} AS link FROM ({_FLAT}) WHERE l IS NOT NULL",
    "srcset_links": f"""SELECT DISTINCT page_id, {_HEAD.format('url')} || CASE WHEN p = '' THEN '/' ELSE ({_escaped('p')}) END || q AS link FROM (
        SELECT page_id, url, {_PATH.format('l')} AS p, {_QUERY.format('l')} AS q FROM ({_FLAT}) WHERE l IS NOT NULL) WHERE p || q <> ''""",
    "json_links": f"""SELECT DISTINCT page_id, {_resolved('l', True)} AS link FROM ({_FLAT}) WHERE l IS NOT NULL
        UNION SELECT page_id, {_HEAD.format('url')} || ({_escaped('p')}) FROM (SELECT page_id, url, {_DIRECTORY} || trim(content_type) AS p FROM page_data WHERE url IS NOT NULL AND {_IS_PATH.format('trim(content_type)')})""",
    "script_links": f"""WITH p AS (SELECT page_id, url, {_HEAD.format('url')} AS head FROM page_data WHERE url IS NOT NULL)
        SELECT page_id, head || '/' AS link FROM p UNION SELECT page_id, {_resolved('url')} FROM p UNION SELECT page_id, head || '/api/' || page_id FROM p
        UNION SELECT page_id, head || ({_escaped(_DIRECTORY)}) || 'jq?id=' || page_id FROM p""",
    "attribute_links": f"""SELECT DISTINCT page_id, {_HEAD.format('url')} || '/x' || ({_escaped('p')}) || '/' || a AS link FROM (SELECT page_id, url, {_PATH.format('l')} AS p FROM ({_FLAT}) WHERE l IS NOT NULL),
        (SELECT unnest({ADDRESS_ATTRIBUTES}) AS a)""",
    "script_calls": f"""WITH p AS (SELECT page_id AS i, {_HEAD.format('url')} AS head, {_HEAD.format('url')} || ({_escaped(_DIRECTORY)}) AS dir FROM page_data WHERE url IS NOT NULL)
        SELECT i AS page_id, unnest([head || '/api/' || i, dir || 'g?x=' || i, head || '/api/' || i || '/p', head || '/j/' || i, head || '/ax/' || i, head || '/n/' || i || '.json', head || '/late/' || i, head || '/n/', head || '/n/' || i, head || '/p', head || '/late/']) AS link FROM p""",
    "sniffed_beginnings": f"SELECT CAST(doc_id % {len(_BEGINNINGS)} AS INTEGER) AS beginning, list_extract({[t for _, t in _BEGINNINGS]}, CAST(doc_id % {len(_BEGINNINGS)} + 1 AS INTEGER)) AS content_type, count(*) AS n FROM documents GROUP BY 1, 2",
    "graph_edges": f"SELECT * FROM ({_EDGES}) WHERE dst IS NOT NULL",
    "graph_nodes": f"WITH {_nodes('page_data', 'page_id')} SELECT * EXCLUDE (crawled) REPLACE (CAST(n_links AS INTEGER) AS n_links) FROM page_data_nodes",
    "graph_remerge": f"""WITH {_nodes('page_data', 'page_id')}, {_nodes('page_updates', 'update_id')}
        SELECT coalesce(o.url, n.url) AS url, {_BOTH_COLUMNS}, CAST(CASE WHEN n.crawled THEN n.n_links ELSE coalesce(o.n_links, -1) END AS INTEGER) AS n_links, coalesce(o.found_at, n.found_at) AS found_at
        FROM page_data_nodes o FULL JOIN page_updates_nodes n ON o.url = n.url""",
    "in_degree_topk": f"SELECT dst, count(*) AS in_degree FROM ({_EDGES}) WHERE dst IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100",
    "host_link_matrix": f"""WITH h AS (SELECT {', '.join(f"nullif(lower(regexp_replace(regexp_extract({c}, '://([^/?#]*)', 1), ':[0-9]*$', '')), '') AS {c}_host" for c in ('src', 'dst'))} FROM ({_EDGES}) WHERE dst IS NOT NULL)
        SELECT src_host, dst_host, count(*) AS n_edges FROM h WHERE src_host IS NOT NULL AND dst_host IS NOT NULL GROUP BY 1, 2""",
    "url_origin": f"SELECT nullif({_HEAD.format('url')}, '') AS origin, count(*) AS n FROM (SELECT url FROM page_data UNION ALL SELECT url FROM tasks) WHERE url IS NOT NULL GROUP BY 1",
    "url_correct_scheme": f"""SELECT given, CASE WHEN starts_with(given, ' ') OR regexp_matches(given, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN given ELSE {_HEAD.format("('https://' || given)")} || ({_escaped(_PATH.format("('https://' || given)"))})
            || {_QUERY.format('given')} || CASE WHEN {_FRAGMENT.format('given')} = '' THEN '' ELSE '#' || ({_escaped(_FRAGMENT.format('given'))}) END END AS corrected
        FROM (SELECT start_url AS given FROM runs WHERE start_url IS NOT NULL UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM page_data WHERE url IS NOT NULL)""",
    "script_urls": f"SELECT dst, count(*) AS n, ends_with(regexp_replace(dst, '/$', ''), '.js') AS is_script FROM ({_EDGES}) WHERE dst IS NOT NULL GROUP BY 1",
    "screenshot_paths": "SELECT msg_no, replace(url_encode(url), '%20', '+') || '.png' AS path FROM tasks WHERE run.extra_flags.should_screenshot AND url IS NOT NULL",
    "normalize_links": f"""WITH l AS (SELECT DISTINCT dst AS link, split_part(dst, '#', 1) AS c FROM ({_EDGES}) WHERE dst IS NOT NULL)
        SELECT link, CAST(form AS INTEGER) AS form, CASE form WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN 'http:' || regexp_replace(c, '^https?:', '') WHEN 3 THEN regexp_replace(c, '^https?://[^/]*', '')
            WHEN 4 THEN CASE WHEN regexp_matches(link, '^https?://[^/?]*:') THEN '' ELSE regexp_replace(c, '^https?://', '') END WHEN 5 THEN '' WHEN 6 THEN ''
            WHEN 7 THEN CASE WHEN contains(link, '#') THEN c ELSE regexp_replace(c, '[.,;:!?)]+$', '') END ELSE upper(c) END AS normalized FROM l CROSS JOIN range(9) t(form)""",
    "relative_paths": f"""SELECT DISTINCT s, {_IS_PATH.format('s')} AS is_path FROM (SELECT content_type AS s FROM page_data UNION ALL SELECT regexp_replace(url, '^https?://[^/]*', '') FROM page_data
        UNION ALL SELECT unnest(regexp_split_to_array(url, '[/?#]')) FROM page_data) WHERE s IS NOT NULL""",
    "content_type_sniff": """SELECT CASE WHEN text IS NULL OR text = '' THEN 'application/octet-stream' WHEN regexp_matches(ltrim(substr(text, 1, 512), chr(9) || chr(10) || chr(12) || chr(13) || ' '),
            '(?i)^((<!doctype html|<html|<head|<script|<iframe|<h1|<div|<font|<table|<a|<style|<title|<b|<body|<br|<p)[ >]|<!--)') THEN 'text/html; charset=utf-8' ELSE 'text/plain; charset=utf-8' END AS content_type, count(*) AS n
        FROM (SELECT text FROM documents UNION ALL SELECT body FROM page_dumps UNION ALL SELECT '<!doctype html>' FROM page_data WHERE url IS NOT NULL) GROUP BY 1""",
    "robots_filter": f"""SELECT msg_no, CASE WHEN o = '' THEN false WHEN starts_with(o, 'http:') THEN true WHEN regexp_matches(o, '(?i)[.]example:') THEN false
            WHEN regexp_matches(p, '^/wiki/.*[.]html$') THEN true WHEN starts_with(p, '/search/ok') THEN true WHEN starts_with(p, '/search') OR p = '/login' OR regexp_matches(p, '[.]html$') THEN false ELSE true END AS allowed
        FROM (SELECT msg_no, {_HEAD.format('url')} AS o, {_PATH.format('url')} || {_QUERY.format('url')} AS p FROM tasks WHERE url IS NOT NULL)""",
    "cache_gate": """WITH RECURSIVE e AS (SELECT msg_no, url, received_at AS t FROM tasks WHERE url IS NOT NULL AND received_at IS NOT NULL),
        m AS (SELECT url, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT m.url, (SELECT min(e.t) FROM e WHERE e.url = m.url AND e.t >= m.t + INTERVAL 12 HOURS) FROM m WHERE m.t IS NOT NULL),
        f AS (SELECT arg_min(e.msg_no, e.msg_no) AS msg_no FROM m JOIN e ON e.url = m.url AND e.t = m.t GROUP BY m.url, m.t)
        SELECT msg_no, msg_no NOT IN (SELECT msg_no FROM f) AS hit FROM e""",
    "run_admission": """SELECT msg_no, run.id AS run_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run.id ORDER BY msg_no) AS r FROM tasks
        WHERE run.id IS NOT NULL AND coalesce(current_depth, 0) < coalesce(run.max_depth, 0)) WHERE r <= coalesce(run.max_links, 0)""",
    "active_balance": "SELECT msg_no, CAST(sum(CASE WHEN current_depth IS NULL THEN -1 ELSE 1 END) OVER (PARTITION BY run.id ORDER BY msg_no) AS BIGINT) AS active FROM tasks",
    "run_batches": "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 3 AS batch FROM runs",
    "task_roundtrip": """SELECT coalesce(url, '') AS url, coalesce(current_depth, 0) AS current_depth, coalesce(run.id, '') AS run_id, coalesce(run.max_depth, 0) AS max_depth, coalesce(run.max_links, 0) AS max_links,
        coalesce(run.use_cache_flag, false) AS use_cache_flag, coalesce(run.start_url, '') AS start_url FROM tasks""",
    "crawl_bfs_cached": f"""WITH RECURSIVE {_WEB}, w AS (SELECT p_partkey % (SELECT n FROM n) AS k FROM part), b AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d
        UNION SELECT unnest([2 * k % (SELECT n FROM n), (3 * k + 1) % (SELECT n FROM n)]), d + 1 FROM b WHERE d < 7) SELECT 'http://w.test/' || k AS url, min(d) AS depth FROM b WHERE k IN (SELECT k FROM w) GROUP BY k""",
    "crawl_bfs_nocache": f"""WITH RECURSIVE {_WEB}, b AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d
        UNION ALL SELECT unnest(CASE WHEN 2 * k % (SELECT n FROM n) = (3 * k + 1) % (SELECT n FROM n) THEN [2 * k % (SELECT n FROM n)] ELSE [2 * k % (SELECT n FROM n), (3 * k + 1) % (SELECT n FROM n)] END), d + 1 FROM b WHERE d < 5)
        SELECT 'http://w.test/' || k AS url, d AS depth, count(*) AS n_fetches FROM b GROUP BY 1, 2""",
    "run_roundtrip": """SELECT id, coalesce(use_cache_flag, false) AS use_cache_flag, coalesce(max_depth, 0) AS max_depth, coalesce(max_links, 0) AS max_links, coalesce(start_url, '') AS start_url,
        extra_flags.should_screenshot AS should_screenshot, extra_flags.parse_rendered_html AS parse_rendered_html FROM runs""",
    "run_seeds": """SELECT DISTINCT 'https://' || h AS url, 0 AS current_depth, sha1(h) AS run_id, true AS use_cache, true AS rendered, false AS screenshot
        FROM (SELECT nullif(lower(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), ':[0-9]*$', '')), '') AS h FROM page_data) WHERE h IS NOT NULL""",
    "child_messages": """SELECT run_id, current_depth, count(*) AS n_tasks, count(DISTINCT link) AS n_urls FROM (
        SELECT t.run.id AS run_id, coalesce(t.current_depth, 0) + 1 AS current_depth, unnest(p.links) AS link FROM tasks t JOIN (SELECT url, links FROM page_data WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1) p ON p.url = t.url
        WHERE t.run.id IS NOT NULL) WHERE link IS NOT NULL GROUP BY 1, 2""",
    "page_measures_all": """SELECT count(*) AS n_pages, CAST(coalesce(sum(len(links)), 0) AS BIGINT) AS n_links, CAST(coalesce(max(len(links)), 0) AS INTEGER) AS most_links,
        count(*) FILTER (coalesce(last_run_id, '') = '') AS without_run FROM page_data""",
    "cache_write": """SELECT url, max(t) AS cached_at FROM (SELECT url, last_updated_at AS t FROM page_data UNION ALL SELECT url, last_updated_at FROM page_updates) WHERE url IS NOT NULL AND t IS NOT NULL
        GROUP BY 1 HAVING max(t) + INTERVAL 480 HOURS > TIMESTAMP '2025-10-01 00:00:00'""",
    "robots_cache": f"""SELECT origin, CAST(CASE WHEN v THEN 200 ELSE s END AS INTEGER) AS status, CAST(CASE WHEN v THEN 13 WHEN s = -1 THEN NULL ELSE {len(ROBOTS_TEXT)} END AS INTEGER) AS n_chars, v OR s = 200 AS in_cache
        FROM (SELECT origin, length(origin) % 3 = 0 AS v, CASE WHEN regexp_matches(origin, '(?i)^https.*[.]example:') THEN -1 WHEN starts_with(origin, 'http:') THEN 404 ELSE 200 END AS s
        FROM (SELECT DISTINCT {_HEAD.format('url')} AS origin FROM tasks WHERE url IS NOT NULL) WHERE origin <> '')""",
    "crawl_robots": f"""WITH RECURSIVE {_WEB}, b AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d UNION SELECT unnest([2 * k % (SELECT n FROM n), (3 * k + 1) % (SELECT n FROM n)]), d + 1 FROM b WHERE d < 6 AND k % 10 <> 7)
        SELECT 'http://w.test/' || k AS url, CASE WHEN k % 10 = 7 THEN 'robots_denied' ELSE 'saved' END AS outcome, min(d) AS depth FROM b GROUP BY k""",
    "crawl_rendered": f"""WITH RECURSIVE {_WEB}, b AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d UNION SELECT unnest([2 * k % (SELECT n FROM n), (3 * k + 1) % (SELECT n FROM n), (5 * k + 2) % (SELECT n FROM n)]), d + 1 FROM b WHERE d < 4)
        SELECT 'http://w.test/' || k AS url, min(d) AS depth, 200 AS status, CAST(len(list_distinct([2 * k % (SELECT n FROM n), (3 * k + 1) % (SELECT n FROM n), (5 * k + 2) % (SELECT n FROM n)])) AS INTEGER) AS n_links, 'bfs' AS last_run_id,
            'text/html; charset=utf-8' AS content_type, true AS new FROM b GROUP BY k""",
    "crawl_slots": f"""WITH RECURSIVE {_WEB}, b AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d UNION SELECT unnest({_CHILDREN}), d + 1 FROM b WHERE d < 3), p AS (SELECT CAST(1 AS BIGINT) AS k, 0 AS d UNION ALL SELECT unnest({_CHILDREN}), d + 1 FROM p WHERE d < 3),
        f AS (SELECT k, d, len({_CHILDREN}) AS m FROM (SELECT k, min(d) AS d FROM b GROUP BY k)), r AS (
            SELECT 'a' AS run_id, 'saved' AS outcome, count(*) AS n FROM f UNION ALL SELECT 'a', 'cache_hit', 1 + sum(m) FILTER (d < 3) - count(*) FROM f UNION ALL SELECT 'a', 'limit_rejected', sum(m) FILTER (d = 3) FROM f
            UNION ALL SELECT 'b', 'cache_hit', 1 UNION ALL SELECT 'c', 'saved', count(*) FROM p UNION ALL SELECT 'c', 'limit_rejected', sum(len({_CHILDREN})) FILTER (d = 3) FROM p UNION ALL SELECT 'd', 'limit_rejected', 1)
        SELECT run_id, outcome, CAST(n AS BIGINT) AS n FROM r WHERE n > 0""",
    "run_outcomes": _crawl_sql(),
}
