"""Schemas of the crawl's tables and messages."""

from pyspark.sql import types as T

FLAGS = T.StructType([T.StructField("should_screenshot", T.BooleanType()), T.StructField("parse_rendered_html", T.BooleanType())])
RUN = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("use_cache_flag", T.BooleanType()), T.StructField("max_depth", T.IntegerType()),
        T.StructField("max_links", T.IntegerType()), T.StructField("extra_flags", FLAGS), T.StructField("start_url", T.StringType()),
    ]
)
TASK = T.StructType([T.StructField("url", T.StringType()), T.StructField("current_depth", T.IntegerType()), T.StructField("run", RUN)])
#: Field names of a page in JSON, in the order of the table's columns.
PAGE_JSON = {"url": "url", "status": "status", "links": "links", "last_run_id": "lastRunID", "last_updated_at": "lastUpdatedAt", "found_at": "foundAt", "content_type": "contentType"}
PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("last_run_id", T.StringType()), T.StructField("last_updated_at", T.TimestampType()), T.StructField("found_at", T.TimestampType()),
        T.StructField("content_type", T.StringType()),
    ]
)
EDGES = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
WEB = "url string, status int, body string, content_type string, rendered_html string"
ROBOTS = "origin string, status int, body string, cached_at timestamp"
CACHE = "url string, links array<string>, cached_at timestamp"
