"""Where documents come from: a snapshot table, or live requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweb.functions.urls import without_fragment

FETCHED = ["status", "body", "content_type", "rendered_html"]


class Fetcher(Protocol):
    """Anything that turns ``url`` rows into the same rows with ``status, body, content_type, rendered_html``; addresses that can't be fetched drop out."""

    def fetch(self, urls: DataFrame) -> DataFrame: ...


class Renderer(Protocol):
    """Anything that fills ``rendered_html`` of fetched rows that want it (``render``); others stay as they are."""

    def render(self, fetched: DataFrame) -> DataFrame: ...


class FunctionRenderer:
    """Renders by a function from address and body to HTML, in Arrow batches; only rows with ``render`` and without a rendered document reach it."""

    def __init__(self, function: Callable[[str, str], str | None]):
        self.function = function

    def render(self, fetched: DataFrame) -> DataFrame:
        function = self.function

        @F.pandas_udf("string")
        def rendered(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for urls, bodies in columns:
                yield pd.Series([None if b is None else function(u, b) for u, b in zip(urls, bodies)], dtype=object)

        asks = F.col("render") & F.col("rendered_html").isNull()
        return fetched.withColumn("rendered_html", F.coalesce("rendered_html", rendered(F.col("url"), F.when(asks, F.col("body")))))


class SnapshotFetcher:
    """Documents of a table. Requests carry no fragment, so both sides are compared without it; of several rows for one
    address the first in ``order`` counts.

    The wanted addresses meet the table first, and only the matching rows are compared: a small frontier is broadcast by Spark
    on its size and the table is scanned once; else both are shuffled by address, and the comparison needs no shuffle of its own.
    """

    def __init__(self, web: DataFrame, order: str = "url"):
        missing = {c: F.lit(None).cast("string") for c in FETCHED if c not in web.columns}
        rows = web.withColumns(missing) if missing else web
        packed = F.struct(F.col("status").cast("int").alias("status"), *[F.col(c).cast("string").alias(c) for c in FETCHED[1:]])
        self.documents = rows.where(F.col("url").isNotNull()).select(without_fragment(F.col("url")).alias("__key"), packed.alias("__doc"), F.col(order).alias("__rank"))

    def fetch(self, urls: DataFrame) -> DataFrame:
        found = urls.withColumn("__key", without_fragment(F.col("url"))).join(self.documents, "__key")
        first = found.groupBy("__key", *urls.columns).agg(F.min_by("__doc", F.struct("__rank", F.xxhash64("__doc"))).alias("__doc"))
        return first.select(*urls.columns, "__doc.*")


class HttpFetcher:
    """Live requests from the executors. Any status counts as fetched; errors drop the address."""

    def __init__(self, timeout: float = 30.0, agent: str = "strandweb"):
        self.timeout, self.agent = timeout, agent

    def fetch(self, urls: DataFrame) -> DataFrame:
        timeout, agent = self.timeout, self.agent

        def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import http.client
            import urllib.error
            import urllib.request

            from strandweb.functions.sniff import content_type

            for batch in batches:
                rows = []
                for row in batch.to_dict("records"):
                    try:
                        request = urllib.request.Request(row["url"].split("#", 1)[0], headers={"User-Agent": agent})
                        with urllib.request.urlopen(request, timeout=timeout) as reply:
                            status, body = reply.status, reply.read()
                    except urllib.error.HTTPError as e:
                        status, body = e.code, e.read()
                    except (OSError, ValueError, http.client.HTTPException):
                        continue
                    rows.append(row | {"status": status, "body": body.decode("utf-8", "replace"), "content_type": content_type(body), "rendered_html": None})
                yield pd.DataFrame(rows, columns=[*batch.columns, *FETCHED])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
        return urls.mapInPandas(load, f"{fields}, status int, body string, content_type string, rendered_html string")
