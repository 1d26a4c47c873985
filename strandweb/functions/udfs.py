"""The extractors as Arrow UDFs and as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweb.functions import robots as robots_rules
from strandweb.functions.html_links import html_links
from strandweb.functions.js_links import script_links
from strandweb.functions.json_links import json_links
from strandweb.functions.urls import correct_scheme, is_script_url, normalize, origin, resolve

_LINKS = T.ArrayType(T.StringType())


def document_links(url: str | None, body: str | None) -> list[str]:
    """All links of a fetched document: of a script (by its address) against the origin, of others as HTML and then as JSON.

    The two lists aren't merged: a link that both find comes twice. A document that can't be parsed has none.
    """
    if not body or not url:
        return []
    if is_script_url(url):
        return script_links(body, origin(url)) or []
    return html_links(body, url) + (json_links(body, url) or [])


def _pairwise(function: Callable, kind: T.DataType) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def udf(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in columns:
            yield pd.Series([function(x, y) for x, y in zip(a, b)], dtype=object)

    return udf


def _each(function: Callable, kind: T.DataType) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def udf(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield pd.Series([None if x is None else function(x) for x in column], dtype=object)

    return udf


def _known(function: Callable) -> Callable:
    return lambda text, base: None if text is None else function(text, base)


links_of = _pairwise(document_links, _LINKS)  # (url, body)
html_links_of = _pairwise(_known(html_links), _LINKS)  # (body, base)
json_links_of = _pairwise(_known(json_links), _LINKS)
script_links_of = _pairwise(_known(script_links), _LINKS)
resolve_of = _pairwise(_known(resolve), T.StringType())
normalize_of = _each(normalize, T.StringType())
origin_of = _each(origin, T.StringType())
correct_scheme_of = _each(correct_scheme, T.StringType())


def robots_rules_of(agent: str) -> Callable[[Column], Column]:
    """Body of a robots.txt to the lines that hold for the agent."""
    return _each(lambda body: robots_rules.relevant_rules(body, agent), T.StringType())


robots_allow = _pairwise(lambda rules, url: None if url is None else robots_rules.allowed_by(rules or "", url), T.BooleanType())  # (rules, url)


class DocumentLinks:
    """Table function: a row for each link of a document."""

    def eval(self, url: str, body: str) -> Iterator[tuple[str]]:
        for link in document_links(url, body):
            yield (link,)


def register(spark: SparkSession) -> None:
    """For SQL: ``document_links(url, body)`` as a table function, and the scalar functions."""
    spark.udtf.register("document_links", F.udtf(DocumentLinks, returnType="link string"))
    for name, function in {"html_links": html_links_of, "json_links": json_links_of, "script_links": script_links_of, "resolve_url": resolve_of, "normalize_url": normalize_of, "url_origin": origin_of, "correct_scheme": correct_scheme_of}.items():
        spark.udf.register(name, function)
