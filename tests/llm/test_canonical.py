"""Canonical records against a brute-force grouping: spellings, order, copies, broken and empty bodies."""

import json
import random

from pyspark.sql import functions as F

from strandweb.llm.canonical import _SHAPE, _STRICT, canonical_body, canonical_of, canonical_text, collapse, native_text, repeats

SCHEMA = "raw_id long, body string, canonical string"


def page(url="http://H/a-b", status=200, links=("x/1", "Y 2"), **more):
    return {"url": url, "status": status, "links": None if links is None else list(links), "lastRunID": "r", "lastUpdatedAt": "2025", "foundAt": None, "contentType": "t/h"} | more


def test_equal_spellings():
    base = canonical_body(json.dumps(page()))
    assert base == canonical_body(json.dumps(dict(reversed(page().items())), indent=3))
    assert base == canonical_body(json.dumps(page(url="HTTP://h/A_B", status=200.0, links=["y-2", "X1", "--", "x/1", None])))
    assert base == canonical_body(json.dumps(page(status="200", other=1)))
    assert base == canonical_body(json.dumps({k: v for k, v in page().items() if k != "foundAt"}))
    assert canonical_body(json.dumps(page(links=None))) == canonical_body(json.dumps(page(links=[]))) == canonical_body(json.dumps(page(links=["?", ""])))


def test_different_records():
    bodies = [page(), page(status=404), page(links=["x1"]), page(url="http://h/ab2"), page(url=None), page(url=""), page(url="http://h/äb"), page(status=None), page(contentType=None)]
    assert len({canonical_body(json.dumps(b)) for b in bodies}) == len(bodies)


def test_no_records():
    assert [canonical_body(b) for b in (None, "", "null", "[1]", "{not json", '{"a":1} x', "3", "[" * 100000)] == [None] * 8
    assert canonical_text("Größe 12 ½ Ⅳ _x İ") == "größe12xi"


def test_collapse(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        value = page(url=f"u{rnd.choice([1, 1, 1, 2, 3, i])}", links=rnd.sample(["a", "b", "c"], rnd.randrange(3)))
        keys = list(value)
        rnd.shuffle(keys)
        body = json.dumps({k: value[k] for k in keys}, indent=rnd.choice([None, 1]))
        rows.append((i * 2, rnd.choice([body, body, body, None, "", "{", "7"]), "clash"))
    groups = {}
    for i, b, _ in rows:
        if (c := canonical_body(b)) is not None:
            groups.setdefault(c, []).append(i)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    records, _ = collapse(df, "raw_id", "body")
    assert sorted((r["first"], r.copies) for r in records.collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert sorted(tuple(r) for r in repeats(df, "raw_id", "body").collect()) == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert repeats(df.limit(0), "raw_id", "body").count() == 0


def test_long_body(spark):
    body = json.dumps(page(links=[f"l{i}" for i in range(50_000)]))
    df = spark.createDataFrame([(1, body, ""), (2, body.replace('"l4', '"-L4'), "")], SCHEMA)
    assert [tuple(r) for r in repeats(df, "raw_id", "body").collect()] == [(1, 2)]


ODD = [
    '{"url":"a","url":"b"}', '{"url":"a","url":null}', '{"status":1e2}', '{"status":"1E+2"}', '{"status":100}', '{"status":100.50}', '{"status":"0100"}', '{"status":-0}', '{"status":true}', '{"status":"abc"}', '{"status":""}',
    '{"status":12345678901234567890123}', '{"status":12345678901234567890124}', '{"status":NaN}', '{"status":Infinity}', '{"status":"NaN"}', "{'url':'a'}", '{"url":"a"} x', '{"url":"a"}{"url":"b"}', '{"url":"a"},{"url":"b"}',
    '{"url":"a"}]', '  {"url":"a"}\n', '﻿{"url":"a"}', '{"url":5}', '{"url":5.50}', '{"url":[1,2]}', '{"url":{"b":1,"a":"x"}}', '{"url":"[x"}', '{"links":"one"}', '{"links":["a",null,5,{"b":2},["c"]]}', '{"links":[]}', '{"links":{}}',
    '{"links":null}', '{"url":"a\\u0001b","lastRunID":"\\u0002","links":["\\u0003","x\\u0003y"]}', '{}', '{"URL":"a"}', '{"url":"\\u00c4\\u0130\\ud83d\\ude00\\u03a3"}', '{"url":"ΑΣ ΣΑ ß ﬁ ٣ ½ Ⅳ 𝟘 𐐀"}', '{"url":"\\ud800"}', '{"url":"a\nb"}', '{"url":"a",}', '{"url" "a"}', '{"url":"a"', '[]', 'null', '"x"', "", None,
    '{"a":' * 2000 + "1" + "}" * 2000, '{"url":01}', '{"url":"\\x"}', '{"url":tru}', '{"status":200 , "links" : ["B b","bB","-"]}', '{"url":"a","other":{"url":"b"}}', '{"lastRunID":"X-1","foundAt":"","contentType":"T"}', "{" + " " * 5000 + "}",
]


def test_native_agrees_with_python(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(ODD)], "i int, body string").repartition(2)
    got = {r.i: r.c for r in canonical_of(df, "body", "c").collect()}
    want = {i: canonical_body(b) for i, b in enumerate(ODD)}
    differ = [(ODD[i], got[i], want[i]) for i in want if got[i] != want[i]]
    assert not differ, differ


def test_usual_bodies_need_no_python(spark):
    bodies = [(json.dumps(page(links=["a", None, "Ä"]), indent=i % 3),) for i in range(9)] + [(json.dumps(page(links=None, status=None)),)]
    parsed = F.from_json("body", _SHAPE, _STRICT)
    rows = spark.createDataFrame(bodies, "body string").select("body", native_text(F.col("body"), parsed).alias("c")).collect()
    assert [r.c for r in rows] == [canonical_body(r.body) for r in rows]
