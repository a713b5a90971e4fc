"""Revisits against a plain search, with one URL that holds most records."""

import random

from pyspark.sql import functions as F

from rxweave.llm import warc

SCHEMA = "record_id long, url string, captured_at long, kind string, headers map<string,string>, payload_digest string, verdict string, canonical_url string"


def plain(rows):
    out = {}
    for i, url, at, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(a, j) for j, u, a, k, *_ in rows if k == "response" and u == url and url and a is not None and at is not None and a < at]
            out[i] = max(earlier)[1] if earlier else None
    return out


def test_latest_earlier_response(spark):
    r = random.Random(4)
    rows = [(i, "http://hot.example/" if r.random() < 0.6 else f"http://x{r.randint(1, 9)}.example/", r.randint(0, 60), r.choice(["response", "revisit"]), {}, None, "v", "c") for i in range(400)]
    rows += [(1000, None, 5, "revisit", None, None, "v", "c"), (1001, "http://hot.example/", None, "revisit", {}, None, "v", "c"), (1002, None, 1, "response", {}, None, "v", "c")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a URL spans partitions
    got = {x["record_id"]: x["original_id"] for x in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == plain(rows)


def test_validators_and_headers(spark):
    stored = {"ETag": '"a"', "Last-Modified": "mon", "Content-Type": "text/html", "Content-Length": "9", "X-Old": "1", "Cache-Control": "x"}
    rows = [
        (1, "https://www.E.example:443/a/?b=2&a=1&utm_source=q#f", 1, "response", stored, "d", "v", "c"),
        (2, "http://e.example/a?a=1&b=2", 2, "revisit", {"etag": 'W/"a"', "cache-control": "y", "Content-Length": "0", "Connection": "close", "X-New": "2"}, None, "v", "c"),
        (3, "http://e.example/a?a=1&b=2", 2, "revisit", {"ETAG": '"b"', "Last-Modified": "mon"}, None, "v", "c"),
        (4, "http://e.example/a?a=1&b=2", 2, "revisit", {"last-modified": "tue"}, None, "v", "c"),
        (5, "http://e.example/a?a=1&b=2", 2, "revisit", {"last-modified": "mon"}, "other", "v", "c"),
        (6, "http://e.example/a?a=1&b=2", 2, "revisit", {}, None, "v", "c"),
        (7, "http://e.example/a?a=1&b=2", 1, "revisit", {}, None, "v", "c"), (7, "http://e.example/a?a=1&b=2", 1, "revisit", {}, None, "v", "c")]
    got = sorted(warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda x: x["record_id"])
    assert [(x["record_id"], x["verdict"]) for x in got] == [(2, "resolved"), (3, "mismatch"), (4, "mismatch"), (5, "mismatch"), (6, "unvalidated"), (7, "no_original"), (7, "no_original")]
    assert got[0]["headers"] == {"etag": 'W/"a"', "cache-control": "y", "content-length": "9", "content-type": "text/html", "x-old": "1", "x-new": "2", "last-modified": "mon"}
    assert got[0]["canonical_url"] == "e.example/a?a=1&b=2" and got[0]["payload_digest"] == "d" and got[1]["headers"] is None
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_header_names(spark):
    row = spark.range(1).select(warc._lower_names(F.create_map(F.lit("A"), F.lit("1"), F.lit("a"), F.lit("2"), F.lit("B"), F.lit("3"))).alias("h")).first()
    assert row["h"] == {"a": "2", "b": "3"}
