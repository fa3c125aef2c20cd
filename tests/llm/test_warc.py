from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfspark.llm.warc import PERMITTED, canonical, header_text, resolve_revisits

from . import helpers as H

SCHEMA = ("record_id bigint, kind string, url string, at timestamp, etag string, last_modified string, digest string, "
          "headers map<string,string>")
DAY = datetime(2024, 1, 1)


def record(i, kind, url, hours, etag=None, modified=None, digest=None, **headers):
    headers = {k.replace("_", "-"): v for k, v in headers.items()}
    return i, kind, url, None if hours is None else DAY + timedelta(hours=hours), etag, modified, digest, headers or None


def brute(records, keys):
    """Each revisit against all responses of its address."""
    out = []
    for i, kind, url, at, etag, modified, digest, headers in records:
        if kind != "revisit":
            continue
        earlier = [r for r in records if r[1] == "response" and keys[r[2]] is not None and keys[r[2]] == keys[url]
                   and r[3] is not None and at is not None and r[3] <= at]
        best = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        status, refers, merged = "unmatched", None, headers or {}
        if best:
            pairs = [(etag, best[4]), (modified, best[5]), (digest, best[6])]
            agree = next((a == b for a, b in pairs if a is not None and b is not None), False)
            status = "resolved" if agree else "changed"
            if agree:
                refers = best[0]
                merged = {**(best[7] or {}), **{k: v for k, v in (headers or {}).items() if k in PERMITTED}}
        out.append((i, status, refers, "\n".join(f"{k}: {v}" for k, v in sorted(merged.items()))))
    return sorted(out, key=repr)


def result(records):
    return H.rows(resolve_revisits(records, 5).select("record_id", "status", "refers_to", header_text(F.col("headers"))))


@pytest.mark.parametrize("raw,key", [
    ("http://www.Shop.example.com/a/", "shop.example.com/a"), ("https://shop.example.com/a#top", "shop.example.com/a"),
    ("https://shop.example.com:443/a?utm_source=x&b=1&ref=y", "shop.example.com/a?b=1"), ("shop.example.com", "shop.example.com"),
    ("https://shop.example.com/A?reference=1", "shop.example.com/A?reference=1"), ("", None), (None, None), ("  ", None),
    ("http://x.example/?utm_a=1&utm_b=2", "x.example"),
])
def test_canonical(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "u string").select(canonical(F.col("u"))).first()[0] == key


def test_against_every_response(spark):
    records = []
    for i in range(400):
        url = "http://hot.example/p" if i % 3 == 0 else f"http://s{i % 11}.example/{i % 4}/"
        kind = "response" if i % 4 == 1 else "revisit"
        records.append(record(i, kind, url, (i * 37) % 101, etag=None if i % 5 == 0 else f"e{i % 2}", modified=f"m{i % 3}",
                              digest="d", date=str(i), content_length="9", expires="x"))
    frame = spark.createDataFrame(records, SCHEMA)
    urls = {r[2] for r in records}
    keys = {r.u: r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical(F.col("u")).alias("k")).collect()}
    assert result(frame) == brute(records, keys)


def test_odd_records(spark):
    records = [
        record(1, "response", "http://a.example/", 1, etag="x", content_type="t", date="1"),
        record(2, "revisit", "https://www.a.example", 1, etag="x", date="2", content_length="0"),  # same time: the response is first
        record(3, "revisit", "http://a.example", 0, etag="x"), record(4, "revisit", "http://a.example", 5, etag="y"),
        record(5, "revisit", None, 5, etag="x"), record(6, "revisit", "http://a.example", None), record(7, "request", "http://a.example", 2),
        record(8, "revisit", "http://a.example", 9), record(8, "revisit", "http://a.example", 9), record(None, None, None, None),
    ]
    frame = H.clashing(spark.createDataFrame(records, SCHEMA))
    assert result(frame) == [
        (2, "resolved", 1, "content-type: t\ndate: 2"), (3, "unmatched", None, ""), (4, "changed", None, ""), (5, "unmatched", None, ""),
        (6, "unmatched", None, ""), (8, "changed", None, ""), (8, "changed", None, ""),
    ]
    assert resolve_revisits(frame.limit(0)).count() == 0
