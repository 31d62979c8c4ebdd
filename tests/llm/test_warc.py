import base64
import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import warc


def rows_of(n=300):
    rng = random.Random(4)
    htmls = [None, "", "<p>a</p>", "é" * 1000, *(f"page {k}" for k in range(20))]
    urls = [None, "http://b.example.com/x?q#f", "HTTP://A.example.com/ü y", "https://a.example.com/", "no host"]
    return [(k if k else None, rng.choice(urls), rng.choice(htmls), rng.choice([None, k, -5])) for k in range(n)]


def test_archives_and_index(spark, monkeypatch):
    data = rows_of()
    df = spark.createDataFrame(data, "page_id long, url string, html string, seconds long").repartition(7).withColumn("records", F.lit("clash"))
    manifest = warc.write_archives(df)
    assert manifest.agg(F.sum("records")).first()[0] == len(data)
    for fan_in in (2, 100):
        got = warc.index_archives(manifest, fan_in).collect()
        assert len(got) == len(data)
        keys = [warc.order_of(tuple(r)) for r in got]
        assert keys == sorted(keys)
    largest: dict = {}
    for i, _, h, _ in data:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    by_id = {r["record_id"]: r for r in got}
    for i, url, h, _ in data:
        r, payload = by_id[i], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        first = largest[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first or first == -1 else ("revisit", first))
        fields, block = warc.read_capture(r["archive"], r["at"])
        assert fields["WARC-Type"] == r["record_type"] and block.endswith(payload if r["record_type"] == "response" else b"\r\n\r\n")
        assert (url is None) == ("WARC-Target-URI" not in fields)
    assert warc.index_archives(warc.write_archives(df.limit(0))).count() == 0


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u://a", "xx", 0), (2, "u://a", "xx", 0), (3, "u://b", "longer", 0), (4, "u://b", "longer", 0), (4, "u://b", "longer", 0)], "page_id long, url string, html string, seconds long")
    got = warc.index_archives(warc.write_archives(df, least_bytes=5)).collect()
    assert sorted((r["record_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response"), (4, "response")]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted([(rng.choice("abc"), str(rng.randint(0, 9)), rng.choice([None, 1, 2]), 0, "", "", None, f"f{j}", n) for n in range(rng.randint(0, 30))], key=warc.order_of) for j in range(k)]
    assert list(warc.loser_tree([iter(r) for r in runs])) == list(heapq.merge(*runs, key=warc.order_of))


def test_broken_archives_are_noticed():
    good = warc.record(1, "http://a/", 0, b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc.capture(good.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"), "f", 0)
    with pytest.raises(ValueError, match="length"):
        warc.parse(good + b"x")
    assert warc.url_key("https://User@WWW.Example.com/A?b#c") == "com,example,user@www)/a?b"
