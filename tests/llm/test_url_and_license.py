from pyspark.sql import functions as F

from vitalgrid.llm import license_scan, url_filters
from vitalgrid.llm.url_filters import UrlRule

RULES = [UrlRule("net/", "block"), UrlRule("example.net/en/", "allow"), UrlRule("example.com/de/", "block"), UrlRule("org/fr/", "allow"), UrlRule("a.b", "block"), UrlRule("x-y.io/p", "block")]
URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net/EN/", "http://notexample.net/en/", "http://example.com/de/q", "https://x.org/fr/", "https://org/fr/1", "http://net", "http://net?x=/", "http://q.a.b", "http://a.b/z",
    "http://x-y.io/page", "http://x-y.io/q", "a://b://c.net/", "http://é.net/",
]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def test_urls_by_both_ways(spark):
    df = spark.createDataFrame([(k, u, "clash", "c") for k, u in enumerate(URLS + URLS)], "page_id int, url string, host string, Verdict string")
    want = [(k, *brute(u)) for k, u in enumerate(URLS + URLS)]
    for limit in (1000, 0):
        got = url_filters.judge_urls(df, RULES, inline_rules=limit)
        assert sorted(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert url_filters.judge_urls(df, []).where("verdict <> 'allow'").count() == 0
    assert url_filters.judge_urls(df.limit(0), RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("www.example.net/en/",), ("en.example.com/",)], "address string")
    filed = url_filters.rarest_tokens(df, [UrlRule("example.net/en/", "allow"), UrlRule("x/", "block")])
    assert [filed[r] for r in filed] == ["net", "x"]


def test_licenses(spark, docs_schema):
    rows = [(1, "Some prose.\nLICENSED under the  Apache Licence, version 2.0\nmore", "en", "s", 1), (2, "Copyright 2020 Someone\nReleased under the MIT License.", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1), (5, "MIT License", "en", "s", 1), (5, "Released under the MIT License!", None, None, None)]
    df = spark.createDataFrame(rows, docs_schema).withColumn("digest", F.lit(1))
    got = sorted((r["doc_id"], r["license_id"], r["unit"], r["line_no"]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(1, "Apache-2.0", "line", 2), (2, "MIT", "line", 2), (2, "MIT", "text", 0), (5, "MIT", "line", 1), (5, "MIT", "text", 0)]
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_full_license_texts(spark, docs_schema):
    folder = license_scan.TEXTS
    mit, bsd, isc, apache = ((folder / f"{n}.txt").read_text() for n in ("MIT", "BSD-3-Clause", "ISC", "Apache-2.0"))
    assert mit.startswith("Permission is hereby granted, free of charge") and bsd.count("\n3. Neither the name") == 1 and len(apache) > 10_000
    header = apache[apache.index("   Licensed under the Apache") :].replace("\n", " ")
    texts = [f"The MIT License (MIT)\n\n\u00a9 2020 Some Holder\n\n{mit}", mit.replace("\n\n", "\v").replace("\n", " ").replace("\v", "\n"), f"Copyright (c) 2001 X\nAll rights reserved.\n\n{bsd}", isc, apache, f"Copyright 2020 X\n{header}", "# SPDX-License-Identifier: MIT", mit[:-20]]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], docs_schema)
    got = sorted((r["doc_id"], r["license_id"]) for r in license_scan.scan_licenses(df).where("unit = 'text'").collect())
    assert got == [(0, "MIT"), (1, "MIT"), (2, "BSD-3-Clause"), (3, "ISC"), (4, "Apache-2.0"), (5, "Apache-2.0"), (6, "MIT")]
