"""Split requests of the aggregates API: limits, union, cache, retries."""

import json
import re
import sys
from urllib.parse import parse_qs, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from vitalgrid.operators import cube
from vitalgrid.sources.cube_client import CubeQuery
from vitalgrid.sources.cube_source import cube_source, listed, read_payloads, split_query

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this folder


def cells_of(url: str):
    """What a fake service has for a request: (period, variable, place)."""
    parts = urlparse(url)
    _, periods, _, variables = parts.path.strip("/").split("/")[-4:]
    places = listed(parse_qs(parts.query)["localidades"][0])[1] or [str(k) for k in range(1, 8)]
    return [(p, v, place) for v in variables.split(",") for p in periods.split(",") for place in places]


def answer(url: str) -> tuple[int, bytes]:
    rows = [{"NC": "6", "NN": "M", "MN": "P", "V": f"{int(p) * 100 + int(v) + int(place)}", "D1C": place, "D1N": f"place {place}", "D2C": v, "D2N": f"variable {v}", "D3C": p, "D3N": p} for p, v, place in cells_of(url)]
    return 200, json.dumps([{"NC": "Nivel", "V": "Valor", "D1C": "Municipio (Codigo)"}, *rows]).encode()


QUERY = CubeQuery("6579", ["2019", "2020", "2021"], ["11", "12"], "N6[1,2,3,4,5,6,7]")


@given(st.integers(1, 6), st.integers(1, 5), st.integers(1, 9), st.integers(1, 60), st.booleans())
@settings(max_examples=300, deadline=None)
def test_no_request_is_above_the_limit_and_the_union_is_the_query(periods, variables, places, limit, many):
    q = CubeQuery("1", [str(k) for k in range(periods)], [str(k) for k in range(variables)], f"N6[{','.join(str(k) for k in range(places))}]", ["2[1,2]"] if many else [])
    per = 2 if many else 1
    if per > limit:
        with pytest.raises(ValueError):
            split_query(q, limit=limit)
        return
    got = split_query(q, limit=limit)
    assert all(n == len(cells_of(x.url())) * per <= limit for x, n in got)
    cells = [c for x, _ in got for c in cells_of(x.url())]
    assert sorted(cells) == sorted(cells_of(q.url())) and len(set(cells)) == len(cells)


def test_what_cannot_be_split():
    everywhere = CubeQuery("1", ["2019", "2020"], ["11"], "N6[all]")
    assert [len(q.periods) for q, _ in split_query(everywhere, localities=5570, limit=6000)] == [1, 1]
    with pytest.raises(ValueError, match="must be known"):
        split_query(everywhere)
    with pytest.raises(ValueError, match="list the localities"):
        split_query(everywhere, localities=5570, limit=5000)


def facts(spark, payloads):
    out = cube.flat_facts(payloads, "payload", "6579", tuple(QUERY.variables), tuple(QUERY.periods))
    return sorted((r["variable_id"], r["period"], r["locality_id"], r["value"]) for r in out.collect())


def test_source(spark, tmp_path):
    spark.dataSource.register(cube_source(answer, lambda _: None))
    cache = str(tmp_path / "cache")
    payloads = read_payloads(spark, QUERY, cache, limit=10, concurrency=2)
    assert payloads.rdd.getNumPartitions() == 2
    rows = payloads.collect()
    assert len(rows) == 6 and all(r["cells"] <= 10 and not r["cache_hit"] and r["attempts"] == 1 for r in rows)
    one = read_payloads(spark, QUERY, None, limit=1000)
    assert one.count() == 1 and facts(spark, payloads) == facts(spark, one)
    again = payloads.collect()
    assert all(r["cache_hit"] for r in again) and [r["payload"] for r in again] == [r["payload"] for r in rows]
    names = [p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")]
    assert len(names) == 6 and all(re.fullmatch(r"[0-9a-f]{64}\.json", n) for n in names)


def test_a_task_that_fails_once_leaves_one_file_per_request(spark, tmp_path):
    flag = tmp_path / "failed"

    def flaky(url):
        if "/2020/" in url and not flag.exists():
            flag.write_text("")
            return 500, b"busy"
        return answer(url)

    spark.dataSource.register(cube_source(flaky, lambda _: None))
    payloads = read_payloads(spark, QUERY, str(tmp_path / "cache"), limit=14, retries="2")
    assert sorted(r["attempts"] for r in payloads.collect()) == [1, 1, 2]
    assert len(list((tmp_path / "cache").glob("*.json"))) == 3

    def down(_):
        return 503, b""

    spark.dataSource.register(cube_source(down, lambda _: None))
    with pytest.raises(Exception, match="no payload after 2 attempts"):
        read_payloads(spark, QUERY, str(tmp_path / "other"), retries="1").collect()
