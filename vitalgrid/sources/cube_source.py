"""Large queries of the aggregates API as a table: split below the service's limit of cells, one request per partition.

    spark.dataSource.register(cube_source())
    payloads = read_payloads(spark, query, cache, localities=5570)

A query is split by variables, then periods, then, if they are listed, localities,
so that no request asks for more than ``MAX_CELLS`` cells. A task asks for one
request after another; ``concurrency`` bounds how many ask at a time. A payload is
kept in the cache under its request's key, written under a name of its own and
then renamed, so a task that runs again finds it, or writes the same file once more.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, replace
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vitalgrid.sources.cube_client import RETRIES, CubeQuery, fetch, http_get
from vitalgrid.sources.files import join_path, open_store

#: The service's limit of cells per request, and how many may be asked for at a time.
MAX_CELLS, CONCURRENCY = 49_900, 16
NAME = "cube_api"
SCHEMA = "request long, cache_key string, url string, cells long, payload string, attempts int, download_bytes long, cache_hit boolean"


def listed(selection: str) -> tuple[str, list[str] | None]:
    """``N6[1,2]`` as its name and members; None for all of them or several levels."""
    m = re.fullmatch(r"(\w+)\[([^\[\]]+)\]", selection.strip())
    members = [x.strip() for x in m[2].split(",")] if m else None
    return (m[1], members) if m and members != ["all"] else (selection, None)


def split_query(query: CubeQuery, localities: int | None = None, categories: int | None = None, limit: int = MAX_CELLS) -> list[tuple[CubeQuery, int]]:
    """Requests whose union is the query, with their numbers of cells.

    ``localities`` and ``categories`` say how many there are where the query doesn't list them (all of a level; all
    of a classification). ValueError if that is unknown, or one cell block is above the limit and can't be split.
    """
    level, places = listed(query.localities)
    n_places = len(places) if places else localities
    known = [listed(c)[1] for c in query.classifications]
    n_categories = categories or (prod(len(c) for c in known) if None not in known else None)
    if not n_places or not n_categories:
        raise ValueError("the number of localities and categories must be known to split a query")
    per_place = max(1, limit // n_categories)
    if n_categories > limit or (n_places > per_place and not places):
        raise ValueError(f"one period of one variable has {n_places * n_categories} cells; list the localities, so that they can be split")
    blocks = [places[k : k + per_place] for k in range(0, n_places, per_place)] if places else [None]
    out = []
    for block in blocks:
        n = (len(block) if block else n_places) * n_categories
        many = max(1, limit // n)  # variables times periods of a request
        by_variable = min(many, len(query.variables))
        by_period = max(1, many // by_variable)
        for v in range(0, len(query.variables), by_variable):
            for p in range(0, len(query.periods), by_period):
                part = replace(query, variables=query.variables[v : v + by_variable], periods=query.periods[p : p + by_period], localities=f"{level}[{','.join(block)}]" if block and len(blocks) > 1 else query.localities)
                out.append((part, n * len(part.variables) * len(part.periods)))
    return out


class _Request(InputPartition):
    def __init__(self, number: int, query: dict, cells: int):
        super().__init__(number)
        self.query, self.cells = query, cells


def cached_payload(query: CubeQuery, cache: str | None, ask: Callable[[CubeQuery], tuple[object, dict]]) -> tuple[str, int, int | None, bool]:
    """(payload as JSON, attempts, bytes, whether it was in the cache)."""
    if cache:
        store, path = open_store(join_path(cache, f"{query.cache_key()}.json"))
        try:
            with store.open_input_stream(path) as f:
                return f.read().decode("utf-8"), 0, None, True
        except FileNotFoundError:
            pass
    payload, call = ask(query)
    text = json.dumps(payload, ensure_ascii=False)
    if cache:
        draft = f"{path}.{uuid.uuid4().hex}"
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(draft) as f:
            f.write(text.encode("utf-8"))
        store.move(draft, path)
    return text, call["attempts"], call["download_bytes"], False


def cube_source(transport: Callable[[str], tuple[int, bytes]] = http_get, wait: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """The data source class, to be registered; ``transport`` and ``wait`` go to the executors with it."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.requests, self.cache = json.loads(options["requests"]), options.get("cache")
            self.retries, self.base = int(options.get("retries", RETRIES)), options.get("base")

        def partitions(self):
            return [_Request(k, q, cells) for k, (q, cells) in enumerate(self.requests)]

        def read(self, partition) -> Iterator[tuple]:
            query = CubeQuery(**partition.query)
            more = {"base": self.base} if self.base else {}
            payload, attempts, size, hit = cached_payload(query, self.cache, lambda q: fetch(q, transport, self.retries, wait, **more))
            yield partition.value, query.cache_key(), query.url(**more), partition.cells, payload, attempts, size, hit

    class CubeSource(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    return CubeSource


def read_payloads(spark: SparkSession, query: CubeQuery, cache: str | None = None, localities: int | None = None, categories: int | None = None, limit: int = MAX_CELLS, concurrency: int = CONCURRENCY, **options: str) -> DataFrame:
    """A row per request of a registered source, asked for when an action runs; at most ``concurrency`` at a time.

    With a cache, an action that runs twice asks once.
    """
    requests = [(asdict(q), cells) for q, cells in split_query(query, localities, categories, limit)]
    reader = spark.read.format(NAME).option("requests", json.dumps(requests)).options(**options)
    return (reader.option("cache", cache) if cache else reader).load().coalesce(concurrency)
