"""Client of the statistical office's aggregates API, with a cache of raw payloads.

The transport is a parameter, so everything but the network is testable.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import partial
from pathlib import Path
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.operators.cube import facts_of
from vitalgrid.plans.registries import read_settings, sha256_json
from vitalgrid.sources.readers import write_parquet

#: Address and limits of the service.
BASE_URL = "https://servicodados.ibge.gov.br/api/v3/agregados"
TIMEOUT_S, RETRIES, FIRST_WAIT_S, LONGEST_WAIT_S = 60.0, 5, 0.25, 10.0


class CubeClientError(RuntimeError):
    pass


@dataclass(frozen=True)
class CubeQuery:
    table_id: str
    periods: list[str]
    variables: list[str]
    localities: str
    classifications: list[str] = field(default_factory=list)
    view: str = "flat"
    description: str | None = None
    tags: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | Path) -> CubeQuery:
        raw = read_settings(path)
        texts = lambda v: [str(x) for x in v or []]
        return cls(str(raw["table_id"]), texts(raw["periods"]), texts(raw["variables"]), str(raw["localities"]), texts(raw.get("classifications")), raw.get("view", "flat"), raw.get("description"), texts(raw.get("tags")))

    def url(self, base: str = BASE_URL) -> str:
        params = {"localidades": self.localities, "view": self.view}
        if self.classifications:
            params["classificacao"] = "|".join(self.classifications)
        return f"{base.rstrip('/')}/{self.table_id}/periodos/{','.join(self.periods)}/variaveis/{','.join(self.variables)}?{urlencode(params)}"

    def cache_key(self) -> str:
        """Depends on every field, the description and tags too."""
        return sha256_json(asdict(self))


def http_get(url: str, timeout: float = TIMEOUT_S) -> tuple[int, bytes]:
    with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
        return response.status, response.read()


def fetch_options(settings: dict, transport: Callable[..., tuple[int, bytes]] = http_get) -> dict:
    """What ``fetch`` takes from the client's part of the settings: address, timeout, retries and waits."""
    s = settings["sidra"]
    return {"transport": partial(transport, timeout=float(s["timeout_seconds"])), "retries": s["max_retries"], "base": s["base_url"], "first_wait": s["backoff_initial_seconds"], "longest_wait": s["backoff_max_seconds"]}


def fetch(query: CubeQuery, transport: Callable[[str], tuple[int, bytes]] = http_get, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep, base: str = BASE_URL, first_wait: float = FIRST_WAIT_S, longest_wait: float = LONGEST_WAIT_S) -> tuple[Any, dict]:
    """The payload and what the request took. Any failure is tried again, after waits that double."""
    url, started, error = query.url(base), time.perf_counter(), None
    for attempt in range(retries + 1):
        try:
            status, body = transport(url)
            if status != 200:
                raise CubeClientError(f"HTTP {status}: {body[:500].decode('utf-8', 'replace')}")
            return json.loads(body), {"url": url, "attempts": attempt + 1, "download_bytes": len(body), "elapsed_seconds": time.perf_counter() - started}
        except Exception as e:  # noqa: BLE001
            error = e
            if attempt < retries:
                wait(min(first_wait * 2**attempt, longest_wait))
    raise CubeClientError(f"no payload after {retries + 1} attempts: {error}") from error


def read_payload(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_payload(path: str | Path, payload: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")


def fetch_facts(spark: SparkSession, query: CubeQuery, out_root: str | Path, allow_empty: bool = False, use_cache: bool = True, **options) -> tuple[DataFrame, dict]:
    """Payload from the cache or the service, its facts as Parquet, and a manifest with timings.

    Cached payloads are flattened anew. No facts at all is an error unless
    allowed, raised after everything has been written.
    """
    root, key = Path(out_root), query.cache_key()
    raw, facts_path, manifest_path = root / "raw" / f"{key}.json", root / "facts" / f"{key}.parquet", root / "manifests" / f"{key}.json"
    times, started = {}, time.perf_counter()

    def timed(name: str, f):
        t = time.perf_counter()
        out = f()
        times[name] = time.perf_counter() - t
        return out

    hit, call = use_cache and raw.exists(), {}
    if hit:
        payload = timed("cache_read", lambda: read_payload(raw))
    else:
        payload, call = timed("http_fetch_wall", lambda: fetch(query, **options))
        times |= {"http_fetch": call["elapsed_seconds"], "http_attempts": call["attempts"]}
        timed("raw_json_write", lambda: write_payload(raw, payload))
    facts, warnings = timed("normalize", lambda: facts_of(spark, payload, query.table_id, tuple(query.variables), tuple(query.periods)))
    timed("facts_write", lambda: write_parquet(facts, str(facts_path)))
    facts = spark.read.parquet(str(facts_path))
    n = facts.count()
    times["total"] = time.perf_counter() - started
    manifest = asdict(query) | {
        "url": query.url(), "cache_key": key, "cache_hit": hit, "download_bytes": call.get("download_bytes"), "timings_seconds": times, "raw_json_path": str(raw), "facts_path": str(facts_path),
        "manifest_path": str(manifest_path), "n_raw_top_level_items": len(payload) if isinstance(payload, list) else None, "n_facts": n, "empty_result": n == 0, "warnings": warnings,
    }
    write_payload(manifest_path, manifest)
    if not n and not allow_empty:
        raise CubeClientError(f"no facts in the payload of {query.url()}; warnings: {warnings}")
    return facts, manifest
