"""Records fetched by an external program, under supervision, into a partitioned layout.

The program writes ``raw.csv`` and ``processed.csv`` and touches a heartbeat
file. It is stopped when it takes too long or its heartbeat grows stale.

``ingest`` runs one request beside the driver. ``ingest_many`` runs a table of requests, one
supervised program per task: it works in a folder of its own, what it wrote goes to the shared
root under the attempt's name and is renamed to the request's place at the end. A task that runs again
finds what an earlier attempt has left there, or replaces nothing but its own attempt.
"""

from __future__ import annotations

import json
import os
import shutil
import signal
import subprocess
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession

from vitalgrid.operators.profile import compare_profiles, profile_columns
from vitalgrid.plans.contracts import utc_now
from vitalgrid.plans.registries import SYSTEM_ALIASES, sha256_json
from vitalgrid.sources.cube_client import read_payload, write_payload
from vitalgrid.sources.files import join_path, open_store
from vitalgrid.sources.readers import read_table, write_parquet

#: Limits in seconds, the exit code of a stopped program, and processing functions of the systems.
TIMEOUT_S, HEARTBEAT_S, POLL_S, STOPPED = 7200, 900, 2.0, 41
#: A stopped program may take so long to end by itself.
GRACE_S = 10.0
PROCESS_FUNCTIONS = {"SIM-DO": "process_sim", "SINASC": "process_sinasc", "SIH-RD": "process_sih", "CNES-ST": "process_cnes"}


def normalize_system(name: str) -> str:
    system = SYSTEM_ALIASES.get(name.strip().upper())
    if system is None:
        raise ValueError(f"unknown source system: {name}")
    return system


@dataclass(frozen=True)
class ExternalRequest:
    system: str
    uf: str
    year_start: int
    year_end: int
    month_start: int | None = None
    month_end: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "system", normalize_system(self.system))
        object.__setattr__(self, "uf", self.uf.strip().upper())

    @property
    def period(self) -> str:
        month = lambda m: "NA" if m is None else f"{m:02d}"
        return f"{self.year_start}_{month(self.month_start)}__{self.year_end}_{month(self.month_end)}"

    def request_hash(self) -> str:
        return sha256_json(asdict(self) | {"backend": "microdatasus", "information_system": self.system, "fetch_function": "fetch_datasus", "process_function": PROCESS_FUNCTIONS[self.system]})

    def folder(self, root: str | Path, kind: str) -> Path:
        """``kind/system/uf=../period=../hash``: partition folders that Spark discovers."""
        return Path(root) / "data" / kind / "datasus" / self.system / f"uf={self.uf}" / f"period={self.period}" / self.request_hash()


def supervise(command: list[str], cwd: Path, heartbeat: Path, logs: Path, timeout: float = TIMEOUT_S, stale_after: float = HEARTBEAT_S, poll: float = POLL_S) -> int:
    """Exit code of the command; 41 if it was stopped. Heartbeats from before its start don't count."""
    logs.mkdir(parents=True, exist_ok=True)
    with (logs / "stdout.log").open("w") as out, (logs / "stderr.log").open("w") as err:
        process, began = subprocess.Popen(command, cwd=cwd, stdout=out, stderr=err, start_new_session=True), time.time()
        while (code := process.poll()) is None:
            beat = heartbeat.stat().st_mtime if heartbeat.exists() else 0.0
            if time.time() - began > timeout or (beat >= began and time.time() - beat > stale_after):
                os.killpg(process.pid, signal.SIGTERM)
                try:
                    process.wait(GRACE_S)
                except subprocess.TimeoutExpired:
                    os.killpg(process.pid, signal.SIGKILL)
                    process.wait()
                return STOPPED
            time.sleep(poll)
    return code


def limits_of(settings: dict) -> dict:
    """What ``supervise`` takes from the ingest's part of the settings."""
    s = settings["datasus"]
    return {"timeout": float(s["r_timeout_seconds"]), "stale_after": float(s["heartbeat_timeout_seconds"])}


def outcome(code: int, has_raw: bool, has_processed: bool) -> str:
    return "ok" if code == 0 and has_raw and has_processed else "raw_ok_process_error" if code != 0 and has_raw else "error"


def ingest(spark: SparkSession, request: ExternalRequest, root: str | Path, command: list[str], use_cache: bool = True, **limits) -> dict:
    """Run the program and keep what it wrote; status ``ok``, ``raw_ok_process_error`` or ``error``.

    Raw Parquet of an equal earlier request is used again.
    """
    work, raw, processed, metadata, logs = (request.folder(root, k) for k in ("cache", "raw", "processed", "metadata", "diagnostics"))
    manifest_path = Path(root) / "data" / "manifests" / "datasus" / request.system / f"{request.request_hash()}.json"
    if use_cache and (raw / "raw.parquet").exists() and manifest_path.exists():
        return read_payload(manifest_path) | {"cache_hit": True}
    if not use_cache:
        shutil.rmtree(work, ignore_errors=True)
    work.mkdir(parents=True, exist_ok=True)
    started, began = utc_now(), time.perf_counter()
    code = supervise(command, work, work / "heartbeat.json", logs, **limits)
    has_raw, has_processed = (work / "raw.csv").exists(), (work / "processed.csv").exists()
    status = outcome(code, has_raw, has_processed)
    manifest = {"backend": "microdatasus", "status": status, "request": asdict(request), "request_hash": request.request_hash(), "command": command, "started_at": started, "exit_code": code, "cache_hit": False}
    said = read_payload(work / "manifest.json") if (work / "manifest.json").exists() else {}
    manifest["error_message"] = said.get("error_message") if status != "ok" else None
    profiles: dict[str, DataFrame] = {}
    if status != "error":
        for name, folder in (("raw", raw), ("processed", processed)):
            if name == "raw" or status == "ok":
                df = spark.read.parquet(write_parquet(read_table(spark, str(work / f"{name}.csv")), str(folder / f"{name}.parquet")))
                profiles[name] = spark.read.parquet(write_parquet(profile_columns(df), str(metadata / f"{name}_profile.parquet")))
                manifest |= {f"{name}_rows": df.count(), f"{name}_columns": df.columns}
    if len(profiles) == 2:
        write_parquet(compare_profiles(profiles["raw"], profiles["processed"]), str(metadata / "comparison.parquet"))
    manifest |= {"completed_at": utc_now(), "elapsed_seconds": time.perf_counter() - began}
    write_payload(manifest_path, manifest)
    return manifest


RESULT = "number long, system string, uf string, period string, request_hash string, status string, exit_code int, error_message string, folder string, elapsed_seconds double, cache_hit boolean"
_KEPT = ("raw.csv", "processed.csv", "manifest.json", "stdout.log", "stderr.log")


def _run_request(request: ExternalRequest, root: str, command: list[str], limits: dict) -> tuple:
    """(status, exit code, message, folder, seconds, cache hit) of one request; what it wrote stands in the folder, logs of failures too."""
    began, key = time.perf_counter(), request.request_hash()
    place = join_path(root, "data", "ingested", "datasus", request.system, f"uf={request.uf}", f"period={request.period}", key)
    store, path = open_store(place)
    done = f"{path}/outcome.json"
    if store.get_file_info(done).type != pa_fs.FileType.NotFound:
        with store.open_input_stream(done) as f:
            said = json.loads(f.read())
        return said["status"], said["exit_code"], said["error_message"], place, time.perf_counter() - began, True
    with tempfile.TemporaryDirectory(prefix="request-") as own:
        work = Path(own)
        write_payload(work / "request.json", asdict(request))
        code = supervise(command, work, work / "heartbeat.json", work, **limits)
        status = outcome(code, (work / "raw.csv").exists(), (work / "processed.csv").exists())
        said = read_payload(work / "manifest.json") if (work / "manifest.json").exists() else {}
        message = said.get("error_message") if status != "ok" else None
        if status == "error":
            place = join_path(root, "data", "diagnostics", "datasus", request.system, key, uuid.uuid4().hex)
            path = open_store(place)[1]
        else:
            write_payload(work / "outcome.json", {"status": status, "exit_code": code, "error_message": message})
        attempt = f"{path}.attempt-{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        for name in (*_KEPT, "outcome.json"):
            if (work / name).exists():
                with (work / name).open("rb") as source, store.open_output_stream(f"{attempt}/{name}", compression=None) as sink:
                    shutil.copyfileobj(source, sink, 1 << 20)
        try:
            store.move(attempt, path)
        except OSError:  # another attempt at the same request was first
            store.delete_dir(attempt)
    return status, code, message, place, time.perf_counter() - began, False


def ingest_many(spark: SparkSession, requests: list[ExternalRequest], root: str, command: list[str], concurrency: int = 8, **limits) -> DataFrame:
    """A row per request with its status and the folder of its files; at most ``concurrency`` programs run at a time.

    The program finds its request as ``request.json``. ``root`` may be on any store that tasks can open and that renames
    folders. The result is written, so programs run once; failed requests run again in the next call.
    """
    rows = [(k, json.dumps(asdict(r))) for k, r in enumerate(requests)]
    table = spark.createDataFrame(rows, "number long, request string").repartitionByRange(max(1, len(rows)), "number").coalesce(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, text in zip(batch["number"].tolist(), batch["request"].tolist(), strict=True):
                r = ExternalRequest(**json.loads(text))
                yield pd.DataFrame([(number, r.system, r.uf, r.period, r.request_hash(), *_run_request(r, root, command, limits))], columns=[c.split()[0] for c in RESULT.split(", ")])

    path = join_path(root, "data", "results", f"{uuid.uuid4().hex}.parquet")
    table.mapInPandas(run, RESULT).write.parquet(path)
    return spark.read.parquet(path)
