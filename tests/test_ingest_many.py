"""Many external requests at a time, one program per task."""

import sys

from vitalgrid.sources import external
from vitalgrid.sources.readers import read_table

PROGRAM = """
import json, pathlib, sys, time
r = json.loads(pathlib.Path('request.json').read_text())
with open(sys.argv[1], 'a') as f:
    f.write(r['uf'] + '\\n')
if r['uf'] == 'HANG':
    time.sleep(600)
if r['uf'] == 'FAIL':
    pathlib.Path('manifest.json').write_text(json.dumps({'error_message': 'no such state'}))
    sys.exit(3)
pathlib.Path('raw.csv').write_text('A,B\\n1,"x\\ny"\\n')
if r['uf'] == 'HALF':
    sys.exit(12)
pathlib.Path('processed.csv').write_text('A,C\\n1,' + r['uf'] + '\\n')
"""


def test_twenty_requests(spark, tmp_path):
    ufs = [f"U{k}" for k in range(17)] + ["HANG", "FAIL", "HALF"]
    requests, root = [external.ExternalRequest("SIM", u, 2022, 2022) for u in ufs], f"file://{tmp_path}/root"
    command = [sys.executable, "-c", PROGRAM, str(tmp_path / "asked")]
    got = {r["uf"]: r for r in external.ingest_many(spark, requests, root, command, concurrency=4, poll=0.05, timeout=12).collect()}
    assert {u: got[u]["status"] for u in ufs[17:]} == {"HANG": "error", "FAIL": "error", "HALF": "raw_ok_process_error"}
    assert (got["HANG"]["exit_code"], got["FAIL"]["exit_code"], got["FAIL"]["error_message"], got["HALF"]["exit_code"]) == (41, 3, "no such state", 12)
    assert all(got[u]["status"] == "ok" and not got[u]["cache_hit"] for u in ufs[:17])
    assert read_table(spark, f"{got['U3']['folder']}/processed.csv").collect()[0]["C"] == "U3"
    assert read_table(spark, f"{got['HALF']['folder']}/raw.csv").collect()[0]["B"] == "x\ny"
    assert not [p for p in (tmp_path / "root").rglob("*.attempt-*")]
    asked = (tmp_path / "asked").read_text().split()
    assert sorted(asked) == sorted(ufs)  # each program ran once
    again = {r["uf"]: r for r in external.ingest_many(spark, [r for r in requests if r.uf != "HANG"], root, command, poll=0.05, timeout=12).collect()}
    assert all(again[u]["cache_hit"] for u in [*ufs[:17], "HALF"]) and not again["FAIL"]["cache_hit"]
    assert len((tmp_path / "asked").read_text().split()) == len(ufs) + 1  # only what failed ran again
