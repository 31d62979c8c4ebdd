import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from vitalgrid import cli
from vitalgrid.plans import workflows
from vitalgrid.plans.registries import RegistryError, load_registries, read_settings
from vitalgrid.plans.settings import SettingsError, load_settings
from vitalgrid.sources import cube_client, external
from vitalgrid.sources.files import file_hash
from vitalgrid.sources.readers import read_table, write_parquet
from vitalgrid.streaming.events import normalized_stream, windowed_counts

RAW_CSV = """DTOBITO,DTNASC,IDADE,SEXO,RACACOR,CODMUNRES,CODMUNOCOR,CODESTAB,CAUSABAS,DIFDATA,TPPOS,ALTCAUSA
20190614,19440309,4075,2,1,355030,355030,2077485,C349,12,2,1
20190702,,4031,1,4,355030,330455,,*V892,1,,2
20200318,20200301,2017,1,2,330455,330455,2269311,P220,"",,
2020-13-45,"",7012,3,,12,330455,,"",abc,1,2
"""
POPULATION_CSV = "year,municipality_cod6,population,population_state\n2019,355030,800.0,valid\n2020,330455,500.0,valid\n"


@pytest.fixture
def files(tmp_path):
    raw, people = tmp_path / "raw.csv", tmp_path / "people.csv"
    raw.write_text(RAW_CSV)
    people.write_text(POPULATION_CSV)
    return str(raw), str(people)


def test_readers(spark, files, tmp_path):
    rows = read_table(spark, files[0]).collect()
    assert (rows[3]["CAUSABAS"], rows[3]["RACACOR"], rows[0]["IDADE"]) == ("", None, "4075")
    (tmp_path / "t.TSV").write_text("a\tb\n1\t\n")
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "t.TSV")).collect()] == [("1", None)]
    write_parquet(spark.range(3), str(tmp_path / "p.parquet"))
    assert read_table(spark, str(tmp_path / "p.parquet")).count() == 3
    (tmp_path / "lines.csv").write_text('a,b\n"1\n2",x\n')
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "lines.csv"), multi_line=True).collect()] == [("1\n2", "x")]
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "x.xlsx"))


def test_mortality_run_end_to_end(spark, files, tmp_path):
    out = workflows.mortality_run(spark, files[0], files[1], str(tmp_path / "out"), {"k": 1}, files[0])
    assert (out["n_fields"], out["n_edges"]) == (3, 2) and out["n_warnings"] >= 1
    bundle = workflows.Bundle(spark, out["run_dir"])
    rate = {(r["year"], r["municipality_cod6"]): r["mortality_rate_scaled"] for r in bundle.read_field(out["mortality_rate_field_id"]).collect()}
    assert rate == {(2019, "355030"): 250.0, (2020, "330455"): 200.0}
    assert read_settings(bundle.path("UserIntent")) == {"k": 1}
    contract = workflows.adapter("SIM-DO").contract(["dtobito", "IDADE"])
    assert not contract["ok"] and contract["missing_required"] == ["SEXO", "RACACOR", "CODMUNRES", "CAUSABAS"] and len(contract["warnings"]) == 2
    with pytest.raises(ValueError):
        workflows.adapter("SINASC")


QUERY = cube_client.CubeQuery("6579", ["2022"], ["9324"], "N6[all]", ["2[6794]"])
PAYLOAD = [
    {"NC": "Nível", "V": "Valor", "D1C": "Município (Código)"},
    {"NC": "6", "NN": "M", "MN": "P", "V": "1.000", "D1C": "2704302", "D1N": "A", "D2C": "9324", "D2N": "Pop", "D3C": "2022", "D3N": "2022"},
]


def test_cube_client(spark, tmp_path):
    assert QUERY.url("http://x/") == "http://x/6579/periodos/2022/variaveis/9324?localidades=N6%5Ball%5D&view=flat&classificacao=2%5B6794%5D"
    answers, waits = [(500, b"no"), (200, b"junk"), (200, json.dumps(PAYLOAD).encode())], []
    facts, manifest = cube_client.fetch_facts(spark, QUERY, tmp_path, transport=lambda _: answers.pop(0), wait=waits.append)
    assert (manifest["timings_seconds"]["http_attempts"], waits, manifest["cache_hit"], facts.first()["value"]) == (3, [0.25, 0.5], False, 1000.0)
    assert cube_client.fetch_facts(spark, QUERY, tmp_path)[1]["cache_hit"]
    with pytest.raises(cube_client.CubeClientError):
        cube_client.fetch(QUERY, transport=lambda _: (404, b""), retries=1, wait=waits.append)
    empty = cube_client.CubeQuery("1", ["2022"], ["1"], "N1")
    with pytest.raises(cube_client.CubeClientError, match="no facts"):
        cube_client.fetch_facts(spark, empty, tmp_path, transport=lambda _: (200, b"[]"))


def test_cube_mortality_run(spark, files, tmp_path):
    out = workflows.cube_mortality_run(spark, files[0], QUERY, str(tmp_path), transport=lambda _: (200, json.dumps(PAYLOAD).encode()))
    assert out["projection_report"]["n_after_value_state"] == 1 and out["rate_state"] == "fragile"


def test_ingest(spark, tmp_path):
    code = "import pathlib;pathlib.Path('raw.csv').write_text('A,B\\n1,x\\n');pathlib.Path('processed.csv').write_text('A,C\\n1,y\\n')"
    request = external.ExternalRequest("sim", "al", 2022, 2022, 1, 12)
    assert (request.system, request.period) == ("SIM-DO", "2022_01__2022_12")
    got = external.ingest(spark, request, tmp_path, [sys.executable, "-c", code], poll=0.05)
    assert (got["status"], got["raw_rows"], got["processed_columns"]) == ("ok", 1, ["A", "C"])
    assert external.ingest(spark, request, tmp_path, ["never"], poll=0.05)["cache_hit"]
    raw_only = external.ExternalRequest("SIH", "AL", 2022, 2022)
    assert external.ingest(spark, raw_only, tmp_path, [sys.executable, "-c", "import pathlib,sys;pathlib.Path('raw.csv').write_text('A\\n1\\n');sys.exit(12)"], poll=0.05)["status"] == "raw_ok_process_error"
    slow = external.ExternalRequest("SINASC", "AL", 2022, 2022)
    got = external.ingest(spark, slow, tmp_path, [sys.executable, "-c", "import time;time.sleep(60)"], poll=0.05, timeout=0.3)
    assert (got["status"], got["exit_code"]) == ("error", 41)
    with pytest.raises(ValueError):
        external.normalize_system("XYZ")


def test_file_hashes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, data in (("b", b"two"), ("a", b"one")):
        (tmp_path / "f" / name).write_bytes(data)
    one, two = (hashlib.sha256(x).hexdigest() for x in (b"one", b"two"))
    assert file_hash(spark, str(tmp_path / "f" / "a")) == one
    assert file_hash(spark, str(tmp_path / "f")) == hashlib.sha256((one + two).encode()).hexdigest()


def test_settings(tmp_path):
    texts = {"project": dict.fromkeys(["name", "package_name", "version", "registry_version", "timezone", "default_locale"], "x"), "paths": dict.fromkeys(["root", "data_root", "raw", "processed", "metadata", "cache", "manifests", "intermediate", "runs", "diagnostics", "config", "registries", "intents"], "y")}
    texts |= {"compute": {"data_backend": "spark", "numerical_backend": "numpy"}, "sidra": {"base_url": "http://x", "max_retries": "7", "backoff_max_seconds": 3, "unknown": 1}, "datasus": {}}
    for name, values in texts.items():
        (tmp_path / f"{name}.json").write_text("\ufeff" + json.dumps({name: values}), encoding="utf-8")
    got = load_settings(tmp_path)
    assert got["sidra"]["max_retries"] == 7 and got["sidra"]["backoff_max_seconds"] == 3.0 and "unknown" not in got["sidra"] and got["datasus"]["heartbeat_timeout_seconds"] == 900
    for name, values in (("sidra", {}), ("sidra", {"base_url": 1}), ("compute", {"data_backend": "s", "numerical_backend": "n", "wsl_required": "maybe"})):
        with pytest.raises(SettingsError):
            (tmp_path / f"{name}.json").write_text(json.dumps({name: values}))
            load_settings(tmp_path)


def test_registry_manifest(tmp_path):
    entry = {"id": "a", "numerator_carrier": "Deaths", "denominator_carrier": "Population", "role": "mortality_rate"}
    (tmp_path / "own.json").write_text(json.dumps({"entries": [entry]}))
    (tmp_path / "registry_manifest.json").write_text(json.dumps({"registries": {"carrier_registry": {"path": "own.json"}}}))
    got = load_registries(tmp_path)
    assert got.carriers == (("Deaths", "Population", "mortality_rate"),)
    assert got.hashes()["carrier_registry"] == hashlib.sha256((tmp_path / "own.json").read_bytes()).hexdigest() and "registry_manifest" in got.hashes()
    (tmp_path / "own.json").unlink()
    with pytest.raises(RegistryError):
        load_registries(tmp_path)


def test_registry_files(tmp_path):
    (tmp_path / "carrier_registry.json").write_text("﻿" + json.dumps({"entries": [{"id": "a", "numerator_carrier": "Deaths", "denominator_carrier": "Population", "role": "mortality_rate", "legal": True}]}), encoding="utf-8")
    assert load_registries(tmp_path).carriers == (("Deaths", "Population", "mortality_rate"),)


def test_stream_equals_batch(spark, files, tmp_path):
    batch = read_table(spark, files[0]).selectExpr("*", "cast(monotonically_increasing_id() as long) as n")
    write_parquet(batch, str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(normalized_stream(stream, "n"), "1 day", "365 days").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["death_count"] for r in spark.table("counts").collect()) == 3


def test_cli(files, tmp_path, capsys, spark):
    assert len(cli.COMMANDS) == 20
    assert cli.main(["validate-registries"]) == 0 and cli.main(["adapters"]) == 0
    assert cli.main(["mortality-run", "--raw", files[0], "--population", files[1], "--out-root", str(tmp_path / "o")]) == 0
    assert '"n_fields": 3' in capsys.readouterr().out


def test_one_row_group_is_spread_over_all_cores(spark, tmp_path):
    from vitalgrid.sources.readers import spread

    cores = spark.sparkContext.defaultParallelism
    path = f"{tmp_path}/one.parquet"
    spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) as text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")  # many splits of the file, of which one has all rows
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= cores
        counts = [r["count"] for r in spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(counts) == 20_000 and max(counts) <= 20_000 // cores + 1000
