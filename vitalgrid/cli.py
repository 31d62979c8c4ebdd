"""Command line: ``python -m vitalgrid.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import platform
import sys

from vitalgrid.plans.registries import Registries, load_registries, read_settings, validate


def _session():
    from vitalgrid.session import build_session

    return build_session("vitalgrid-cli")


def _registries(args) -> Registries:
    return load_registries(args.registries) if args.registries else Registries()


def _bundle(args):
    from vitalgrid.plans.bundle import Bundle

    return Bundle(_session(), args.run_dir)


def doctor(args):
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__}


def validate_config(args):
    from vitalgrid.plans.settings import load_settings

    return load_settings(args.config)


def validate_registries(args):
    r = _registries(args)
    validate(r)
    return {"carriers": len(r.carriers), "units": len(r.units), "race_axes": len(r.race_axes), "hashes": r.hashes()}


def compile_intent(args):
    from vitalgrid.plans.workflows import compile_bundle

    return {"run_dir": str(compile_bundle(_session(), args.runs, read_settings(args.intent), registries=_registries(args)).folder)}


def normalize(args):
    from vitalgrid.plans.workflows import adapter
    from vitalgrid.sources.readers import read_table, write_parquet

    return {"normalized": write_parquet(adapter(args.system).normalize(read_table(_session(), args.input), args.manifest_hash), args.output)}


def process_local(args):
    from vitalgrid.plans.workflows import process_local as run

    return run(_session(), args.raw, args.out_root, args.processed, args.system, args.normalize_from)


def adapters(args):
    from vitalgrid.plans.workflows import ADAPTERS

    return sorted(ADAPTERS)


def compile_counts(args):
    from vitalgrid.plans.workflows import compile_counts as run

    return {"field_id": run(_bundle(args), args.normalized, _registries(args), args.geography).field.id}


def list_fields(args):
    return [r.asDict() for r in _bundle(args).fields().collect()]


def import_population(args):
    from vitalgrid.plans.workflows import import_population as run

    return {"field_id": run(_bundle(args), args.population, _registries(args), args.source_label).field.id}


def compile_rate(args):
    from vitalgrid.plans.workflows import compile_rate as run

    return {"field_id": run(_bundle(args), args.death_count_field_id, args.population_field_id, _registries(args)).field.id}


def mortality(args):
    from vitalgrid.plans.workflows import mortality_run

    return mortality_run(_session(), args.raw, args.population, args.out_root, read_settings(args.intent) if args.intent else None, args.processed, args.source_label, args.geography)


def cube_fetch(args):
    from vitalgrid.plans.settings import load_settings
    from vitalgrid.sources.cube_client import CubeQuery, fetch_facts, fetch_options

    options = fetch_options(load_settings(args.config)) if args.config else {}
    return fetch_facts(_session(), CubeQuery.load(args.spec), args.out_root, args.allow_empty, not args.no_cache, **options)[1]


def cube_export(args):
    from vitalgrid.operators import cube
    from vitalgrid.sources.readers import write_parquet

    facts = _session().read.parquet(args.facts)
    path = write_parquet(cube.facts_to_denominator(facts, args.table_id, args.variable_id, args.source_label, args.level_id), args.output)
    return cube.projection_report(facts, _session().read.parquet(path), table_id=args.table_id, variable_id=args.variable_id, level_id=args.level_id)


def cube_diagnose(args):
    from vitalgrid.operators.cube import diagnose

    return diagnose(_session().read.parquet(args.facts))


def cube_prepare(args):
    from vitalgrid.plans.workflows import prepare_population

    return prepare_population(_session(), args.spec, args.out_root, args.output, args.table_id, args.variable_id, args.source_label, args.level_id)


def cube_import(args):
    from vitalgrid.plans.workflows import import_population as run

    prepared = cube_prepare(args)
    bundle = _bundle(args)
    return {"field_id": run(bundle, bundle.spark.read.parquet(prepared["denominator"]), _registries(args), args.source_label).field.id, "report": prepared["report"]}


def cube_mortality(args):
    from vitalgrid.plans.workflows import cube_mortality_run

    return cube_mortality_run(_session(), args.raw, args.spec, args.out_root, args.source_label)


def ingest(args):
    from vitalgrid.plans.settings import load_settings
    from vitalgrid.sources.external import ExternalRequest, limits_of
    from vitalgrid.sources.external import ingest as run

    limits = limits_of(load_settings(args.config)) if args.config else {"timeout": args.timeout, "stale_after": args.heartbeat_timeout}

    request = ExternalRequest(args.system, args.uf, args.year_start, args.year_end or args.year_start, args.month_start, args.month_end)
    return run(_session(), request, args.out_root, args.command, not args.no_cache, **limits)


#: Command, function, and its options; those with a trailing ``?`` may be left out.
_CUBE = ["table-id?", "variable-id?", "source-label?=SIDRA_population", "level-id?=6"]
COMMANDS = {
    "doctor": (doctor, []),
    "validate-config": (validate_config, ["config"]),
    "validate-registries": (validate_registries, ["registries?"]),
    "compile": (compile_intent, ["intent", "runs?=runs", "registries?"]),
    "normalize": (normalize, ["input", "output", "system?=SIM-DO", "manifest-hash?="]),
    "process-local": (process_local, ["raw", "processed?", "out-root", "system?=SIM-DO", "normalize-from?=raw"]),
    "process-local-deaths": (process_local, ["raw", "processed?", "out-root", "system?=SIM-DO", "normalize-from?=raw"]),
    "adapters": (adapters, []),
    "compile-death-counts": (compile_counts, ["normalized", "run-dir", "geography?=residence", "registries?"]),
    "fields": (list_fields, ["run-dir"]),
    "population-import": (import_population, ["population", "run-dir", "source-label?=imported_population_fixture", "registries?"]),
    "compile-crude-rate": (compile_rate, ["run-dir", "death-count-field-id", "population-field-id", "registries?"]),
    "mortality-run": (mortality, ["raw", "population", "out-root", "intent?", "processed?", "source-label?=imported_population_fixture", "geography?=residence"]),
    "cube-fetch": (cube_fetch, ["spec", "out-root", "allow-empty!", "no-cache!", "config?"]),
    "cube-population-export": (cube_export, ["facts", "output", *_CUBE]),
    "cube-diagnose-facts": (cube_diagnose, ["facts"]),
    "cube-population-prepare": (cube_prepare, ["spec", "out-root", "output", *_CUBE]),
    "cube-population-import": (cube_import, ["run-dir", "spec", "out-root", "output", *_CUBE, "registries?"]),
    "cube-mortality-run": (cube_mortality, ["raw", "spec", "out-root", "source-label?=SIDRA_population"]),
    "ingest": (ingest, ["system", "uf", "year-start#", "year-end#?", "month-start#?", "month-end#?", "out-root", "no-cache!", "timeout#?=7200", "heartbeat-timeout#?=900", "config?", "command*"]),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vitalgrid", description=__doc__)
    commands = out.add_subparsers(dest="name", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        sub.set_defaults(run=f)
        for option in options:
            key, _, default = option.partition("=")
            flag = "--" + key.rstrip("?!#*")
            if key.endswith("!"):
                sub.add_argument(flag, action="store_true")
            elif key.endswith("*"):
                sub.add_argument(flag, nargs=argparse.REMAINDER, required=True)
            else:
                kind = int if "#" in key else str
                sub.add_argument(flag, type=kind, required=not key.endswith("?"), default=kind(default) if default else ("" if "=" in option else None))
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    print(json.dumps(args.run(args), indent=2, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
