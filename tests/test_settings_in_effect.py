"""Settings that the client and the ingest use, and the provenance registry's rules."""

import json

import pytest

from vitalgrid.plans.registries import RegistryError, load_registries
from vitalgrid.sources import cube_client, external

SETTINGS = {
    "sidra": {"timeout_seconds": 7, "max_retries": 2, "base_url": "http://x", "backoff_initial_seconds": 1.0, "backoff_max_seconds": 1.5},
    "datasus": {"r_timeout_seconds": 30, "heartbeat_timeout_seconds": 4},
}


def test_client_and_ingest_take_their_limits_from_the_settings():
    asked, waits = [], []

    def transport(url, timeout):
        asked.append((url, timeout))
        return 503, b""

    query = cube_client.CubeQuery("1", ["2022"], ["9"], "N1")
    with pytest.raises(cube_client.CubeClientError, match="3 attempts"):
        cube_client.fetch(query, wait=waits.append, **cube_client.fetch_options(SETTINGS, transport))
    assert waits == [1.0, 1.5] and {t for _, t in asked} == {7.0} and all(u.startswith("http://x/1/") for u, _ in asked)
    assert external.limits_of(SETTINGS) == {"timeout": 30.0, "stale_after": 4.0}


PROVENANCE = {
    "primitive": ["official", "latent", "prior"],
    "rules": [
        {"id": "a", "if_any_parent": "latent", "child_warning": "latent_inherited", "dashboard_safe": False},
        {"id": "b", "if_any_parent": "prior", "with_numerator_source": "SIM", "child_warning": "feedback", "dashboard_safe": "warning"},
        {"id": "c", "if_any_parent": "prior", "blocked_role": "disease_outcome", "child_warning": "blocked", "dashboard_safe": False},
    ],
}


def test_provenance_registry(tmp_path):
    path = tmp_path / "provenance_registry.json"
    path.write_text(json.dumps(PROVENANCE))
    r = load_registries(tmp_path)
    assert r.provenance_labels == ("official", "latent", "prior") and "provenance_registry" in r.hashes()
    assert r.inherited({"official"}) == ([], True)
    assert r.inherited({"latent", "official"}) == (["latent_inherited"], False)
    assert r.inherited({"prior"}, {"SIM-DO"}, "mortality_rate") == (["feedback"], "warning")
    assert r.inherited({"prior"}, {"SIMPLE"}, "disease_outcome") == (["blocked"], False)
    for broken in ({"rules": []}, {"primitive": ["x"], "rules": PROVENANCE["rules"][:1]}, PROVENANCE | {"rules": PROVENANCE["rules"][:1] * 2}):
        path.write_text(json.dumps(broken))
        with pytest.raises(RegistryError):
            load_registries(tmp_path)


def test_a_manifest_entry_needs_a_path(tmp_path):
    (tmp_path / "registry_manifest.json").write_text(json.dumps({"registries": {"carrier_registry": {}}}))
    with pytest.raises(RegistryError, match="without a path"):
        load_registries(tmp_path)
