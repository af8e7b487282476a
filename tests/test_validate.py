"""Contracts compiled to columns: sound and broken texts of each kind."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import validate
from tessera.plans.catalog import CONTRACT

RUNTIME = validate.runtime("runtime-v1", "kg", ("one", "two"))
DESCRIPTOR = {
    "generationId": "gen-a", "sourceIdentity": "local.x", "backendType": "one", "partitionModel": "p", "normalizationModel": "n", "more": 1,
    "queryEndpoint": {"access": "internal-read", "url": "http://127.0.0.1:3030/q"}, "internalUpdateEndpoint": {"access": "internal-write", "url": "http://127.0.0.1:3030/u"},
}
CAPABILITIES = dict.fromkeys(validate.CAPABILITIES, True)
MANIFEST = {
    "version": 1, "fixtureType": "f", "subjectItem": "Q1", "targetItem": "Q2", "properties": {k: "P1" for k in validate.FIXTURE_PROPERTIES}, "expected": {k: "x" for k in validate.FIXTURE_VALUES},
}


def changed(value, path, new):
    value = json.loads(json.dumps(value))
    at = value
    *way, last = path.split(".")
    for k in way:
        at = at[k]
    if new is None:
        del at[last]
    else:
        at[last] = new
    return value


def faults(spark, contract, values):
    rows = spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "k int, text string")
    return [r["f"] for r in rows.select("k", validate.faults(rows["text"], contract).alias("f")).orderBy("k").collect()]


def test_runtime(spark):
    sound = json.loads(CONTRACT)
    off = changed(sound, "queryService", {"enabled": False})
    cases = [(sound, []), (off, []), (None, ["contract"]), ("{", ["contract"]), ("3", ["contract"]), (changed(off, "queryService", {"enabled": False, "x": 1}), ["queryService.unexpected-or-missing-field"]), (changed(off, "queryService", {}), ["queryService.enabled"]), (changed(sound, "queryService", []), ["queryService"])]
    for path, new, bad in [
        ("contractVersion", "v2", ["contractVersion"]), ("contractVersion", None, ["contract.unexpected-or-missing-field"]), ("more", 1, ["contract.unexpected-or-missing-field"]), ("instance.id", 5, ["instance.id"]),
        ("queryService.syncState", "IDLE", ["queryService.syncState"]), ("queryService.backendType", "three", ["queryService.backendType"]), ("queryService.freshness.sourceIdleSeconds", 1.5, ["queryService.freshness.sourceIdleSeconds"]),
        ("queryService.freshness.sourceHeadTimestamp", "yesterday", ["queryService.freshness.sourceHeadTimestamp"]), ("endpoints.mediawiki", "no url", ["endpoints.mediawiki"]), ("endpoints", "x", ["endpoints"]),
        ("capabilities.instanceStopPreservesData", "true", ["capabilities.instanceStopPreservesData"]),
    ]:
        cases.append((changed(sound, path, new), bad))
    assert faults(spark, RUNTIME, [c for c, _ in cases]) == [bad for _, bad in cases]


@pytest.mark.parametrize("contract, sound, cases", [
    (validate.descriptor("p", "n", ("one",), r"^127\.0\.0\.1$"), DESCRIPTOR, [("generationId", "gen-A", "generationId"), ("partitionModel", "q", "partitionModel"), ("queryEndpoint.url", "http://example.com/", "queryEndpoint.url"), ("queryEndpoint.url", "https://127.0.0.1/", "queryEndpoint.url"), ("internalUpdateEndpoint.access", "internal-read", "internalUpdateEndpoint.access"), ("sourceIdentity", None, "contract.unexpected-or-missing-field")]),
    (validate.capabilities(), CAPABILITIES, [("namedGraphs", 1, "namedGraphs"), ("geoSparql", None, "contract.unexpected-or-missing-field"), ("other", True, "contract.unexpected-or-missing-field")]),
    (validate.fixture_manifest("f"), MANIFEST, [("version", 2, "version"), ("subjectItem", "P1", "subjectItem"), ("properties.item", "Q1", "properties.item"), ("properties.more", "P1", "properties.unexpected-or-missing-field"), ("expected.time", "", "expected.time"), ("expected.time", "x" * 201, "expected.time"), ("expected.quantity", 42, "expected.quantity")]),
])
def test_other_contracts(spark, contract, sound, cases):
    assert faults(spark, contract, [sound] + [changed(sound, path, new) for path, new, _ in cases]) == [[]] + [[bad] for _, _, bad in cases]


def test_a_text_is_parsed_once(spark):
    """However many tests a contract has."""
    rows = spark.createDataFrame([(CONTRACT,)], "text string").select(validate.faults(F.col("text"), RUNTIME).alias("f"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and plan.count("queryService.freshness.lagSeconds,") <= 2
