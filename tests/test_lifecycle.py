import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.operators import contracts, lifecycle

T = dt.datetime(2024, 1, 1)


def changes(spark, rows):
    return spark.createDataFrame([(T, k, *r) for k, r in enumerate(rows)], "ts timestamp_ntz, rcid long, action string, entity_id string, comment string")


def test_resolve(spark):
    rows = [("ENTITY_UNDELETE", "Q1", None), ("ENTITY_MERGE", "Q1", "from Q2 Q2"), ("ENTITY_MERGE", "Q1", "from Q2 Q3"), ("ENTITY_MERGE", "Q1", None), ("ENTITY_REDIRECT", "Q9", ""), ("ENTITY_EDIT", "Q1", "")]
    current = spark.createDataFrame([("Q1", "Q1", 7), ("Q2", "Q1", 7), ("Q3", "Q3", 4)], "id string, canonical string, revision long")
    out = {r["rcid"]: (r["unambiguous"], [tuple(e) for e in r["entities"]]) for r in lifecycle.resolve(changes(spark, rows), current).collect()}
    assert out == {0: (True, [("Q1", "Q1", 7, False)]), 1: (True, [("Q1", "Q1", 7, False), ("Q2", "Q1", 7, True)]), 2: (False, []), 3: (False, []), 4: (False, [])}


def test_tombstones(spark):
    rows = [("ENTITY_DELETE", "Q1", ""), ("ENTITY_DELETE", "Q1", ""), ("ENTITY_DELETE", "Q2", ""), ("ENTITY_UNDELETE", "Q2", ""), ("ENTITY_UNDELETE", "Q3", "")]
    state = spark.createDataFrame([("Q1", 20, "CURRENT", "c"), ("Q2", 5, "PENDING", "c"), ("Q3", 6, "PENDING", "c"), ("Q4", 1, "CURRENT", None)], "entity_id string, indexed_revision long, status string, checksum string")
    out = {r[0]: tuple(r)[1:] for r in lifecycle.after_lifecycle(state, changes(spark, rows)).collect()}
    assert out["Q1"] == (20, "DELETED", None, None) and out["Q2"] == (5, "CURRENT", "c", None)
    assert out["Q3"] == (6, "PENDING", "c", "UNDELETE_WITHOUT_TOMBSTONE") and out["Q4"] == (1, "CURRENT", None, None)


def test_deleted_property_loses_both_graphs(spark):
    quads = spark.createDataFrame([(f"urn:kg:{g}", "x") for g in ("entity:P1", "schema:P1", "entity:Q1", "schema:P2", "global")], "graph string, line string")
    gone = spark.createDataFrame([("P1",), ("Q1",)], "entity_id string")
    assert sorted(r["graph"] for r in lifecycle.without_deleted(quads, gone).collect()) == ["urn:kg:global", "urn:kg:schema:P2"]


def test_manifest_keys_are_exact(spark):
    good = {"manifestVersion": "snapshot-v1", "snapshotId": "0B0E8A5C-1111-4111-8111-0123456789ab", "sourceIdentity": "standalone", "createdAt": "2024-01-01T00:00:00Z",
            "cursor": {"timestamp": "2024-01-01T00:00:00Z", "rcid": 0}, "normalizationModel": "normalization-v1", "partitionModel": "partition-v1",
            "artifact": {"format": "application/n-triples", "sha256": "0" * 64, "bytes": 0, "graphCount": 1}}
    bad = [good | {"more": 1}, {k: v for k, v in good.items() if k != "createdAt"}, good | {"cursor": good["cursor"] | {"x": 1}}, good | {"artifact": good["artifact"] | {"graphCount": 0}}]
    texts = [json.dumps(x) for x in [good, *bad]] + ["", "[]", "no", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["v"] for r in rows.select("k", contracts.manifest_valid(F.col("t")).alias("v")).orderBy("k").collect()] == [True] + [False] * 8


def test_retirement_of_nothing_known(spark):
    key = "source string, generation long"
    none = spark.createDataFrame([], f"{key}, state string, protection string")
    out = contracts.retirement(spark.createDataFrame([("s", 1)], key), none, spark.createDataFrame([], "source string, current long, previous long"), spark.createDataFrame([], f"{key}, reason string"))
    assert out.first()["reasons"] == ["SERVING_POINTER_MISSING", "GENERATION_MISSING"]
