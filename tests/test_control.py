import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import control
from tessera.plans import catalog
from tessera.sources.store import table

SF = "/root/testdata/sf0.001"


def test_every_order_is_a_generation(spark):
    orders = table(spark, SF, "orders").count()
    assert catalog.generations(spark, SF).count() == catalog.candidates(spark, SF).count() == orders
    assert sum(r["n"] for r in catalog.filtered_counts(spark, SF).collect()) == orders


def test_all_moves_of_a_generation(spark):
    """All 81 pairs of states; the moves are those of the state table in the survey."""
    states = ["CREATING", "LOADING", "CATCHING_UP", "VALIDATING", "READY", "SERVING", "RETIRING", "RETIRED", "FAILED"]
    may = {
        "CREATING LOADING", "CREATING FAILED", "LOADING CATCHING_UP", "LOADING VALIDATING", "LOADING FAILED", "CATCHING_UP VALIDATING", "CATCHING_UP FAILED", "VALIDATING READY", "VALIDATING FAILED",
        "READY SERVING", "READY FAILED", "SERVING RETIRING", "RETIRING RETIRED", "RETIRING SERVING", "RETIRING FAILED",
    }
    rows = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    assert {f"{r['a']} {r['b']}" for r in rows.where(control.legal(F.col("a"), F.col("b"))).collect()} == may


def test_newest_failed_is_kept_though_protected(spark):
    rows = spark.createDataFrame([("s", k, "FAILED", k) for k in (1, 2, 3)] + [("s", 4, "RETIRED", 4), ("s", 5, "READY", 5)], "source string, generation long, state string, created_at long")
    free = lambda held: sorted(r["generation"] for r in control.retained(rows, spark.createDataFrame([("s", g) for g in held], "source string, generation long")).collect())
    assert free([3]) == [1, 2, 4] and free([1]) == [2, 4] and free([]) == [1, 2, 4] and free([4, None]) == [1, 2]


def test_reconcile(spark):
    rows = [("two", 1, "SERVING"), ("two", 2, "SERVING"), ("none", 1, "READY"), ("lost", 1, "SERVING"), ("idle", 1, "READY"), ("other", 1, "SERVING"), ("other", 2, "RETIRED"), ("ill", 1, "SERVING"), ("next", 1, "SERVING"), ("next", 2, "READY"), ("back", 1, "SERVING"), ("back", 2, "READY"), ("fine", 1, "SERVING"), ("busy", 1, "SERVING")]
    held = [("two", 1, None), ("lost", 2, None), ("idle", 1, None), ("other", 2, None), ("ill", 1, None), ("next", 1, None), ("back", 1, 2), ("fine", 1, None), ("gone", 7, None), ("busy", 1, None)]
    made = control.reconcile(
        spark.createDataFrame(rows, "source string, generation long, state string"), spark.createDataFrame(held, "source string, generation long, previous long"),
        spark.createDataFrame([("busy", "PREPARING"), ("fine", "FINALIZED")], "source string, state string"),
        spark.createDataFrame([(s, g, "unhealthy" if s == "ill" else "healthy") for s, g, _ in rows], "source string, generation long, health string"),
    )
    assert "collect_set" not in made._jdf.queryExecution().toString()
    assert {r["source"]: r["status"] for r in made.collect()} == {
        "two": "POINTER_REGISTRY_MISMATCH", "none": "POINTER_MISSING", "lost": "POINTER_TARGET_MISSING", "gone": "POINTER_TARGET_MISSING", "idle": "POINTER_REGISTRY_MISMATCH", "other": "POINTER_REGISTRY_MISMATCH",
        "ill": "SERVING_GENERATION_UNAVAILABLE", "next": "CONSISTENT_WITH_READY_CANDIDATE", "back": "CONSISTENT", "fine": "CONSISTENT", "busy": "AMBIGUOUS_PROMOTION",
    }


def test_freshness_of_ties_and_of_the_never_indexed(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(0, (at(5), 7), (at(5), 8)), (1, (at(5), 8), (at(5), 8)), (2, None, (at(5), 1)), (3, None, None), (4, (at(2), 99), (at(5), 1)), (5, (at(6), 0), (at(5), 9))]
    made = control.freshness(F.col("indexed"), F.col("head"), F.lit("2024-01-01 00:01:00").cast("timestamp"))
    out = spark.createDataFrame(rows, "k int, indexed struct<ts timestamp, rcid long>, head struct<ts timestamp, rcid long>").select("k", *[c.alias(n) for n, c in made.items()])
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {0: (False, 0, 55), 1: (True, 0, 55), 2: (False, 55, 55), 3: (True, 0, None), 4: (False, 3, 55), 5: (True, 0, 55)}
