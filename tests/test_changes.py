import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import changes
from tessera.streaming.fence import fence_stream


def events(spark, revs, entity="Q1"):
    t = dt.datetime(2024, 1, 1)
    rows = [(entity, t, k, r, o) for k, (r, o) in enumerate(revs)]
    return spark.createDataFrame(rows, "entity_id string, ts timestamp_ntz, rcid long, revid long, old_revid long")


def test_fence_sequence(spark):
    out = changes.fence(events(spark, [(20, 0), (21, 20), (21, 20), (20, 0), (22, 21)]), 4).orderBy("rcid").collect()
    assert [r["decision"] for r in out] == ["APPLY", "APPLY", "DUPLICATE", "OLDER", "APPLY"] and out[-1]["indexed"] == 22


def test_gap_stops_the_source(spark):
    out = changes.fence(events(spark, [(20, 0), (22, 21), (23, 22)]), 4)
    assert changes.before_stop(out).count() == 1
    state = changes.entity_state(out).first()
    assert (state["indexed_revision"], state["latest_seen_revision"], state["status"]) == (20, 23, "GAP")


def test_classes(spark):
    rows = [
        ("log", "Item:Q1", "delete", "delete", "", [], False), ("log", "x", "merge", "merge", "", [], False), ("log", "Item:Q1", "y", "z", "", [], False),
        ("edit", "Talk:Q1", None, None, "", [], False), ("edit", "Item:Q1", None, None, "", ["mw-new-redirect"], False), ("new", "Property:P2", None, None, "", [], False),
        ("edit", "Item:Q1", None, None, "/* wbmergeitems-to */", [], False), ("edit", "Item:Q1", None, None, "", [], True), ("move", "Item:Q1", None, None, "", [], False),
    ]
    df = spark.createDataFrame(rows, "type string, title string, logtype string, logaction string, comment string, tags array<string>, redirect boolean")
    got = [r["action"] for r in changes.classify(df).collect()]
    assert got == ["ENTITY_DELETE", "ENTITY_MERGE", "UNKNOWN", "NON_ENTITY_CHANGE", "ENTITY_REDIRECT", "ENTITY_EDIT", "ENTITY_MERGE", "UNKNOWN", "UNKNOWN"]


def test_stream_equals_batch(spark, tmp_path):
    rows = events(spark, [(20, 0), (21, 20), (21, 20), (20, 0), (22, 21)]).unionByName(events(spark, [(5, 4), (7, 6)], "Q2"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = fence_stream(stream).writeStream.format("memory").queryName("fenced").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = ["entity_id", "rcid", "decision", "indexed"]
    assert sorted(map(tuple, spark.table("fenced").select(*key).collect())) == sorted(map(tuple, changes.fence(rows, 4).select(*key).collect()))


def test_cursor(spark):
    rows = events(spark, [(1, 0), (2, 1), (3, 2)])
    assert [r["rcid"] for r in changes.after_cursor(rows, "2024-01-01 00:00:00", 1).collect()] == [2]
    assert rows.select(F.max("rcid")).first()[0] == 2


def test_fence_commits_and_cursor_order(spark):
    from pyspark.sql import functions as F

    fences = spark.createDataFrame([(e, 5, 8, "GAP_DETECTED") for e in ("a", "b", "c", "d", "e")], "entity_id string, indexed_revision long, latest_seen_revision long, status string")
    results = spark.createDataFrame([("a", 6, None), ("b", 5, None), ("c", 9, None), ("d", 6, "VERIFY_FAILED")], "entity_id string, revision long, code string")
    got = {r["entity_id"]: tuple(r)[1:] for r in changes.fence_commits(fences, results).collect()}
    bad = (5, 8, "GAP_DETECTED", "invalid fence commit")
    assert got == {"a": (6, 8, "HEALTHY", None), "b": bad, "c": bad, "d": (5, 8, "ERROR", "VERIFY_FAILED"), "e": (5, 8, "GAP_DETECTED", None)}
    cursor = lambda s, t, k: F.struct(F.lit(s).alias("source"), F.lit(t).alias("ts"), F.lit(k).alias("rcid"))
    row = spark.range(1).select(*[changes.cursor_order(cursor("s", *x), cursor("s", 1, 5)).alias(f"c{k}") for k, x in enumerate([(1, 4), (1, 5), (1, 6), (0, 9), (2, 0)])]).first()
    assert tuple(row) == (-1, 0, 1, -1, 1)
    try:
        spark.range(1).select(changes.cursor_order(cursor("s", 1, 1), cursor("t", 1, 1))).collect()
        raise AssertionError("cursors of two sources compare")
    except Exception as error:
        assert "cursor source mismatch" in str(error)
