"""The paged source of changes: each row once over restarts, pages, namespaces, and the limit of a second."""

import datetime as dt

import pytest

from tessera.operators import changes
from tessera.sources import change_feed

T0 = dt.datetime(2024, 1, 1)


def feed(spark, path, seconds, ns=lambda k: 120):
    rows = [(k + 1, T0 + dt.timedelta(seconds=s), "edit", ns(k), f"Item:Q{k}", k + 1, k, None, None, None, None, None) for k, s in enumerate(seconds)]
    spark.createDataFrame(rows, change_feed.SCHEMA).repartition(3).write.parquet(str(path))
    return rows


def drain(spark, path, out, checkpoint, batches=None, **options):
    spark.dataSource.register(change_feed.ChangeFeed)
    sizes = []

    def keep(batch, number):
        rows = batch.collect()
        if batches is not None and len([s for s in sizes if s]) >= batches and rows:
            raise RuntimeError("cut off")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        sizes.append(len(rows))

    query = spark.readStream.format("change_feed").option("path", str(path)).options(**options).load().writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(keep).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [s for s in sizes if s]


def test_each_change_once_over_restarts(spark, tmp_path):
    seconds = [k // 3 for k in range(20)] + [50] * 25 + [60, 61]
    rows = feed(spark, tmp_path / "feed", seconds, ns=lambda k: 0 if k % 10 == 9 else 122 if k % 2 else 120)
    with pytest.raises(Exception, match="cut off"):
        drain(spark, tmp_path / "feed", tmp_path / "out", tmp_path / "checkpoint", batches=3, pageSize=7)
    sizes = drain(spark, tmp_path / "feed", tmp_path / "out", tmp_path / "checkpoint", pageSize=7)
    assert max(sizes) <= 7
    got = spark.read.parquet(str(tmp_path / "out")).select("rcid", "comment", "tags", "redirect").collect()
    assert sorted(r["rcid"] for r in got) == [r[0] for r in rows if r[3] != 0]
    assert {(r["comment"], tuple(r["tags"]), r["redirect"]) for r in got} == {("", (), False)}
    assert drain(spark, tmp_path / "feed", tmp_path / "out", tmp_path / "checkpoint", pageSize=7) == []


def test_limit_of_a_second(spark, tmp_path):
    feed(spark, tmp_path / "feed", [1] * 45 + [2])
    with pytest.raises(Exception, match="SAME_SECOND_SCAN_LIMIT"):
        drain(spark, tmp_path / "feed", tmp_path / "out", tmp_path / "checkpoint", pageSize=4)
    assert sum(drain(spark, tmp_path / "feed", tmp_path / "out2", tmp_path / "checkpoint2", pageSize=5)) == 46
    for bad in ("0", "101"):
        with pytest.raises(Exception, match="invalid limit"):
            drain(spark, tmp_path / "feed", tmp_path / "out3", tmp_path / f"checkpoint{bad}", pageSize=bad)


def test_poll_pages_are_the_pages_of_the_source(spark):
    seconds = [k // 3 for k in range(20)] + [50] * 25 + [60, 61] + [70] * 60 + [80]
    rows = [{"ts": T0 + dt.timedelta(seconds=s), "rcid": k} for k, s in enumerate(seconds)]
    cursor, want, poll = None, {}, 0
    try:
        while page := change_feed.next_page([r for r in rows if cursor is None or r["ts"] >= cursor[0]][:51], cursor, 5):
            want |= {r["rcid"]: poll for r in page}
            cursor, poll = (page[-1]["ts"], page[-1]["rcid"]), poll + 1
    except ValueError as error:
        assert str(error) == change_feed.SCAN_LIMIT
    frame = spark.createDataFrame([("s", r["ts"], r["rcid"]) for r in rows], "source string, ts timestamp_ntz, rcid long")
    got = changes.poll_pages(frame, 5, 3).collect()
    assert {r["rcid"]: r["poll"] for r in got if r["error"] is None} == want and 0 < len(want) < len(rows)
