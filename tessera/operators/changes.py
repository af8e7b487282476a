"""Change events: cursor order, classes, revision fences, and the state they leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after_cursor(events: DataFrame, ts: str, rcid: int) -> DataFrame:
    """Events after the cursor: a later second, or the same one and a larger rcid."""
    return events.where(F.struct("ts", "rcid") > F.struct(F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit(rcid).cast("long").alias("rcid")))


def cursor_order(left: Column, right: Column) -> Column:
    """-1, 0 or 1 as the left cursor (source, ts, rcid) comes before, with or after the right one; cursors of two sources fail the job."""
    place = lambda c: F.struct(c["ts"].alias("ts"), c["rcid"].alias("rcid"))
    order = F.when(place(left) < place(right), -1).when(place(left) > place(right), 1).otherwise(0)
    return F.when(left["source"].eqNullSafe(right["source"]), order).otherwise(F.raise_error(F.lit("cursor source mismatch")).cast("int"))


def entity_id(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"^(?:Item|Property):([QP][1-9][0-9]*)$", 1), F.lit(""))


def action() -> Column:
    """The class of a change; the first rule that holds decides."""
    entity = entity_id(F.col("title")).isNotNull()
    log = lambda kind, act: (F.col("logtype") == kind) & (F.col("logaction") == act)
    on_log = (
        F.when(log("delete", "delete"), "ENTITY_DELETE").when(log("delete", "restore"), "ENTITY_UNDELETE").when(log("merge", "merge"), "ENTITY_MERGE")
        .when(entity, "UNKNOWN").otherwise("NON_ENTITY_CHANGE")
    )
    return (
        F.when(F.col("type") == "log", on_log)
        .when(~entity, "NON_ENTITY_CHANGE")
        .when(~F.col("type").isin("edit", "new"), "UNKNOWN")
        .when(F.array_contains("tags", "mw-removed-redirect"), "ENTITY_REDIRECT_REMOVED")
        .when(F.array_contains("tags", "mw-new-redirect") | F.col("comment").startswith("/* wbcreateredirect:"), "ENTITY_REDIRECT")
        .when(F.col("comment").startswith("/* wbmergeitems-"), "ENTITY_MERGE")
        .when(F.col("redirect"), "UNKNOWN")
        .otherwise("ENTITY_EDIT")
    )


def classify(events: DataFrame) -> DataFrame:
    events = events.withColumn("entity_id", entity_id(F.col("title"))).withColumn("action", action())
    return events.withColumn("authoritative", ~F.col("action").isin("UNKNOWN", "NON_ENTITY_CHANGE"))


def observe(indexed: int, revid: int, old_revid: int) -> tuple[str, int]:
    """What the fence decides on one revision, and the indexed revision after it."""
    if revid <= indexed:
        return ("DUPLICATE" if revid == indexed else "OLDER"), indexed
    if indexed and old_revid != indexed:
        return "GAP_DETECTED", indexed
    return "APPLY", revid


def fence(events: DataFrame, width: int) -> DataFrame:
    """events (entity_id, ts, rcid, revid, old_revid) -> the same rows with decision and indexed, folded per entity in cursor order.

    Rows are dealt by entity and sorted; the fold streams over them and holds one revision, however many events an entity has.
    """

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, indexed = None, 0
        for pdf in frames:
            decisions, revisions = [], []
            for e, rev, old in zip(pdf["entity_id"], pdf["revid"], pdf["old_revid"]):
                if e != entity:
                    entity, indexed = e, 0
                decision, indexed = observe(indexed, rev, old)
                decisions.append(decision)
                revisions.append(indexed)
            yield pdf.assign(decision=decisions, indexed=revisions)

    rows = events.select("entity_id", "ts", "rcid", "revid", "old_revid").where("entity_id is not null")
    rows = rows.repartition(width, "entity_id").sortWithinPartitions("entity_id", "ts", "rcid")
    return rows.mapInPandas(folded, "entity_id string, ts timestamp_ntz, rcid long, revid long, old_revid long, decision string, indexed long")


def entity_state(decided: DataFrame) -> DataFrame:
    """entity_id, indexed_revision, latest_seen_revision, status after all decisions.

    Duplicates and older revisions change nothing: GAP holds until a revision is applied, and the latest revision seen is that of the
    gap, or else the largest applied.
    """
    moved = F.col("decision").isin("APPLY", "GAP_DETECTED")
    last = F.max_by(F.when(moved, F.struct("decision", "revid")), F.when(moved, F.struct("ts", "rcid")))
    gap = F.col("last.decision") == "GAP_DETECTED"
    per = decided.groupBy("entity_id").agg(F.max("indexed").alias("indexed_revision"), last.alias("last"))
    return per.select("entity_id", "indexed_revision", F.when(gap, F.col("last.revid")).otherwise(F.col("indexed_revision")).alias("latest_seen_revision"), F.when(gap, "GAP").otherwise("CURRENT").alias("status"))


def fence_commits(fences: DataFrame, results: DataFrame) -> DataFrame:
    """fences (entity_id, indexed_revision, latest_seen_revision, status) after results (entity_id, revision, code; one a fence), with error.

    A result without a code commits its revision, which must be above what is indexed and seen already, or the fence stays and error tells so. One
    with a code fails the fence: its status is ERROR, and what is indexed stays.
    """
    rows = fences.join(results.select("entity_id", "revision", "code", F.lit(True).alias("told")), "entity_id", "left")
    failed = F.col("told") & F.col("code").isNotNull()
    commits = F.col("told") & F.col("code").isNull()
    sound = F.coalesce((F.col("revision") > F.col("indexed_revision")) & (F.col("revision") <= F.col("latest_seen_revision")), F.lit(False))
    return rows.select(
        "entity_id", F.when(commits & sound, F.col("revision")).otherwise(F.col("indexed_revision")).alias("indexed_revision"), "latest_seen_revision",
        F.when(failed, "ERROR").when(commits & sound, "HEALTHY").otherwise(F.col("status")).alias("status"), F.when(failed, F.col("code")).when(commits & ~sound, "invalid fence commit").alias("error"),
    )


def before_stop(decided: DataFrame) -> DataFrame:
    """Decisions strictly before the first gap of any entity, where the source stops."""
    stop = decided.where("decision = 'GAP_DETECTED'").agg(F.min(F.struct("ts", "rcid")).alias("stop")).first()["stop"]  # one row
    return decided if stop is None else decided.where(F.struct("ts", "rcid") < F.struct(F.lit(stop["ts"]).alias("ts"), F.lit(stop["rcid"]).alias("rcid")))


def poll_pages(events: DataFrame, limit: int, width: int, most_pages: int = 10) -> DataFrame:
    """events (source, ts, rcid) -> the same with poll (from 0) and error: how polls of pages of `limit` rows deliver each source's changes.

    A poll starts at the first row of its cursor's second and takes the first page with something new; error tells that this page is beyond
    `most_pages`, where the source ends. Rows are dealt by source and sorted; the fold holds a few numbers.
    """

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, second, inside, poll, left, failed = None, None, 0, 0, limit, False
        for pdf in frames:
            polls, errors = [], []
            for s, ts in zip(pdf["source"], pdf["ts"]):
                if s != source:
                    source, second, inside, poll, left, failed = s, None, 0, 0, limit, False
                if not left:  # `inside` rows of the last second are at or before the cursor
                    page = inside // limit
                    failed = failed or page >= most_pages
                    poll, left = poll + 1, limit * (page + 1) - inside
                second, inside = ts, inside + 1 if ts == second else 1
                left -= 1
                polls.append(poll)
                errors.append("RECENT_CHANGES_SAME_SECOND_SCAN_LIMIT" if failed else None)
            yield pdf.assign(poll=polls, error=errors)

    rows = events.select("source", "ts", "rcid").repartition(width, "source").sortWithinPartitions("source", "ts", "rcid")
    return rows.mapInPandas(folded, "source string, ts timestamp_ntz, rcid long, poll int, error string")
