"""The state machine of a source: all classes of changes folded per entity, and the first event that stops the source.

Events of an entity are folded in cursor order, a task at a time over sorted rows, with one state held. A source stops at its first
event that is ambiguous, leaves a gap, restores what has no tombstone, or whose text is missing or not verified. Folds of entities don't depend on
each other before that event, so they run side by side, and what comes after the stop is cut off: it counts as HELD and changes nothing.
An event that is ambiguous by itself stops its source whatever the states are, so what comes after it needn't be folded (`reachable`).
An event that touches several entities has a step for each; the steps before the one that stops hold, as its event is tried again from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, Names
from ..sources.store import save
from .changes import observe
from .lifecycle import LOOKED_UP, RESTORABLE
from .sync import VERSION, replaced

STATE = "entity_id string, indexed_revision long, latest_seen_revision long, status string"
# Error codes of a stop, and the states of a source and of an entity.
AMBIGUOUS_EVENT, AMBIGUOUS_LIFECYCLE, REVISION_GAP, NO_TOMBSTONE = "AMBIGUOUS_EVENT", "AMBIGUOUS_LIFECYCLE", "REVISION_GAP", "UNDELETE_WITHOUT_TOMBSTONE"
NO_TEXT, NO_SCHEMA, NOT_VERIFIED = "ENTITY_MISSING", "PROPERTY_SCHEMA_PARTITION_MISSING", "BACKEND_VERIFY_FAILED"
HEALTHY, STOPPED_SOURCE, FIRST_STATUS = "HEALTHY", "REBUILD_REQUIRED", "PENDING"

PLACE = ("ts", "rcid", "part")


def ambiguous() -> Column:
    """Whether an event stops its source before any lookup or state."""
    return (F.col("action") == "UNKNOWN") | (F.col("entity_id").isNull() & (F.col("action") != "NON_ENTITY_CHANGE"))


def reachable(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events up to each source's first ambiguous one, that one included, and those after it, which are HELD whatever the others come to."""
    place = F.struct("ts", "rcid")
    bounds = save(classified.where(ambiguous()).groupBy("source").agg(F.min(place).alias("bound")), "bounds")
    rows = classified.join(bounds, "source", "left")
    past = F.coalesce(place > F.col("bound"), F.lit(False))
    return rows.where(~past).drop("bound"), rows.where(past).drop("bound")


def steps(classified: DataFrame, resolved: DataFrame) -> DataFrame:
    """classified (source, ts, rcid, action, entity_id, revid, old_revid) -> a row for each entity that an event touches, with part and code.

    resolved (source, rcid, unambiguous, entities): what lifecycle events come to, as `lifecycle.resolve` has it. The steps of such an event take
    the entities' present revisions, and follow whatever is indexed (old_revid is null). code: why the event stops its source before it is looked at.
    """
    looked_up = F.coalesce(F.col("action").isin(LOOKED_UP), F.lit(False))
    found = resolved.select("source", "rcid", "unambiguous", "entities")
    rows = classified.where(looked_up).join(found, ["source", "rcid"], "left").unionByName(classified.where(~looked_up), allowMissingColumns=True)
    clear = F.coalesce(F.col("unambiguous"), F.lit(False)) & (F.coalesce(F.size("entities"), F.lit(0)) > 0)
    code = F.when(ambiguous(), AMBIGUOUS_EVENT).when(looked_up & ~clear, AMBIGUOUS_LIFECYCLE)
    named = F.transform("entities", lambda e: F.struct(e["id"].alias("entity_id"), e["revision"].cast("long").alias("revid"), F.lit(None).cast("long").alias("old_revid")))
    own = F.array(F.struct("entity_id", F.col("revid").cast("long").alias("revid"), F.col("old_revid").cast("long").alias("old_revid")))
    rows = rows.withColumn("code", code)
    rows = rows.select("source", "ts", "rcid", "action", "code", F.posexplode(F.when(looked_up & F.col("code").isNull(), named).otherwise(own)).alias("part", "x"))
    return rows.select("source", "ts", "rcid", "part", "action", "code", "x.*")


def faults(contents: DataFrame) -> DataFrame:
    """contents (entity_id, revid, kind, line) -> entity_id, revid, fault: null where the text can be published and verified.

    kind is entity, or schema for the second graph of a property. Verified is a text that gives the entity, a subject that ends in its id, the version.
    """
    parts = F.split("line", " ", 4)
    version = F.get(parts, F.lit(2)).startswith(F.concat(F.lit('"'), F.col("revid").cast("string"), F.lit('"')))
    says = (F.get(parts, F.lit(1)) == VERSION) & F.get(parts, F.lit(0)).endswith(F.concat(F.lit("/"), "entity_id", F.lit(">"))) & version
    own = F.col("kind") == "entity"
    per = contents.groupBy("entity_id", "revid").agg(F.bool_or(own).alias("own"), F.bool_or(F.col("kind") == "schema").alias("schema"), F.coalesce(F.bool_or(own & says), F.lit(False)).alias("sound"))
    fault = F.when(~F.col("own"), NO_TEXT).when(F.col("entity_id").startswith("P") & ~F.col("schema"), NO_SCHEMA).when(~F.col("sound"), NOT_VERIFIED)
    return per.select("entity_id", "revid", fault.alias("fault"))


def advance(state: tuple[int, int, str], action: str, revid: int, old_revid: int | None, code: str | None, fault: str | None) -> tuple[str, str | None, tuple[int, int, str]]:
    """Outcome of one step, its error, and the state after it: indexed revision, latest seen revision, status."""
    indexed, latest, status = state
    if code:
        return "STOPPED", code, state
    if action == "ENTITY_DELETE":
        return "DELETED", None, (indexed, latest, "DELETED")
    restores = action == "ENTITY_UNDELETE"
    if restores and status not in RESTORABLE:
        return "STOPPED", NO_TOMBSTONE, state
    if not restores:
        decision, _ = observe(indexed, revid, indexed if old_revid is None else old_revid)
        if decision == "GAP_DETECTED":
            return "STOPPED", REVISION_GAP, (indexed, revid, "GAP")
        if decision != "APPLY":
            return decision, None, state
    if fault:
        return "STOPPED", fault, (indexed, latest, "RESTORING") if restores else state
    return ("RESTORED" if restores else "APPLIED"), None, (revid, max(latest, revid), "CURRENT")


def fold(rows: DataFrame, state: DataFrame, contents: DataFrame, width: int) -> DataFrame:
    """Steps -> the same with outcome, error, indexed, latest and status, as if no source stopped. state: the columns of STATE, for entities that have one."""
    rows = save(rows, "steps")
    sound = faults(contents.join(rows.select("entity_id", "revid"), ["entity_id", "revid"], "left_semi"))
    own = rows.where("entity_id is not null and action <> 'NON_ENTITY_CHANGE'").join(sound.withColumn("there", F.lit(True)), ["entity_id", "revid"], "left")
    own = own.withColumn("fault", F.when(F.col("there").isNull(), NO_TEXT).otherwise(F.col("fault")))
    own = own.join(state.select("entity_id", *[F.col(c).alias(f"first_{c}") for c in ("indexed_revision", "latest_seen_revision", "status")]), "entity_id", "left")
    own = own.fillna({"first_indexed_revision": 0, "first_latest_seen_revision": 0, "first_status": FIRST_STATUS})

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, now = None, (0, 0, FIRST_STATUS)
        for pdf in frames:
            out = []
            none = lambda column: pdf[column].astype(object).where(pdf[column].notna(), None)
            columns = [pdf["entity_id"], pdf["action"], none("revid"), none("old_revid"), none("code"), none("fault")]
            firsts = zip(pdf["first_indexed_revision"], pdf["first_latest_seen_revision"], pdf["first_status"])
            for e, action, revid, old, code, fault, first in zip(*columns, firsts):
                if e != entity:
                    entity, now = e, (int(first[0]), int(first[1]), first[2])
                outcome, error, now = advance(now, action, int(revid or 0), None if old is None else int(old), code, fault)
                out.append((outcome, error, *now))
            made = pd.DataFrame(out, columns=["outcome", "error", "indexed", "latest", "status"], index=pdf.index)
            yield pd.concat([pdf[["source", "ts", "rcid", "part", "action", "entity_id", "revid"]], made], axis=1)

    own = own.repartition(width, "entity_id").sortWithinPartitions("entity_id", *PLACE)
    own = own.mapInPandas(folded, "source string, ts timestamp_ntz, rcid long, part int, action string, entity_id string, revid long, outcome string, error string, indexed long, latest long, status string")
    rest = rows.where("entity_id is null or action = 'NON_ENTITY_CHANGE'").select(
        "source", "ts", "rcid", "part", "action", "entity_id", "revid", F.when(F.col("code").isNull(), "SKIPPED").otherwise("STOPPED").alias("outcome"), F.col("code").alias("error"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("indexed", "long"), ("latest", "long"), ("status", "string"))],
    )
    return own.unionByName(rest)


def stops(folded: DataFrame) -> DataFrame:
    """source, stop (ts, rcid, part) and code of the first step that stops each source."""
    place = F.struct(*PLACE)
    return folded.where("outcome = 'STOPPED'").groupBy("source").agg(F.min(place).alias("stop"), F.min_by("error", place).alias("code"))


def outcomes(folded: DataFrame) -> DataFrame:
    """What each step comes to: after the step that stops its source, HELD, with nothing changed. folded: a saved table, as it is read twice."""
    rows = folded.join(save(stops(folded).select("source", "stop"), "stops"), "source", "left")
    held = F.coalesce(F.struct(*PLACE) > F.col("stop"), F.lit(False))
    unless = lambda c: F.when(~held, F.col(c)).alias(c)
    return rows.select("source", "ts", "rcid", "part", "action", "entity_id", "revid", F.when(held, "HELD").otherwise(F.col("outcome")).alias("outcome"), *map(unless, ("error", "indexed", "latest", "status")))


def held(rows: DataFrame) -> DataFrame:
    """Steps of events that can't be reached, as `outcomes` has them."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("error", "string"), ("indexed", "long"), ("latest", "long"), ("status", "string"))]
    return rows.select("source", "ts", "rcid", "part", "action", "entity_id", "revid", F.lit("HELD").alias("outcome"), *none)


def entity_states(decided: DataFrame, state: DataFrame) -> DataFrame:
    """The columns of STATE after all steps that took place; an entity without any keeps its state."""
    last = decided.where("outcome <> 'HELD' and indexed is not null").groupBy("entity_id")
    last = last.agg(F.max_by(F.struct("indexed", "latest", "status"), F.struct(*PLACE)).alias("now"), F.lit(True).alias("moved"))
    rows = state.join(last, "entity_id", "full")
    now = lambda c, old: F.when(F.col("moved"), F.col(f"now.{c}")).otherwise(F.col(old)).alias(old)
    return rows.select("entity_id", now("indexed", "indexed_revision"), now("latest", "latest_seen_revision"), now("status", "status"))


def source_states(decided: DataFrame) -> DataFrame:
    """source, ts and rcid of the last event that is done (null before any), status, and the code of what stopped it."""
    stopped = F.col("outcome").isin("STOPPED", "HELD")
    event = decided.groupBy("source", "ts", "rcid").agg(F.bool_or(stopped).alias("open"), F.max("error").alias("code"))
    per = event.groupBy("source").agg(F.max(F.when(~F.col("open"), F.struct("ts", "rcid"))).alias("done"), F.max("code").alias("code"))
    return per.select("source", "done.ts", "done.rcid", F.when(F.col("code").isNull(), HEALTHY).otherwise(STOPPED_SOURCE).alias("status"), "code")


def written(decided: DataFrame) -> DataFrame:
    """entity_id, revid of the last text that steps publish for an entity; revid is null where the entity is deleted last."""
    moved = decided.where(F.col("outcome").isin("APPLIED", "RESTORED", "DELETED"))
    last = moved.groupBy("entity_id").agg(F.max_by(F.struct("outcome", "revid"), F.struct(*PLACE)).alias("x"))
    return last.select("entity_id", F.when(F.col("x.outcome") != "DELETED", F.col("x.revid")).alias("revid"))


def graphs(last: DataFrame, contents: DataFrame, names: Names = NAMES) -> DataFrame:
    """What `written` comes to: (graph, line), with a null line for each graph that a delete empties."""
    graph = lambda kind: names.graph(kind, F.col("entity_id"))
    texts = last.where("revid is not null").join(contents, ["entity_id", "revid"])
    texts = texts.where((F.col("kind") == "entity") | F.col("entity_id").startswith("P")).select(F.when(F.col("kind") == "entity", graph("entity")).otherwise(graph("schema")).alias("graph"), "line")
    gone = last.where("revid is null")
    gone = gone.select(graph("entity").alias("graph")).unionByName(gone.where(F.col("entity_id").startswith("P")).select(graph("schema").alias("graph")))
    return texts.unionByName(gone.withColumn("line", F.lit(None).cast("string")))


def applied(dataset: DataFrame, decided: DataFrame, contents: DataFrame, names: Names = NAMES) -> DataFrame:
    """dataset (graph, line) after all steps that took place. A graph changes only by a text that is there and verified, or by a delete."""
    last = save(written(decided), "written")
    return replaced(dataset, save(graphs(last, contents, names), "staged"))


def checksums(states: DataFrame, contents: DataFrame) -> DataFrame:
    """states with checksum: the SHA-256 of the sorted lines of the entity's text, null where it is deleted or has none. A text has a bounded size."""
    text = contents.where("kind = 'entity'").groupBy("entity_id", F.col("revid").alias("indexed_revision")).agg(F.sort_array(F.collect_set("line")).alias("lines"))
    joined = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
    return states.join(text, ["entity_id", "indexed_revision"], "left").withColumn("checksum", F.when(F.col("status") != "DELETED", F.sha2(joined, 256))).drop("lines")


def place_after(ts: Column, rcid: Column) -> Column:
    """Whether an event comes after the cursor (ts, rcid); a null cursor is before all."""
    return ts.isNull() | (F.struct(F.col("ts"), F.col("rcid")) > F.struct(ts.alias("ts"), rcid.alias("rcid")))
