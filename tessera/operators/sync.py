"""Cursors, exact revisions, and changes applied to graphs: replace, delete, verify, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import NAMES, Names

# What a source's state is called for a generation; states that go to HEALTHY when a source is idle.
SOURCE_STATES = {
    "BOOTSTRAPPING": "BOOTSTRAPPING", "HEALTHY": "CURRENT", "CATCHING_UP": "CATCHING_UP", "STALE": "STALE", "GAP_DETECTED": "GAP_DETECTED",
    "REBUILD_REQUIRED": "STALE", "REBUILDING": "CATCHING_UP", "ERROR": "ERROR",
}
IDLE_FROM = ["BOOTSTRAPPING", "CATCHING_UP", "STALE"]
VERSION = "<http://schema.org/version>"
MAX_ENTITY_BYTES = 2_000_000
# Fixed value: an entity graph without exactly one revision.
AMBIGUOUS_REVISION = "SNAPSHOT_ENTITY_REVISION_AMBIGUOUS"


def cursor_fault(source: Column, ts: Column, rcid: Column) -> Column:
    """Why a cursor is none, or null: source name, rcid of 0 or more, a whole second of UTC that exists."""
    # The three messages and the forms of a source's name and of a second.
    sound = lambda c: F.coalesce(c, F.lit(False))
    whole = ts.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & F.try_to_timestamp(ts).isNotNull()
    return (
        F.when(~sound(source.rlike(r"^[a-z0-9][a-z0-9.-]{0,127}$")), "invalid source identity").when(~sound(rcid >= 0), "invalid rcid").when(~sound(whole), "invalid cursor timestamp")
    )


def committed(cursors: DataFrame, order: str) -> DataFrame:
    """cursors (source, ts, rcid, and the order in which they are committed) -> the same with error.

    A cursor that isn't after all that its source committed before is a regression, and is not committed.
    """
    before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.struct("ts", "rcid")
    return cursors.withColumn("error", F.when(cursor <= F.max(cursor).over(before), "CURSOR_REGRESSION"))


def head(cursors: DataFrame) -> DataFrame:
    """source and the cursor (ts, rcid) that its reader has come to."""
    return cursors.groupBy("source").agg(F.max(F.struct("ts", "rcid")).alias("c")).select("source", "c.ts", "c.rcid")


def normal_event(events: DataFrame) -> DataFrame:
    """The defaults of fields that an event may lack: an empty comment, no tags, no redirect."""
    return events.withColumns(
        {"comment": F.coalesce("comment", F.lit("")), "tags": F.coalesce("tags", F.array().cast("array<string>")), "redirect": F.coalesce("redirect", F.lit(False))}
    )


def error_code(message: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(message, "([A-Z][A-Z0-9_]{2,63})", 1), F.lit("")), F.lit("SYNC_FAILED"))


def generation_state(source_state: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SOURCE_STATES.items() for x in pair])[source_state]


def idle_state(state: Column, schema_state: Column, seen: Column) -> Column:
    return F.when((seen == 0) & (schema_state == "CURRENT") & state.isin(IDLE_FROM), "HEALTHY").otherwise(state)


def exact_revision(wanted: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (entity_id, revision) -> the same with fault, null where the text of just that revision is sound.

    pages: entity_id, title, last_revision. texts: entity_id, revision, rdf. A page counts only under the title of its kind, Item or Property.
    """
    rows = wanted.join(pages, "entity_id", "left").join(texts, ["entity_id", "revision"], "left")
    sound = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(F.col("entity_id").startswith("Q"), "Item:").otherwise("Property:")
    iri = F.contains("rdf", F.concat(F.lit("/entity/"), "entity_id", F.lit(">")))
    version = F.contains("rdf", F.concat(F.lit(f'{VERSION} "'), F.col("revision").cast("string"), F.lit('"')))
    # The error codes of a fetch.
    fault = (
        F.when(~sound(F.col("entity_id").rlike("^[QP][1-9][0-9]*$") & (F.col("revision") >= 1)), "invalid entity fetch input")
        .when(~sound((F.col("title") == F.concat(kind, "entity_id")) & (F.col("last_revision") >= F.col("revision"))), "REVISION_MISMATCH")
        .when(F.col("rdf").isNull(), "ENTITY_MISSING").when(F.octet_length("rdf") > MAX_ENTITY_BYTES, "ENTITY_RDF_TOO_LARGE").when(~(iri & version), "REVISION_EVIDENCE_MISSING")
    )
    return rows.select("entity_id", "revision", fault.alias("fault"))


def checked_revision(dataset: DataFrame) -> DataFrame:
    """graph, revision, error of each entity graph of a dataset (graph, partition_kind, line).

    A graph's revision is the one version of 1 or more that the entity or its document is said to have; none, or several, is an error.
    """
    parts = F.split("line", " ", 4)
    s, p, o = (F.get(parts, F.lit(k)) for k in range(3))
    entity = F.substring_index("graph", ":", -1)
    own = s.endswith(F.concat(F.lit("/entity/"), entity, F.lit(">"))) | s.endswith(F.concat(F.lit("/wiki/Special:EntityData/"), entity, F.lit(">")))
    number = F.when((p == VERSION) & own, F.regexp_extract(o, r'^"([0-9]+)"', 1).try_cast("long"))
    per = dataset.where("partition_kind = 'ENTITY'").groupBy("graph").agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    sound = F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") >= 1), F.lit(False))
    return per.select("graph", F.when(sound, F.col("lo")).alias("revision"), F.when(~sound, AMBIGUOUS_REVISION).alias("error"))


def replaced(dataset: DataFrame, graphs: DataFrame) -> DataFrame:
    """dataset (graph, line), with each graph that is in graphs (graph, line) replaced by what that has. A null line empties its graph."""
    stays = dataset.join(graphs.select("graph").distinct(), "graph", "left_anti")
    return stays.select("graph", "line").unionByName(graphs.where("line is not null").select("graph", "line").distinct())


def reset(dataset: DataFrame, instance: str, token: str) -> DataFrame:
    """The dataset without rows, for who has the token."""
    if token != f"reset:{instance}":
        raise ValueError("a reset needs the token of its instance")
    return dataset.where("false")


def unverified(dataset: DataFrame, applied: DataFrame, names: Names = NAMES) -> DataFrame:
    """applied (entity_id, revision) whose graph has no version triple of that revision."""
    parts = F.split("line", " ", 4)
    own = dataset.where(F.contains("line", F.lit(VERSION))).select(
        "graph", F.regexp_extract(F.get(parts, F.lit(0)), "/([QP][1-9][0-9]*)>$", 1).alias("entity_id"), F.regexp_extract(F.get(parts, F.lit(2)), r'^"([0-9]+)"', 1).try_cast("long").alias("revision")
    )
    wanted = applied.withColumn("graph", names.graph("entity", F.col("entity_id")))
    return wanted.join(own, ["graph", "entity_id", "revision"], "left_anti").select("entity_id", "revision")


def replay(dataset: DataFrame, decided: DataFrame, contents: DataFrame, names: Names = NAMES) -> DataFrame:
    """dataset after all changes that the fence let through: of each entity the graph of its last applied revision.

    decided: entity_id, revid, decision. contents: entity_id, revid, line. Earlier revisions needn't be written, as each replaces the graph.
    A graph whose text is missing stays as it is and is told by `without_text`; `machine.applied` also verifies, and stops sources.
    """
    graphs = last_applied(decided).join(contents, ["entity_id", "revid"]).select(names.graph("entity", F.col("entity_id")).alias("graph"), "line")
    return replaced(dataset, graphs)


def last_applied(decided: DataFrame) -> DataFrame:
    return decided.where("decision = 'APPLY'").groupBy("entity_id").agg(F.max("revid").alias("revid"))


def without_text(decided: DataFrame, contents: DataFrame) -> DataFrame:
    """entity_id, revid of the revisions that a replay should write but for which there is no text."""
    return last_applied(decided).join(contents, ["entity_id", "revid"], "left_anti")
