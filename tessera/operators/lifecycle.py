"""Deletes, undeletes, redirects and merges of entities: what an event resolves to, and the state and graphs that are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, Names

#: Classes of changes that are looked up, and states that an undelete may start from.
LOOKED_UP = ["ENTITY_UNDELETE", "ENTITY_REDIRECT", "ENTITY_REDIRECT_REMOVED", "ENTITY_MERGE"]
RESTORABLE = ["DELETED", "RESTORING", "CURRENT"]


def mentioned() -> Column:
    """The entity of a change, and for a merge also the ids in its comment, each once."""
    own = F.array("entity_id")
    named = F.regexp_extract_all(F.coalesce("comment", F.lit("")), F.lit("([QP][1-9][0-9]*)"), 1)
    return F.when(F.col("action") == "ENTITY_MERGE", F.array_distinct(F.concat(own, named))).otherwise(own)


def resolve(classified: DataFrame, current: DataFrame) -> DataFrame:
    """classified (rcid, action, entity_id, comment), current (id, canonical, revision) -> rcid, unambiguous, entities.

    entities has (id, canonical, revision, redirect) of each id, in the order of ids. An event is ambiguous, and its list empty,
    if a merge doesn't name exactly two ids or the current state of one has no revision. current has a row for each id.
    """
    asked = classified.where(F.col("action").isin(LOOKED_UP)).select("rcid", "action", mentioned().alias("ids"))
    fits = (F.col("action") != "ENTITY_MERGE") | (F.size("ids") == 2)
    found = asked.select("rcid", fits.alias("fits"), F.explode("ids").alias("id")).join(current, "id", "left")
    entity = F.struct("id", "canonical", "revision", (F.col("id") != F.col("canonical")).alias("redirect"))
    per = found.groupBy("rcid").agg(
        (F.bool_and("fits") & F.bool_and(F.col("revision").isNotNull())).alias("unambiguous"),
        F.sort_array(F.collect_list(F.when(F.col("fits") & F.col("revision").isNotNull(), entity))).alias("entities"),  # an event names a few ids
    )
    return per.withColumn("entities", F.when(F.col("unambiguous"), F.col("entities")).otherwise(F.slice("entities", 1, 0)))


def after_lifecycle(state: DataFrame, classified: DataFrame) -> DataFrame:
    """state (entity_id, indexed_revision, status, checksum) and changes in cursor order -> the state with tombstones.

    The last delete or undelete decides. A tombstone keeps its indexed revision and has no checksum; an undelete of a state
    that can't be restored gives the error UNDELETE_WITHOUT_TOMBSTONE, unless a delete came before it.
    """
    moves = classified.where(F.col("action").isin("ENTITY_DELETE", "ENTITY_UNDELETE")).groupBy("entity_id")
    moves = moves.agg(F.max_by("action", F.struct("ts", "rcid")).alias("last"), F.bool_or(F.col("action") == "ENTITY_DELETE").alias("deleted"))
    rows = state.join(moves, "entity_id", "left")
    dead = F.coalesce(F.col("last") == "ENTITY_DELETE", F.lit(False))
    revived = F.coalesce(F.col("last") == "ENTITY_UNDELETE", F.lit(False))
    may = F.col("deleted") | F.col("status").isin(RESTORABLE)
    return rows.select(
        "entity_id",
        "indexed_revision",
        F.when(dead, "DELETED").when(revived & may, "CURRENT").otherwise(F.col("status")).alias("status"),
        F.when(~dead, F.col("checksum")).alias("checksum"),
        F.when(revived & ~may, "UNDELETE_WITHOUT_TOMBSTONE").alias("error"),
    )


def without_deleted(quads: DataFrame, deleted: DataFrame, names: Names = NAMES) -> DataFrame:
    """quads (graph, ...) less the entity graphs of deleted (entity_id), and the schema graphs of deleted properties."""
    graph = lambda kind: names.graph(kind, F.col("entity_id")).alias("graph")
    gone = deleted.select(graph("entity")).unionByName(deleted.where(F.col("entity_id").startswith("P")).select(graph("schema")))
    return quads.join(gone, "graph", "left_anti")
