"""A new generation from a snapshot: load, replay what came since, compare, and hand over while changes go on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, Names
from ..sources.generations import Generations
from ..sources.store import save
from . import compare, loader, machine


class Candidate(NamedTuple):
    """A dataset that changes are replayed into: graphs, entities' states, and how far each source is done (source, ts, rcid, status, code)."""

    dataset: DataFrame
    states: DataFrame
    sources: DataFrame


class RebuildFailed(RuntimeError):
    """The message has the code: why a candidate is not promoted."""


def between(events: DataFrame, sources: DataFrame, end: DataFrame | None = None) -> DataFrame:
    """Events after their source's cursor (sources: source, ts, rcid; null or missing is before all), up to its end (the same columns) where one is given."""
    start = sources.select("source", F.col("ts").alias("start_ts"), F.col("rcid").alias("start_rcid"))
    rows = events.join(start, "source", "left").where(machine.place_after(F.col("start_ts"), F.col("start_rcid"))).drop("start_ts", "start_rcid")
    if end is None:
        return rows
    last = end.select("source", F.struct("ts", "rcid").alias("last"))
    return rows.join(last, "source", "left").where(F.col("last").isNull() | (F.struct("ts", "rcid") <= F.col("last"))).drop("last")


def catch_up(candidate: Candidate, events: DataFrame, resolved: DataFrame, contents: DataFrame, end: DataFrame | None = None, names: Names = NAMES) -> Candidate:
    """The candidate after exactly the events after its cursors, up to the end. What overlaps the snapshot is cut by the cursor, so it is not applied twice."""
    spark = events.sparkSession
    new, _ = machine.reachable(between(events, candidate.sources, end))  # what is held changes nothing
    folded = machine.fold(machine.steps(new, resolved), candidate.states, contents, int(spark.conf.get("spark.sql.shuffle.partitions")))
    decided = save(machine.outcomes(save(folded, "folded")), "decided")
    before = candidate.sources.select("source", *[F.col(c).alias(f"old_{c}") for c in ("ts", "rcid", "status", "code")])
    now = machine.source_states(decided).withColumn("seen", F.lit(True)).join(before, "source", "full")
    keep = lambda c: F.coalesce(c, f"old_{c}").alias(c)
    told = lambda c: F.when(F.col("seen"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    sources = now.select("source", keep("ts"), keep("rcid"), told("status"), told("code"))
    return Candidate(save(machine.applied(candidate.dataset, decided, contents, names), "caught_up"), save(machine.entity_states(decided, candidate.states), "states"), save(sources, "sources"))


def behind(candidate: Candidate, heads: DataFrame) -> DataFrame:
    """source, status and code of the sources (heads: source, ts, rcid) that the candidate hasn't caught up with."""
    own = candidate.sources.select("source", F.struct("ts", "rcid").alias("done"), "status", "code")
    rows = heads.join(own, "source", "left")
    caught = F.coalesce(F.col("done") >= F.struct("ts", "rcid"), F.lit(False)) & F.col("done.ts").isNotNull()
    return rows.where(~caught).select("source", "status", "code")


def kinds(dataset: DataFrame, names: Names = NAMES) -> DataFrame:
    """graph, partition_kind, line of a dataset (graph, line), by the names of its graphs."""
    prefix = lambda kind: F.col("graph").startswith(f"{names.graphs}:{kind}:")
    kind = F.when(prefix("entity"), "ENTITY").when(prefix("schema"), "PROPERTY_SCHEMA").otherwise("GLOBAL")
    return dataset.select("graph", kind.alias("partition_kind"), "line")


def promote(store: Generations, name: str, candidate: Candidate, heads: DataFrame, expected_version: int, expected: DataFrame | None = None, names: Names = NAMES) -> dict:
    """Loads a candidate as a generation and serves it, if it has caught up with the heads, equals the expected dataset where one is given, and
    nobody has moved the pointer since. Returns the new pointer."""
    late = behind(candidate, heads).orderBy("source").limit(1).collect()
    if late:
        raise RebuildFailed(f"{late[0]['code'] or 'CANDIDATE_NOT_CURRENT'}: {late[0]['source']}")
    if expected is not None and not compare.by_graph(expected, candidate.dataset).where("not valid").isEmpty():
        raise RebuildFailed("CANONICAL_EQUALITY_FAILED")
    loader.load(store, name, kinds(candidate.dataset, names), names=names)
    return store.promote(name, expected_version)
