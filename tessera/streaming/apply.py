"""Verified apply: each micro-batch stages the graphs that its events replace, verifies them, and only then moves fence and cursor.

A commit is one small file, written last; whatever a batch writes before it stays unseen, so a batch that is cut off at any phase leaves graphs, fence and
cursor as they were, and runs again. An event that stops its source (see `operators.machine`) commits all that came before it and the source's status, and
then fails the query, so the stream stays at that batch: started again, it skips what is done and tries the event anew.

Tables under root hold what each commit changed, by its number; every `COMPACT` commits they are written whole, and older numbers are no longer read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import NAMES, Names
from ..operators import machine, sync
from ..sources.store import save

COMPACT = 16
PHASES = ("AFTER_RC_FETCH", "AFTER_RDF_FETCH", "BEFORE_BACKEND_UPDATE", "AFTER_BACKEND_UPDATE", "BEFORE_FENCE_COMMIT", "AFTER_FENCE_BEFORE_CURSOR")
#: Tables of a root: their columns, and what makes rows of a later commit replace those of an earlier one.
TABLES = {
    "graphs": ("graph string, line string", "graph"),
    "states": (machine.STATE + ", checksum string, error string", "entity_id"),
    "sources": ("source string, ts timestamp_ntz, rcid long, status string, code string", "source"),
}
RESOLVED = "source string, rcid long, unambiguous boolean, entities array<struct<id: string, canonical: string, revision: bigint, redirect: boolean>>"


class SourceStopped(RuntimeError):
    """A source can't go past an event; the message names it and the code."""


class Root:
    """The tables of a stream's target folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def last(self) -> tuple[int, int]:
        """Number of the last commit, and from which number on tables are read; (0, 0) before any."""
        if not self._there("commits"):
            return 0, 0
        rows = self.spark.read.schema("base long, number long").parquet(f"{self.path}/commits")
        found = rows.agg(F.max(F.struct("number", "base")).alias("x")).first()["x"]
        return (found["number"], found["base"]) if found else (0, 0)

    def read(self, name: str) -> DataFrame:
        """The rows of a table as the last commit left them."""
        columns, key = TABLES[name]
        number, base = self.last()
        if not number or not self._there(name):
            return self.spark.createDataFrame([], columns)
        rows = self.spark.read.schema(columns + ", number long").parquet(f"{self.path}/{name}").where(F.col("number").between(base, number))
        newest = rows.groupBy(key).agg(F.max("number").alias("number"))
        return rows.join(newest, [key, "number"], "left_semi").drop("number")

    def write(self, name: str, changed: DataFrame, number: int, whole: bool) -> None:
        if whole:
            key = TABLES[name][1]
            changed = self.read(name).join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{self.path}/{name}/number={number}")

    def seed(self, states: DataFrame, sources: DataFrame) -> None:
        """The first commit of a new root: where a candidate generation has come to, so that a stream goes on from there."""
        if self.last()[0]:
            raise ValueError(f"{self.path} has commits")
        none = lambda c: F.lit(None).cast("string").alias(c)
        self.write("graphs", self.read("graphs"), 1, False)
        self.write("states", states.select("entity_id", "indexed_revision", "latest_seen_revision", "status", none("checksum"), none("error")), 1, False)
        self.write("sources", sources.select("source", "ts", "rcid", "status", "code"), 1, False)
        self.commit(1, 0)

    def commit(self, number: int, base: int) -> None:
        self.spark.createDataFrame([(base,)], "base long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/number={number}")


def apply_batch(events: DataFrame, contents: DataFrame, root: Root, resolved: DataFrame, names: Names = NAMES, on_phase: Callable[[str], None] = lambda phase: None) -> DataFrame:
    """Applies classified events (source, ts, rcid, action, entity_id, revid, old_revid) and commits; returns the stopped sources (source, code)."""
    spark = root.spark
    on_phase(PHASES[0])
    number, base = root.last()
    number += 1
    whole = number % COMPACT == 0
    cursors = root.read("sources").select("source", F.col("ts").alias("done_ts"), F.col("rcid").alias("done_rcid"))
    new = events.join(cursors, "source", "left").where(machine.place_after(F.col("done_ts"), F.col("done_rcid"))).drop("done_ts", "done_rcid")
    states = save(root.read("states"), "states")
    folded = machine.fold(machine.steps(new, resolved), states, contents, int(spark.conf.get("spark.sql.shuffle.partitions")))
    decided = save(machine.outcomes(save(folded, "folded")), "decided")
    last = save(machine.written(decided), "written")
    on_phase(PHASES[1])
    staged = save(machine.graphs(last, contents, names), "staged")
    on_phase(PHASES[2])
    root.write("graphs", staged, number, whole)
    on_phase(PHASES[3])
    written = spark.read.schema(TABLES["graphs"][0]).parquet(f"{root.path}/graphs/number={number}")
    wrong = sync.unverified(written.where("line is not null"), last.where("revid is not null").select("entity_id", F.col("revid").alias("revision")), names)
    if not wrong.isEmpty():
        raise RuntimeError(machine.NOT_VERIFIED)
    on_phase(PHASES[4])
    moved = decided.select("entity_id").where("entity_id is not null").distinct()
    now = machine.checksums(machine.entity_states(decided, states.drop("checksum", "error")).join(moved, "entity_id", "left_semi"), contents)
    error = decided.where("outcome = 'STOPPED' and entity_id is not null").select("entity_id", F.when(F.col("error") == machine.REVISION_GAP, F.col("error")).alias("error"))
    root.write("states", now.join(error, "entity_id", "left").select(*states.columns), number, whole)
    on_phase(PHASES[5])
    sources = machine.source_states(decided)
    before = root.read("sources").select("source", F.col("ts").alias("old_ts"), F.col("rcid").alias("old_rcid"))
    sources = sources.join(before, "source", "left").select("source", F.coalesce("ts", "old_ts").alias("ts"), F.coalesce("rcid", "old_rcid").alias("rcid"), "status", "code")
    root.write("sources", save(sources, "sources"), number, whole)
    root.commit(number, number if whole else base)
    return sources.where(F.col("code").isNotNull()).select("source", "code")


def apply_stream(
    events: DataFrame, contents: DataFrame | Callable[[], DataFrame], root: str, checkpoint: str, resolved: Callable[[DataFrame], DataFrame] | None = None,
    names: Names = NAMES, on_phase: Callable[[str, int], None] = lambda phase, batch: None,
) -> StreamingQuery:
    """events: a stream of classified events. contents (entity_id, revid, kind, line): what a revision says, or a call that gives it anew for each batch.

    resolved: what the lifecycle events of a batch come to (see `machine.steps`). Runs until no event is left or a source stops, which
    fails the query with SourceStopped.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = save(batch, "batch")
        found = resolved(batch) if resolved else spark.createDataFrame([], RESOLVED)
        stopped = apply_batch(batch, contents() if callable(contents) else contents, Root(spark, root), found, names, lambda phase: on_phase(phase, number))
        first = stopped.orderBy("source").limit(1).collect()
        if first:
            raise SourceStopped(f"{first[0]['source']} stopped: {first[0]['code']}")

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


def applied(spark: SparkSession, root: str, dataset: DataFrame) -> DataFrame:
    """dataset (graph, line) with every graph as the last commit that wrote it left it."""
    return sync.replaced(dataset, Root(spark, root).read("graphs"))
