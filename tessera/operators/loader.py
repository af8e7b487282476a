"""Loading a partitioned snapshot: one registry row a graph, with counts, checksum and revision from one sorted pass, and a generation made from it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, Names
from ..sources.generations import Generations
from .machine import STATE
from .sync import AMBIGUOUS_REVISION

REGISTRY = "graph string, partition_kind string, entity_id string, lines long, checksum string, revision long, error string"
_VERSION = re.compile(r'<[^>]+/(?:entity|wiki/Special:EntityData)/([QP][1-9][0-9]*)> <http://schema\.org/version> "([0-9]+)"')


class AmbiguousRevision(ValueError):
    pass


def registry(dataset: DataFrame, names: Names = NAMES, width: int | None = None) -> DataFrame:
    """dataset (graph, partition_kind, line) -> a row for each graph (the columns of REGISTRY); the global graph has one even if it is empty.

    checksum: SHA-256 of the sorted distinct lines, a newline after each. Rows are dealt by graph and sorted, and a task streams over them with one digest
    held, so a graph of any size takes no memory; a digest of one text can't be split over tasks. revision is of entity graphs, and error tells that it isn't one number.
    """

    def made(graph: str, kind: str, lines: int, digest, found: set[int]) -> tuple:
        if not lines:  # the global graph's own row, with no line
            return graph, kind, None, 0, None, None, None
        entity = None if kind == "GLOBAL" else graph.rsplit(":", 1)[-1]
        sound = kind == "ENTITY" and len(found) == 1 and min(found) >= 1
        return graph, kind, entity, lines, digest.hexdigest(), min(found) if sound else None, None if sound or kind != "ENTITY" else AMBIGUOUS_REVISION

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, lines, digest, found = None, None, 0, None, set()
        for pdf in frames:
            out = []
            for graph, kind, line in zip(pdf["graph"], pdf["partition_kind"], pdf["line"]):
                if (graph, kind) != now:
                    if now:
                        out.append(made(*now, lines, digest, found))
                    now, last, lines, digest, found = (graph, kind), None, 0, hashlib.sha256(), set()
                if line is None or line == last:
                    continue
                last, lines = line, lines + 1
                digest.update(line.encode() + b"\n")
                m = _VERSION.match(line) if kind == "ENTITY" else None
                if m and m[1] == graph.rsplit(":", 1)[-1]:
                    found.add(int(m[2]))
            yield pd.DataFrame(out, columns=columns)
        if now:
            yield pd.DataFrame([made(*now, lines, digest, found)], columns=columns)

    columns = [c.split()[0] for c in REGISTRY.split(", ")]
    width = width or int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row without a line stands for the global graph, so that it is met even if it is empty; asking for it afterwards would run the whole pass twice
    empty = dataset.sparkSession.range(1).select(names.graph("global").alias("graph"), F.lit("GLOBAL").alias("partition_kind"), F.lit(None).cast("string").alias("line"))
    rows = dataset.select("graph", "partition_kind", "line").unionByName(empty).repartition(width, "graph").sortWithinPartitions("graph", "partition_kind", "line")
    return rows.mapInPandas(fold, REGISTRY)


def first_states(rows: DataFrame) -> DataFrame:
    """A registry's entity graphs as the states that changes start from."""
    own = rows.where("partition_kind = 'ENTITY'")
    return own.select("entity_id", F.col("revision").alias("indexed_revision"), F.col("revision").alias("latest_seen_revision"), F.lit("CURRENT").alias("status")).to(_type(STATE))


def _type(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def manifest(rows: DataFrame, names: Names = NAMES) -> DataFrame:
    """One row about a registry: version, models, graphs, graphs of each kind, lines."""
    count = lambda kind: F.count_if(F.col("partition_kind") == kind).alias(kind.lower())
    found = rows.agg(F.count("*").alias("graph_count"), *map(count, ("ENTITY", "PROPERTY_SCHEMA", "GLOBAL")), F.coalesce(F.sum("lines"), F.lit(0)).alias("quads"))
    return found.select(F.lit(1).alias("version"), F.lit(names.normalization).alias("normalization_model"), F.lit(names.partition).alias("partition_model"), "*")


def load(store: Generations, name: str, dataset: DataFrame, provenance: DataFrame | None = None, names: Names = NAMES) -> DataFrame:
    """Writes a generation with its registry, first states, manifest and provenance, and returns the registry. An entity graph without exactly one
    revision fails the load before anything is written that could be promoted."""
    spark = dataset.sparkSession
    aside = f"{store.root}/_{name}"
    registry(dataset, names).write.mode("overwrite").parquet(f"{aside}/registry")
    rows = spark.read.parquet(f"{aside}/registry")
    wrong = rows.where("error is not null").orderBy("graph").limit(1).collect()
    if wrong:
        raise AmbiguousRevision(f"{wrong[0]['error']}: {wrong[0]['graph']}")
    first_states(rows).write.mode("overwrite").parquet(f"{aside}/states")
    manifest(rows, names).write.mode("overwrite").parquet(f"{aside}/manifest")
    if provenance is not None:
        provenance.write.mode("overwrite").parquet(f"{aside}/provenance")
    store.load(name, dataset.select("graph", "partition_kind", "line"))
    return rows
