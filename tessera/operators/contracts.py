"""Checks of registry rows: graph descriptors, snapshot manifests, promotion and retirement of generations, and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, UUID, Names

# Formats, and keys and models of a snapshot manifest.
SHA256 = "^[0-9a-f]{64}$"
MANIFEST = "manifestVersion string, snapshotId string, sourceIdentity string, createdAt string, cursor struct<timestamp string, rcid long>, normalizationModel string, partitionModel string, artifact struct<format string, sha256 string, bytes long, graphCount long>"
MANIFEST_KEYS = {
    "$": ["manifestVersion", "snapshotId", "sourceIdentity", "createdAt", "cursor", "normalizationModel", "partitionModel", "artifact"],
    "$.cursor": ["timestamp", "rcid"],
    "$.artifact": ["format", "sha256", "bytes", "graphCount"],
}
FORMAT = "application/n-triples"
#: Reasons against a retirement that other tables give, in the order in which they are listed.
BUSY = ["PROMOTION_INCOMPLETE", "ROLLBACK_INCOMPLETE", "LIFECYCLE_OPERATION_ACTIVE", "SYNC_ACTIVE"]


def graph_fits(graph: Column, kind: Column, entity: Column, names: Names = NAMES) -> Column:
    """Whether kind, entity id and IRI of a graph belong together."""
    named = lambda name: graph.eqNullSafe(names.graph(name, entity))
    fits = (
        F.when((kind == "GLOBAL") & entity.isNull(), graph.eqNullSafe(names.graph("global")))
        .when((kind == "ENTITY") & entity.rlike("^[QP][1-9][0-9]*$"), named("entity"))
        .when((kind == "PROPERTY_SCHEMA") & entity.rlike("^P[1-9][0-9]*$"), named("schema"))
    )
    return F.coalesce(fits, F.lit(False))


def manifest_valid(text: Column, names: Names = NAMES) -> Column:
    """Whether a JSON text is a snapshot manifest: exactly its keys, and values of the right form."""
    m = F.from_json(text, MANIFEST)
    keys = [F.sort_array(F.json_object_keys(F.get_json_object(text, at))) == F.array(*map(F.lit, sorted(names))) for at, names in MANIFEST_KEYS.items()]
    at = lambda path: m[path] if "." not in path else m[path.split(".")[0]][path.split(".")[1]]
    models = {"manifestVersion": names.snapshot, "normalizationModel": names.normalization, "partitionModel": names.partition, "artifact.format": FORMAT}
    rules = [
        *keys,
        *[at(k) == v for k, v in models.items()],
        at("snapshotId").rlike(f"(?i)^{UUID}$"),
        (at("sourceIdentity") == names.source) | at("sourceIdentity").rlike(names.source_pattern),
        *[F.try_to_timestamp(at(k)).isNotNull() for k in ("createdAt", "cursor.timestamp")],
        at("cursor.rcid") >= 0,
        at("artifact.sha256").rlike(SHA256),
        at("artifact.bytes") >= 0,
        at("artifact.graphCount") >= 1,
    ]
    valid = rules[0]
    for rule in rules[1:]:
        valid = valid & rule
    return F.coalesce(valid, F.lit(False))


def promotion_error() -> Column:
    """Why a candidate can't be promoted, or null. Columns: state, protection, validation, checksum, models_match, manifest, sync_state,
    schema_state, and the cursors (ts, rcid) catchup and ingestion."""
    validated = (F.col("state") == "READY") & (F.col("protection") == "NONE") & (F.col("validation") == "VALID")
    validated = validated & F.col("checksum").rlike(SHA256) & F.col("models_match") & F.col("manifest").isNotNull()
    current = (F.col("sync_state") == "CURRENT") & (F.col("schema_state") == "CURRENT") & (F.col("catchup") >= F.col("ingestion"))
    return F.when(~F.coalesce(validated, F.lit(False)), "CANDIDATE_NOT_VALIDATED").when(~F.coalesce(current, F.lit(False)), "CANDIDATE_NOT_CURRENT")


def retirement(asked: DataFrame, generations: DataFrame, pointers: DataFrame, busy: DataFrame) -> DataFrame:
    """asked (source, generation) -> the same with reasons against retiring it; none means that it may go.

    generations: source, generation, state, protection. pointers: source, current, previous. busy: source, generation, reason of BUSY.
    """
    key = ["source", "generation"]
    held = busy.groupBy(*key).agg(F.collect_set("reason").alias("held"))  # of four values
    rows = asked.join(generations.select(*key, "state", "protection"), key, "left")
    rows = rows.join(pointers.select("source", "current", "previous"), "source", "left").join(held, key, "left")
    # The reason that each protection gives.
    protections = {"ROLLBACK": "ROLLBACK_PROTECTED", "SERVING": "SERVING_PROTECTED", "PROMOTION_IN_PROGRESS": "PROMOTION_PROTECTED", "RETIREMENT_IN_PROGRESS": "RETIREMENT_IN_PROGRESS"}
    missing = [F.when(F.col("current").isNull(), "SERVING_POINTER_MISSING"), F.when(F.col("state").isNull(), "GENERATION_MISSING")]
    against = [
        F.when(F.col("state") == "SERVING", "GENERATION_SERVING"),
        F.create_map(*[F.lit(x) for pair in protections.items() for x in pair])[F.col("protection")],
        F.when(F.col("current") == F.col("generation"), "SERVING_POINTER_CURRENT"),
        F.when(F.col("previous") == F.col("generation"), "SERVING_POINTER_PREVIOUS"),
        F.when(~F.col("state").isin("RETIRING", "RETIRED", "FAILED"), "LIFECYCLE_STATE_NOT_RETIRABLE"),
        *[F.when(F.array_contains("held", reason), reason) for reason in BUSY],
    ]
    absent = F.col("current").isNull() | F.col("state").isNull()
    return rows.select(*key, F.when(absent, F.array_compact(F.array(*missing))).otherwise(F.array_compact(F.array(*against))).alias("reasons"))


def visibility(failed: Column, ok: Column, complete: Column, version: Column, old_version: Column) -> Column:
    """The class of one answer seen during a switch of the pointer."""
    seen = F.when(version.eqNullSafe(old_version), "OLD_COMPLETE").otherwise("NEW_COMPLETE")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(failed, "CONNECTION_ERROR").when(no(ok), "INVALID").when(no(complete), "PARTIAL").otherwise(seen)
