"""Registry questions: counts, identities, constraints, migrations, artifacts, observation of a candidate, public errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, UUID, Names
from .control import freshness

KINDS = ["ENTITY", "PROPERTY_SCHEMA", "GLOBAL"]
REBUILDING = ["LOADING", "CATCHING_UP", "VALIDATING"]


def entity_counts(states: DataFrame) -> DataFrame:
    """current and failed of entity states."""
    return states.agg(F.count_if(F.col("status") == "CURRENT").alias("current"), F.count_if(F.col("status").isin("FAILED", "GAP")).alias("failed"))


def failed_per_generation(generations: DataFrame, states: DataFrame) -> DataFrame:
    """generation, failed: 0 for those without a failed entity."""
    failed = states.where(F.col("status").isin("FAILED", "GAP")).groupBy("generation").agg(F.count("*").alias("failed"))
    return generations.select("generation").join(failed, "generation", "left").select("generation", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"))


def identities(instance: Column, source: Column, query: Column, names: Names = NAMES) -> Column:
    """(instance, source, query, error): names of an instance are made from its UUID; with none of the three, those of the first one."""
    none = instance.isNull() & source.isNull() & query.isNull()
    made = F.coalesce(source, F.concat(F.lit(f"{names.instance_source}."), instance))
    asked = F.coalesce(query, F.concat(F.lit(f"{names.instance_query}-"), instance))
    ok = lambda c, p: F.coalesce(c.rlike(p), F.lit(False))
    fits = ok(made, f"^{names.instance_source}[.][0-9a-f-]{{36}}$") & ok(asked, f"^{names.instance_query}-[0-9a-f-]{{36}}$")
    error = F.when(none, F.lit(None)).when(~ok(instance, f"^{UUID}$"), "INVALID_INSTANCE_IDENTITY").when(~fits, "INVALID_QUERY_IDENTITY")
    pick = lambda default, c: F.when(none, F.lit(default)).when(error.isNull(), c)
    return F.struct(pick(names.first_instance, instance).alias("instance"), pick(names.source, made).alias("source"), pick(names.query, asked).alias("query"), error.alias("error"))


def violations(generations: DataFrame) -> DataFrame:
    """source, rule, n of constraints that rows (source, generation, state, snapshot_ts, snapshot_rcid, checksum, version) break."""
    pair = F.col("snapshot_ts").isNull() != F.col("snapshot_rcid").isNull()
    rules = {
        "cursor_pair": pair,
        "rcid_range": F.col("snapshot_rcid") < 0,
        "checksum_form": ~F.col("checksum").rlike("^[0-9a-f]{64}$"),
        "version_range": F.col("version") < 1,
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    per_row = generations.select("source", F.explode(broken).alias("rule")).groupBy("source", "rule").agg(F.count("*").alias("n"))
    serving = generations.where("state = 'SERVING'").groupBy("source").agg(F.count("*").alias("n")).where("n > 1")
    return per_row.unionByName(serving.select("source", F.lit("one_serving").alias("rule"), "n"))


def migration_status(known: DataFrame, applied: DataFrame) -> DataFrame:
    """known (version, checksum) -> version, checksum, state: applied, checksum_mismatch or pending."""
    rows = known.join(applied.select("version", F.col("checksum").alias("before")), "version", "left")
    state = F.when(F.col("before").isNull(), "pending").when(F.col("before") == F.col("checksum"), "applied").otherwise("checksum_mismatch")
    return rows.select("version", "checksum", state.alias("state"))


def artifact_faults(artifacts: DataFrame) -> DataFrame:
    """id of artifacts (id, content, sha256, bytes) whose content isn't what the manifest says."""
    same = (F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")) & (F.octet_length("content") == F.col("bytes"))
    return artifacts.where(~F.coalesce(same, F.lit(False))).select("id")


def snapshot_metrics(lines: DataFrame) -> DataFrame:
    """bytes with a newline after each line, and triples; the checksum of a snapshot is that of its artifact, which is one file."""
    return lines.agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.count_if(F.endswith("line", F.lit(" ."))).alias("triples"))


def observed(candidates: DataFrame, sources: DataFrame, graphs: DataFrame, now: Column) -> DataFrame:
    """What is seen of candidates (source, generation, state, sync_state, schema_state, ts, rcid) while they catch up.

    sources: source, head_ts, head_rcid. graphs: generation, partition_kind.
    """
    counts = graphs.groupBy("generation").agg(*[F.count_if(F.col("partition_kind") == k).alias(k.lower()) for k in KINDS])
    rows = candidates.join(sources, "source").join(counts, "generation", "left")
    own = F.when(F.col("ts").isNotNull() & F.col("rcid").isNotNull(), F.struct("ts", "rcid"))  # none before the first commit
    made = freshness(own, F.struct(F.col("head_ts").alias("ts"), F.col("head_rcid").alias("rcid")), now)
    ready = made["caught_up"] & (F.col("sync_state") == "CURRENT") & (F.col("schema_state") == "CURRENT")
    return rows.select(
        "source", "generation", made["caught_up"].alias("caught_up"), made["lag"].alias("lag"), ready.alias("ready_for_validation"),
        F.col("state").isin(REBUILDING).alias("rebuilding"), *[F.coalesce(k.lower(), F.lit(0)).cast("long").alias(k.lower()) for k in KINDS],
    )


def public_error(reasons: Column) -> Column:
    """The one code that is told of reasons against a retirement, by priority. The groups and codes are fixed values."""
    any_of = lambda *names: F.arrays_overlap(reasons, F.array(*map(F.lit, names)))
    return (
        F.when(any_of("PROMOTION_INCOMPLETE"), "INCOMPLETE_PROMOTION")
        .when(any_of("GENERATION_SERVING", "SERVING_PROTECTED", "SERVING_POINTER_CURRENT"), "SERVING_GENERATION_PROTECTED")
        .when(any_of("ROLLBACK_PROTECTED", "SERVING_POINTER_PREVIOUS", "ROLLBACK_INCOMPLETE"), "ROLLBACK_GENERATION_PROTECTED")
        .otherwise("RETIREMENT_WAITING_ELIGIBILITY")
    )
