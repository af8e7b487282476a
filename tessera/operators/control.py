"""Control-plane queries over small registry tables: gates, reconciliation, retention, top-1, upsert, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed moves of a generation, and routable (state, protection) pairs.
TRANSITIONS = {
    "CREATING": ["LOADING", "FAILED"],
    "LOADING": ["CATCHING_UP", "VALIDATING", "FAILED"],
    "CATCHING_UP": ["VALIDATING", "FAILED"],
    "VALIDATING": ["READY", "FAILED"],
    "READY": ["SERVING", "FAILED"],
    "SERVING": ["RETIRING"],
    "RETIRING": ["RETIRED", "SERVING", "FAILED"],
}
ROUTABLE = [("READY", "NONE"), ("SERVING", "SERVING"), ("RETIRING", "ROLLBACK")]


def legal(source: Column, target: Column) -> Column:
    moves = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(moves[source], target), F.lit(False))


def routable(state: Column, protection: Column) -> Column:
    return F.struct(state, protection).isin([F.struct(F.lit(a), F.lit(b)) for a, b in ROUTABLE])


def promotable() -> Column:
    return (F.col("state") == "READY") & (F.col("validation") == "VALID") & F.col("models_match") & F.col("manifest").isNotNull()


def retained(generations: DataFrame, protected: DataFrame, keep_failed: int = 1) -> DataFrame:
    """Generations that may be removed: retired or failed, neither protected nor among the newest failed ones of their source.

    protected (source, generation): the pointer's current and previous generation, and both of a promotion that is being
    prepared. A protected generation may be the newest failed one; the next is then not kept for it.
    """
    old = generations.where(F.col("state").isin("RETIRED", "FAILED"))
    newest = F.row_number().over(Window.partitionBy("source", "state").orderBy(F.desc("created_at"), F.desc("generation")))
    free = old.withColumn("k", newest).where((F.col("state") == "RETIRED") | (F.col("k") > keep_failed)).drop("k")
    return free.join(protected.distinct(), ["source", "generation"], "left_anti")


def upserted(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key of both frames."""
    rows = table.unionByName(changes)
    newest = F.max_by(F.struct(*rows.columns), F.struct(version, *[c for c in rows.columns if c not in key])).alias("r")
    return rows.groupBy(*key).agg(newest).select("r.*")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def reconcile(generations: DataFrame, pointers: DataFrame, promotions: DataFrame, health: DataFrame) -> DataFrame:
    """source, status of each source's serving state, by priority.

    pointers: source, generation, previous. promotions: source, state. health: source, generation, health.
    """
    held = pointers.select("source", F.col("generation").alias("pointed"), "previous")
    seen = generations.join(held, "source", "left")
    per = seen.groupBy("source").agg(
        F.bool_or(F.col("generation") == F.col("pointed")).alias("known"),
        F.count_if(F.col("state") == "SERVING").alias("serving"),
        F.max(F.when(F.col("state") == "SERVING", F.col("generation"))).alias("registered"),
        F.bool_or((F.col("state") == "READY") & ~F.col("generation").eqNullSafe(F.col("previous"))).alias("ready"),
    )
    preparing = promotions.where("state = 'PREPARING'").select("source").distinct().withColumn("preparing", F.lit(True))
    well = health.where("health = 'healthy'").select("source", F.col("generation").alias("pointed")).distinct().withColumn("well", F.lit(True))
    rows = held.join(per, "source", "full").join(preparing, "source", "full").join(well, ["source", "pointed"], "left")
    status = (
        F.when(F.col("preparing"), "AMBIGUOUS_PROMOTION")
        .when(F.col("pointed").isNull(), "POINTER_MISSING")
        .when(~F.coalesce("known", F.lit(False)), "POINTER_TARGET_MISSING")
        .when((F.col("serving") != 1) | (F.col("registered") != F.col("pointed")), "POINTER_REGISTRY_MISMATCH")
        .when(F.col("well").isNull(), "SERVING_GENERATION_UNAVAILABLE")
        .when(F.col("ready"), "CONSISTENT_WITH_READY_CANDIDATE")
        .otherwise("CONSISTENT")
    )
    return rows.select("source", status.alias("status"))


def freshness(indexed: Column, head: Column, now: Column) -> dict[str, Column]:
    """caught_up, lag and idle in whole seconds. indexed and head are cursors (ts, rcid) or null; a tie of ts goes by rcid."""
    caught = head.isNull() | F.coalesce(indexed >= head, F.lit(False))
    seconds = lambda a, b: F.greatest(F.lit(0), F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000)).cast("long")
    lag = F.when(indexed.isNull(), seconds(head["ts"], now)).otherwise(seconds(indexed["ts"], head["ts"]))
    return {"caught_up": caught, "lag": F.when(caught, 0).otherwise(lag).cast("long"), "idle": F.when(head.isNotNull(), seconds(head["ts"], now))}


def sync_state(state: Column, schema_state: Column, caught_up: Column) -> Column:
    """What is told of a generation: current only if it and its schema are, and it has caught up."""
    current = (state == "CURRENT") & (schema_state == "CURRENT") & caught_up
    return F.when(F.coalesce(current, F.lit(False)), "CURRENT").when(state.isin("ERROR", "GAP_DETECTED"), state).otherwise("STALE")


def health(state: Column) -> Column:
    return F.when(state == "CURRENT", "healthy").when(state.isin("ERROR", "GAP_DETECTED"), "unhealthy").otherwise("degraded")
