"""Mixing sources to target weights.

Tokens are added up per source (combined before the shuffle, so a hot source is no
hot task), targets are water-filled over the few rows per source, and each
document is emitted floor(rate) times plus once more if a draw seeded by the
hash of its id falls below the fraction of the rate. Only built-in functions.

Defined cases: a null text has size 0; sources go by code point with null last;
a source without words has target 0 and rate 0; rows that repeat an id get the
same draw; empty tables give no rows; reruns agree, as nothing depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) -> the same rows with target.

    A target is min(CAP * size, level * weight). With sources by CAP * size / weight, those that reach their cap come
    first; the level is what they leave, divided by the weight of the rest. This is where resharing the excess ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sources.withColumn("__w", weight.cast("double")).withColumn("__cap", F.col("source_size") * F.lit(CAP))
    order = [F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    rest = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    rows = rows.withColumn("__level", left / rest)
    capped = F.col("__cap") <= F.col("__level") * F.col("__w")
    level = F.min(F.when(~capped, F.struct(F.col("__cap") / F.col("__w"), F.col("__level")))).over(everything)["__level"]
    return rows.withColumn("target", F.when(capped, F.col("__cap")).otherwise(level * F.col("__w"))).drop("__w", "__cap", "__level")


def copies(sizes: DataFrame, seed: str = "mix") -> DataFrame:
    """sizes (doc_id, source, size) -> the same rows with source_size, target and copies."""
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    return taken(sizes, sources, seed)


def taken(rows: DataFrame, sources: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (doc_id, source, ...) with source_size, target and copies; sources (source, source_size, target)."""
    sources = sources.withColumnRenamed("source", "__source")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["__source"])).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    extra = F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return rows.withColumn("copies", (F.floor(rate) + extra).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every document, counted once."""
    return save(docs.select("doc_id", "source", word_count().alias("size")), "sizes")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    names = docs.columns
    sources = targets(docs.select("source", word_count().alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")))
    rows = docs.select(F.col("doc_id"), F.col("source"), F.struct(*names).alias("__row"))
    rows = taken(rows, sources, seed).where("copies > 0")
    rows = rows.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("__row.*")
