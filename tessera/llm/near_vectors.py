"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

Equal vectors are one class, so copies cost nothing more. A bounded, hash-chosen sample
teaches PCA and rotations that make balanced binary codes (the bound is
`MAX_FIT_VALUES` components). Each code is cut into substrings of about log2(n) bits, a
table for each; two codes meet in a table if their substrings differ in a bit at most, found
by an equi-join of each substring with the probes around the other. The number of rotations, and the
width where many would be needed, follow from pairs made at the threshold around sampled vectors and coded as all
vectors are, so a common direction, which centring takes away, is in the measure: the share of
them that is missed is below MISS whatever n is. Pairs that meet and are near in Hamming distance are reranked by
cosine of the original vectors in double precision.

Links are counted per vector, which takes every linked pair of different vectors; there is no bound on
them but the data's. All joins are by substring or id, so AQE can split a hot one.

Defined cases: null vectors, zero vectors, those with null or non-finite components, those of another length
than most, and rows with a null id link with nothing and are components of their own; repeated
rows count as other vectors and get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import components

THRESHOLD = 0.95
BITS = 64
MAX_FIT_VALUES = 1 << 20
ROUNDS = 30
MISS = 0.005
# Beyond so many rotations, narrower substrings meet more pairs for less. Pairs drawn of each sort.
MANY_ROTATIONS = 32
PAIRS = 4096


def fit(sample: np.ndarray, bits: int, seed: int = 3):
    """Mean, and a generator of projections to `bits` signs, one for each rotation."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, axes = np.linalg.eigh((unit - mean).T @ (unit - mean))
    axes = axes[:, ::-1][:, :bits]
    v = (unit - mean) @ axes
    rng = np.random.default_rng(seed)

    def turned():
        while True:
            r, _ = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            yield axes @ r

    return mean, turned()


def threshold_pairs(sample: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors x, y with cosine THRESHOLD: first PAIRS in any direction from x, then PAIRS in that of a sampled difference."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    pick = lambda: unit[rng.integers(len(unit), size=PAIRS)]
    x = np.concatenate([pick(), pick()])
    anyhow = rng.standard_normal(x.shape)
    z = np.concatenate([anyhow[:PAIRS], pick() - pick()])
    across = lambda z: z - (z * x).sum(axis=1, keepdims=True) * x
    z = across(z)
    z = np.where(np.linalg.norm(z, axis=1, keepdims=True) > 1e-6, z, across(anyhow))
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return x, THRESHOLD * x + math.sqrt(1 - THRESHOLD**2) * z


def layout(width: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each table of a code."""
    tables = max(1, bits // width)
    cuts = [bits * k // tables for k in range(tables + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def least_rotations(parts: list[tuple[int, int]]) -> int:
    """Rotations that miss fewer than MISS of the pairs at the threshold if centring widens no angle."""
    p = math.acos(THRESHOLD) / math.pi
    missed = math.prod(1 - (1 - p) ** s - s * p * (1 - p) ** (s - 1) for _, s in parts)
    return max(1, math.ceil(math.log(MISS) / math.log(missed))) if missed > 0 else 1


def plan(sample: np.ndarray, n: int, bits: int):
    """Mean, projections, tables, and the Hamming distance up to which pairs that meet are reranked."""
    mean, turned = fit(sample, bits)
    x, y = threshold_pairs(sample)
    projections, differ = [], []

    def turn():
        projections.append(next(turned))
        differ.append(((x - mean) @ projections[-1] > 0) != ((y - mean) @ projections[-1] > 0))

    turn()
    near = max(math.ceil(bits * 0.32), int(np.quantile(differ[0].sum(axis=1), 1 - MISS / 4, method="higher")))
    width = max(8, math.ceil(math.log2(max(n, 2))))
    while True:
        parts = layout(width, bits)
        least = min(MANY_ROTATIONS, least_rotations(parts))
        missed = np.ones(len(x), bool)
        for r in range(MANY_ROTATIONS):
            if r == len(projections):
                turn()
            meets = np.any([differ[r][:, a : a + w].sum(axis=1) <= 1 for a, w in parts], axis=0)
            missed &= ~(meets & (differ[r].sum(axis=1) <= near))
            if r + 1 >= least and max(missed[:PAIRS].mean(), missed[PAIRS:].mean()) < MISS:
                return mean, np.stack(projections[: r + 1]), parts, near
        if width == 1:
            return mean, np.stack(projections[:1]), parts, bits  # all pairs meet
        width //= 2


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _coder(model, parts, probing: bool):
    """id, vector -> rows (cell, key, id, code); probing also at each key a bit away."""

    def coder(batches):
        mean, projections = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
            ids = batch.column("id")
            for r, axes in enumerate(projections):
                signs = (x @ axes > 0).astype(np.uint64)
                code = (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                for t, (at, width) in enumerate(parts):
                    key = (code >> np.uint64(at)) & np.uint64((1 << width) - 1)
                    flips = [0, *(1 << k for k in range(width))] if probing else [0]
                    keys = np.concatenate([key ^ np.uint64(f) for f in flips])
                    n = len(flips)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), r * len(parts) + t, np.int32)),
                            pa.array(keys.view(np.int64)),
                            ids.take(pa.array(np.tile(np.arange(len(ids)), n))),
                            pa.array(np.tile(code, n).view(np.int64)),
                        ],
                        ["cell", "key", "id", "code"],
                    )

    return coder


def _cosines(batches):
    for batch in batches:
        if batch.num_rows:
            x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
            cos = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield batch.select(["a", "b"]).filter(pa.array(cos >= THRESHOLD))


def candidates(vectors: DataFrame, n: int, dim: int) -> DataFrame:
    """Distinct pairs a < b of ids of different vectors that meet in a table and are near in Hamming distance."""
    spark = vectors.sparkSession
    bits = min(BITS, dim)
    want = max(256, MAX_FIT_VALUES // dim)
    draw = F.pmod(F.xxhash64("id", F.lit("itq")), F.lit(1_000_000)) / 1_000_000
    sample = vectors.where(draw < min(1.0, 0.9 * want / n)).limit(want).toPandas()
    if len(sample) < 2:
        sample = vectors.limit(2).toPandas()
    sample = np.array(sample.sort_values("id")["embedding"].tolist(), np.float64)
    mean, projections, parts, near = plan(sample, n, bits)
    model = spark.sparkContext.broadcast((mean, projections))
    id_type = dict(vectors.dtypes)["id"]
    schema = f"cell int, key long, id {id_type}, code long"
    index = vectors.mapInArrow(_coder(model, parts, False), schema)
    probes = vectors.mapInArrow(_coder(model, parts, True), schema)
    met = index.alias("i").join(probes.alias("p"), ["cell", "key"]).where("i.id < p.id")
    met = met.where(F.bit_count(F.col("i.code").bitwiseXOR(F.col("p.code"))) <= near)
    return met.select(F.col("i.id").alias("a"), F.col("p.id").alias("b")).distinct()


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding) -> vec_id, n_links, component_id, kept; one row for each row."""
    sound = F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("embedding", lambda c: c != 0), F.lit(False)
    )
    rows = embeddings.select("vec_id", F.when(sound, F.col("embedding")).alias("embedding"))
    sizes = rows.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    dim = most["d"] if most else 0
    rows = save(rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding"))), "vectors")
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("c"))
    classes = save(classes, "classes")
    n = classes.count()
    if not n:
        alone = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    id_type = dict(classes.dtypes)["id"]
    vectors = classes.select("id", "embedding")
    pairs = candidates(vectors, n, dim)
    pairs = pairs.join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a")
    pairs = pairs.join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    links = save(pairs.select("a", "b", "x", "y").mapInArrow(_cosines, f"a {id_type}, b {id_type}"), "links")
    both = links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a")))
    degree = both.join(classes.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.sum("c").alias("linked"))
    named = classes.join(degree.withColumnRenamed("a", "id"), "id", "left").join(components(links), "id", "left")
    named = named.select("embedding", (F.col("c") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(named, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )
