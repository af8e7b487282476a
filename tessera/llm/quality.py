"""Quality rules: an isolation forest on rule statistics.

One narrow pass computes the rule statistics of every whole text. The forest
is grown on a bounded, hash-chosen sample (an isolation tree takes 256 rows by
definition); short path lengths mark anomalous documents. The threshold is calibrated on
labelled rows through a histogram of their scores, so no document leaves the executors.

Defined cases: null and empty texts have zero words and fail the base rules;
rows without a label, or with a null one, calibrate nothing; with no labels of
both kinds no document fails by score; repeated rows are judged alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
TREES, SAMPLE = 100, 256
#: Bound on the rows that the trees are grown on.
MAX_FIT_ROWS = TREES * SAMPLE
#: Share of labelled good documents that the threshold may cost at most.
MAX_GOOD_LOSS = 0.005

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats")


def repeat_words(words: list[bytes]) -> int:
    """Words in 8-word windows found twice or more: exact, by doubling the length of what a rank stands for."""
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    rank = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    span, n = 1, len(known)
    while span < WINDOW:
        key = rank[:-span] * n + rank[span:]
        values, rank, counts = np.unique(key, return_inverse=True, return_counts=True)
        span, n = 2 * span, len(values)
        if n == len(rank):
            return 0
    starts = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    joined = b"".join(words)
    return len(words), len(joined.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines and the five statistics; one row for each row."""
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    names = ["n_lines", *STATS]

    def counter(batches):
        for batch in batches:
            rows = [(t.count(b"\n") + 1, *text_stats(t)) for t in batch.column("text").to_pylist()]
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    small_batches(docs.sparkSession)
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names)
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(counter, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.select(
        "*",
        F.log1p("n_words").alias("words"),
        (F.col("word_chars") / n).alias("word_length"),
        (F.col("n_symbols") / n).alias("symbols"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / n).alias("repeats"),
    )


def _mean_path(n: float) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Trees as heap-ordered arrays: split feature (-1 in a leaf), split value, path length; and the sample size."""
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, len(rows))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    feature = np.full((TREES, 2 ** (depth + 1) - 1), -1)
    value, path = np.zeros(feature.shape), np.zeros(feature.shape)
    for t in range(TREES):
        stack = [(0, 0, rows[rng.choice(len(rows), size, replace=False)])]
        while stack:
            node, d, x = stack.pop()
            lo, hi = x.min(axis=0), x.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if d == depth or not len(usable):
                path[t, node] = d + _mean_path(len(x))
                continue
            f = rng.choice(usable)
            v = rng.uniform(lo[f], hi[f])
            feature[t, node], value[t, node] = f, v
            left = x[:, f] < v
            if not left.any():
                left = x[:, f] <= v
            stack += [(2 * node + 1, d + 1, x[left]), (2 * node + 2, d + 1, x[~left])]
            value[t, node] = x[left, f].max()  # x <= value goes left
    return feature, value, path, size


def anomaly(forest, x: np.ndarray) -> np.ndarray:
    feature, value, path, size = forest
    total = np.zeros(len(x))
    for f, v, p in zip(feature, value, path):
        node = np.zeros(len(x), np.int64)
        while (inner := f[node] >= 0).any():
            at = node[inner]
            node[inner] = 2 * at + np.where(x[inner, f[at]] <= v[at], 1, 2)
        total += p[node]
    return 2.0 ** -(total / TREES / max(_mean_path(size), 1e-9))


def score(stats: DataFrame) -> DataFrame:
    """stats -> the same rows with anomaly (0 to 1); the forest is grown on a bounded sample of them."""
    spark = stats.sparkSession
    rows = with_features(stats)
    n = rows.count()
    if not n:
        return stats.withColumn("anomaly", F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("forest")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < min(1.0, 0.9 * MAX_FIT_ROWS / n)).select("doc_id", *FEATURES).limit(MAX_FIT_ROWS).toPandas()
    if sample.empty:
        sample = rows.select("doc_id", *FEATURES).limit(SAMPLE).toPandas()
    fit = sample.sort_values(["doc_id", *FEATURES])[list(FEATURES)].to_numpy(float)
    shared = spark.sparkContext.broadcast(grow(fit))

    def scorer(frames):
        forest = shared.value
        for pdf in frames:
            s = anomaly(forest, pdf[list(FEATURES)].to_numpy(float))
            yield pdf.drop(columns=list(FEATURES)).assign(anomaly=s)

    schema = ", ".join(f"`{c}` {t}" for c, t in stats.dtypes)
    return rows.mapInPandas(scorer, f"{schema}, anomaly double")


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold with the best gain on labelled rows among those that cost at most MAX_GOOD_LOSS of the good ones."""
    quality = labels.select("doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    step = F.floor(F.col("anomaly") * 1000)
    seen = scored.where(~base_failed()).select("doc_id", step.alias("step")).join(quality, "doc_id")
    table = seen.groupBy("step", "quality").agg(F.count("*").alias("n")).collect()  # at most 2,002 rows
    good, bad = np.zeros(1002), np.zeros(1002)
    for r in table:
        (good if r["quality"] else bad)[r["step"]] += r["n"]
    if not good.sum() or not bad.sum():
        return 2.0
    above = lambda x: np.cumsum(x[::-1])[::-1] / x.sum()
    lost, caught = above(good), above(bad)
    gain = np.where(lost <= MAX_GOOD_LOSS, caught - lost, -1.0)
    return float(np.argmax(gain)) / 1000 if gain.max() > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> statistics, base_failed, anomaly and kept of every row."""
    scored = save(score(save(statistics(docs), "stats")), "scored")
    threshold = calibrate(scored, labels)
    failed = base_failed()
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < threshold))
