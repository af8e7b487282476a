"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, hash-chosen sample of labelled rows (the
bound is `max_rows_per_lang`); the log-probability matrix (buckets x
languages, so of fixed size) is broadcast. Scoring is one narrow pass: some documents
of a batch are a sparse matrix (one hashed index per n-gram, one offset per
document) multiplied by the matrix in numpy: rows of it looked up and summed by offset. No shuffle carries text.

Defined cases: null, empty and letterless texts give `und` with score 0; so
does every text if nothing could be learned. Rows with null lang or null text
teach nothing. Repeated rows are scored alike. Other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Bound on labelled rows that teach one language.
MAX_ROWS_PER_LANG = 20_000
#: Characters looked at in one numpy step; longer texts go in overlapping chunks.
CHUNK = 1 << 20
#: Characters of a batch that are scored at once.
STEP = 1 << 16

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashed indices of all n-grams of each order; element i starts at character i."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        if len(codes) < k:
            break
        h = (h[: len(codes) - k + 1] * np.uint32(0x9E3779B1) + codes[k - 1 :] + np.uint32(k)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            out.append((h % np.uint32(BUCKETS)).astype(np.int32))
    return out


def _chunks(text: str):
    """The codes of whole text, lower-cased, in chunks that overlap so that no n-gram is lost; with each the first new n-gram by order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    back = max(ORDERS) - 1
    for at in range(0, len(codes), CHUNK):
        yield codes[max(0, at - back) : at + CHUNK], min(at, back)


def _indices(text: str):
    for codes, back in _chunks(text):
        for k, x in zip(ORDERS, grams(codes)):
            yield x[max(0, back - k + 1) :]


def _counter(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for x in _indices(text):
                total += np.bincount(x, minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"]
        )


def train(labelled: DataFrame, max_rows_per_lang: int = MAX_ROWS_PER_LANG, smoothing: float = 0.5):
    """labelled (doc_id, text, lang) -> (languages, float32 log-probabilities [bucket, language])."""
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_rows_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("teach")), F.lit(1_000_000)) / 1_000_000
    counts = rows.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(_counter, "lang string, bucket int, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(counts["lang"].unique())
    n = np.full((BUCKETS, len(langs)), smoothing)
    n[counts["bucket"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy(str))] += counts["n"].to_numpy()
    return [str(x) for x in langs], np.log(n / n.sum(axis=0)).astype(np.float32)


def _added(step: list, langs: int, logp: np.ndarray):
    """Documents of some (document, codes, overlap), and for each the sum of its n-grams' log-probabilities and their number.

    All codes of the step are one array; a row of the sparse matrix is the run of n-grams that start in a document's own codes.
    """
    owner, parts, backs = zip(*step)
    sizes = np.array([len(x) for x in parts])
    stop = np.cumsum(sizes)
    start = stop - sizes
    codes, until = np.concatenate(parts), np.repeat(stop, sizes)
    sums, n = np.zeros((len(codes), langs)), np.zeros(len(codes))
    for k, x in zip(ORDERS, grams(codes)):
        at = np.arange(len(x))
        own = (at + k <= until[: len(x)]) & (at >= np.repeat(start + np.maximum(0, np.array(backs) - k + 1), sizes)[: len(x)])
        sums[: len(x)] += logp[x] * own[:, None]
        n[: len(x)] += own
    return np.array(owner), np.add.reduceat(sums, start, axis=0), np.add.reduceat(n, start)


def score_texts(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior, tempered to at most 64 n-grams of evidence."""
    total, n = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    step: list = []
    held = 0

    def add():
        owner, sums, counts = _added(step, len(langs), logp)
        np.add.at(total, owner, sums)
        np.add.at(n, owner, counts)
        step.clear()

    for k, text in enumerate(texts):
        if text and langs and has_letter(text):
            for codes, back in _chunks(text):
                step.append((k, codes, back))
                held += len(codes)
                if held >= STEP:
                    add()
                    held = 0
    if step:
        add()
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)
    tempered = (total - total.max(axis=1, keepdims=True)) * (np.minimum(n, 64) / np.maximum(n, 1))[:, None]
    score = np.where(n > 0, 1 / np.exp(tempered).sum(axis=1), 0.0)
    return [langs[x] if m else "und" for x, m in zip(best, n)], score.tolist()


def identify(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with `keep` and text -> `keep`, language and score under `names`; one row for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    own = "__text"
    while own in keep:
        own += "_"
    langs, logp = model
    shared = spark.sparkContext.broadcast((langs, logp))

    def scorer(batches):
        langs, logp = shared.value
        for batch in batches:
            found, scores = score_texts(batch.column(own).to_pylist(), langs, logp)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *names]
            )

    rows = docs.select(*keep, F.col("text").alias(own))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return rows.mapInArrow(scorer, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def held_out():
    """Rows that never teach: crc32 of doc_id as text is divisible by five. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
