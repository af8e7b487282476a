"""Ranked lexical search: documents reordered by recursive graph bisection, and shards visited by bound until exact.

Texts become counts of the terms that the queries ask. A bisection tree learnt from a bounded, hash-chosen sample
(`SAMPLE` documents) deals all documents into buckets of like ones, about `BUCKET` each; a leaf with more is split by hash. Within its bucket
every document takes part in the recursive bisection proper: a set is halved, documents swap sides while that lowers the
cost of the gaps between a term's documents (degree times log of size over degree, summed over terms and sides), and the
halves are halved again down to shards of about `SHARD`. A shard keeps each term's postings with their integer impacts, and the
largest impact of each term.

A term's largest impact in a bucket bounds what any document there gains by it, so the sum over a query's terms bounds
its scores. Each query first visits its most promising buckets; its 20th best score there is a floor, and it then visits every
other bucket whose bound reaches it, four times as many each round, until no such bucket is left. Inside a bucket shards go by their own bounds in the
same way. A bound equal to the floor is visited, as a smaller doc_id may win the tie. So the result is exact whatever the order is.

Queries go in blocks whose terms are about `BLOCK_BYTES` (by the counted bytes of all queries), so what is broadcast, the terms
of a block, is bounded; documents are read once a block. Scores are sums of whole numbers: in doubles while
those hold them exactly, else in 64-bit integers.

Defined cases: null and empty texts have no terms and don't count; a query without a term that any document has gives no rows; repeated documents
are ranked each, ties by ascending doc_id, null ids last; repeated queries (or those with a null id) are answered each; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches, text_bytes
from .hashing import by_bytes

TOP = 20
SAMPLE, BUCKET, SHARD = 16_384, 4_096, 256
#: Levels of the tree that the sample teaches at most, rounds of swaps at each, buckets that a query visits first.
DEPTH, SWAPS, FIRST = 8, 8, 1
BLOCK_BYTES = 16 << 20

_TERM_BYTES = np.arange(256, dtype=np.uint8)
_TERM_BYTES[[b for b in range(128) if not chr(b).isalnum()]] = ord(" ")
_TERM_BYTES[ord("A") : ord("Z") + 1] += 32
_TERM_BYTES = _TERM_BYTES.tobytes()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters from U+0080 on, with A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


def _grouped(texts: list[bytes], known: dict[bytes, int] | None = None):
    """Numbers of terms of each text; with `known`, also text, term and times of each known term of a text, in order."""
    split = [terms(x) for x in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((known.get(w, -1) for words in split for w in words), np.int64, int(n.sum()))
    row = np.repeat(np.arange(len(split)), n)
    row, ids = row[ids >= 0], ids[ids >= 0]
    pair, times = np.unique(row * len(known) + ids, return_counts=True)
    return n, pair // max(len(known), 1), pair % max(len(known), 1), times


def _lists(row: np.ndarray, n: int, values: np.ndarray, kind) -> pa.Array:
    """Values as n lists; row: the sorted number of each value's list."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (row, text) -> row, term, times."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [terms(x) for x in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(found)), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row, pa.int64())), pa.array([w for words in found for w in words], pa.binary())], ["row", "term"])

    return queries.select("row", text_bytes().alias("text")).mapInArrow(split, "row long, term binary").groupBy("row", "term").agg(F.count("*").alias("times"))


def counts_of(docs: DataFrame, vocabulary: list[bytes], key: str) -> DataFrame:
    """docs -> doc, n, terms (their numbers in the vocabulary), times: of each text with a term, whether or not it is one of these."""
    known = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(vocabulary)})
    kind = dict(docs.select(key).dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            n, row, term, times = _grouped(batch.column("text").to_pylist(), known.value)
            lists = [_lists(row, batch.num_rows, x, pa.int32()) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n), *lists], ["doc", "n", "terms", "times"]).filter(pa.array(n > 0))

    return docs.select(F.col(key).alias("doc"), text_bytes().alias("text")).mapInArrow(count, f"doc {kind}, n long, terms array<int>, times array<int>")


def _cost(degree: np.ndarray, size: int) -> np.ndarray:
    """Bits that the gaps between a term's documents take, about: `degree` of them among `size`."""
    return degree * np.log2(max(size, 1) / (degree + 1.0))


def halves(doc: np.ndarray, term: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The side of each of n documents after swaps, and the degree of each term on both sides. doc, term: the postings."""
    side = np.arange(n) >= (n + 1) // 2
    sizes = [int((~side).sum()), int(side.sum())]
    for last in range(SWAPS + 1):
        here = side[doc]
        degrees = [np.bincount(term[here == s], minlength=width).astype(np.float64) for s in (False, True)]
        if last == SWAPS:
            break
        now = _cost(degrees[0], sizes[0]) + _cost(degrees[1], sizes[1])
        to_right = now - _cost(np.maximum(degrees[0] - 1, 0), sizes[0]) - _cost(degrees[1] + 1, sizes[1])
        to_left = now - _cost(degrees[0] + 1, sizes[0]) - _cost(np.maximum(degrees[1] - 1, 0), sizes[1])
        gain = np.bincount(doc, np.where(here, to_left[term], to_right[term]), n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int(np.searchsorted(-(gain[left[:m]] + gain[right[:m]]), -1e-9))  # pairs fall, so those that gain come first
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side, degrees[0], degrees[1]


def _of_side(doc: np.ndarray, term: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The postings of the chosen documents, renumbered."""
    here = chosen[doc]
    return (np.cumsum(chosen) - 1)[doc[here]], term[here]


def bisected(doc: np.ndarray, term: np.ndarray, n: int, width: int, least: int = SHARD) -> list[np.ndarray]:
    """Documents 0 to n - 1 in the order of recursive graph bisection, cut into shards of at most `least`."""
    if n <= least:
        return [np.arange(n)]
    side, _, _ = halves(doc, term, n, width)
    out = []
    for chosen in (~side, side):
        own = np.flatnonzero(chosen)
        out += [own[part] for part in bisected(*_of_side(doc, term, chosen), len(own), width, least)]
    return out


def bisection_tree(doc: np.ndarray, term: np.ndarray, n: int, width: int, depth: int) -> np.ndarray:
    """For each node of a tree of the depth (root 1, children 2k and 2k + 1), what a term adds to the cost on the left less that on the right."""
    tree = np.zeros((1 << depth, width), np.float32)

    def grow(node: int, doc: np.ndarray, term: np.ndarray, n: int) -> None:
        if node >= 1 << depth or n < 2:
            return
        side, left, right = halves(doc, term, n, width)
        sizes = int((~side).sum()), int(side.sum())
        tree[node] = (_cost(left + 1, sizes[0]) - _cost(left, sizes[0])) - (_cost(right + 1, sizes[1]) - _cost(right, sizes[1]))
        for k, chosen in enumerate((~side, side)):
            grow(2 * node + k, *_of_side(doc, term, chosen), int(chosen.sum()))

    grow(1, doc, term, n)
    return tree


def _postings(lists) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each entry of a column of lists."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def into_buckets(counts: DataFrame, width: int) -> DataFrame:
    """counts (with row, a number of its own for each) -> the same of the documents with a known term, with bucket."""
    spark = counts.sparkSession
    counts = counts.where(F.size("terms") > 0)
    n = counts.count()
    most = max(1, (8 << 20) // max(width, 1)).bit_length() - 1  # the tree takes 32 MB at most
    depth = min(DEPTH, most, max(0, (max(n, 1) // BUCKET)).bit_length())
    spread = F.xxhash64("row", "doc")
    if depth:
        part = max(1, n // SAMPLE)
        sample = counts.where(F.pmod(spread, F.lit(part)) == 0).select("terms").toArrow()  # about SAMPLE rows whatever n is
        tree = spark.sparkContext.broadcast(bisection_tree(*_postings(sample.column("terms")), sample.num_rows, width, depth))

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, term = _postings(batch.column("terms"))
                node = np.ones(batch.num_rows, np.int64)
                for _ in range(depth):
                    node = 2 * node + (np.bincount(doc, tree.value[node[doc], term], batch.num_rows) > 0)
                yield batch.append_column("leaf", pa.array(node))

        counts = counts.mapInArrow(descend, ", ".join(f"{c} {t}" for c, t in [*counts.dtypes, ("leaf", "long")]))
    else:
        counts = counts.withColumn("leaf", F.lit(1).cast("long"))
    counts = save(counts, "leaves")
    parts = counts.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BUCKET)).alias("parts"))  # 256 rows at most
    bucket = F.col("leaf") * (1 << 40) + F.pmod(F.xxhash64("row", "doc", F.lit(1)), "parts")
    return counts.join(F.broadcast(parts), "leaf").withColumn("bucket", bucket).drop("parts", "leaf")


def index_of(bucketed: DataFrame, documents: int, length: int, width: int) -> DataFrame:
    """A row for each shard: bucket, shard, docs, starts, terms, impacts (the postings of each document in turn), top_terms, top_impacts."""
    kind = dict(bucketed.dtypes)["doc"]

    def build(table: pa.Table) -> pa.Table:
        doc, term = _postings(table.column("terms"))
        _, times = _postings(table.column("times"))
        size = 100 - 25 + (25 * table.column("n").to_numpy() * documents) // length
        impact = (1_000_000_000 * times) // (1000 * times + 12 * size[doc])
        starts = np.searchsorted(doc, np.arange(table.num_rows + 1))
        own, local = np.unique(term, return_inverse=True)
        shards = bisected(doc, local, table.num_rows, len(own))
        rows = []
        for k, members in enumerate(shards):
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in members])
            order = np.lexsort((-impact[at], term[at]))
            first = np.flatnonzero(np.diff(term[at][order], prepend=-1))
            rows.append((members, np.cumsum([0, *(starts[members + 1] - starts[members])]), term[at], impact[at], term[at][order][first], impact[at][order][first]))
        bounds = np.cumsum([0, *map(len, shards)])
        docs = table.column("doc").combine_chunks().take(pa.array(np.concatenate(shards)))
        ints = lambda j: pa.array([r[j] for r in rows], pa.list_(pa.int32()))
        return pa.table(
            {
                "bucket": pa.array([table.column("bucket")[0].as_py()] * len(rows), pa.int64()),
                "shard": pa.array(range(len(rows)), pa.int32()),
                "docs": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), docs),
                "starts": ints(1), "terms": ints(2), "impacts": ints(3), "top_terms": ints(4), "top_impacts": ints(5),
            }
        )

    lists = "array<int>, ".join(["starts ", "terms ", "impacts ", "top_terms ", "top_impacts "])
    return bucketed.groupBy("bucket").applyInArrow(build, f"bucket long, shard int, docs array<{kind}>, {lists}array<int>")


def _ascending(docs: pa.Array) -> np.ndarray:
    """The place of each document by ascending id, nulls last."""
    order = pd.Series(docs.to_pylist(), dtype=object if docs.null_count else None).sort_values(kind="stable", na_position="last").index.to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


class _Shard:
    """Postings of a shard by term."""

    def __init__(self, row: dict, first: int):
        starts = np.array(row["starts"])
        terms = np.array(row["terms"], np.int64)
        order = np.argsort(terms, kind="stable")
        self.first, self.n = first, len(starts) - 1
        self.doc = np.repeat(np.arange(self.n), np.diff(starts))[order]
        self.impact = np.array(row["impacts"], np.int64)[order]
        self.terms, self.at = np.unique(terms[order], return_index=True)
        self.at = np.append(self.at, len(terms))
        self.top = np.array(row["top_impacts"], np.int64)  # by term, as those are

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked terms are here, and their numbers here."""
        k = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        here = np.flatnonzero(self.terms[k] == asked)
        return here, k[here]

    def bound(self, asked: np.ndarray, weights: np.ndarray) -> int:
        here, k = self.find(asked)
        return int((weights[here] * self.top[k]).sum())

    def scores(self, asked: np.ndarray, weights: np.ndarray, exact: bool) -> np.ndarray:
        here, k = self.find(asked)
        n = self.at[k + 1] - self.at[k]
        at = np.arange(n.sum()) + np.repeat(self.at[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(k) else np.zeros(0, np.int64)
        part = np.repeat(weights[here], n) * self.impact[at]
        if exact:
            return np.bincount(self.doc[at], part, self.n).astype(np.int64)
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.doc[at], part)
        return out


def visit(index: DataFrame, visits: DataFrame, top: int) -> DataFrame:
    """visits (bucket, row, floor, asked, weights) -> row, doc, score: the best of each bucket that the row visits."""
    kind = dict(index.dtypes)["docs"].removeprefix("array<").removesuffix(">")

    def search(shards: pa.Table, queries: pa.Table) -> pa.Table:
        out_row, out_doc, out_score = [], [], []
        docs = pa.concat_arrays([x.values.slice(x.offset, 0) if not len(x) else x.flatten() for x in shards.column("docs").chunks]) if shards.num_rows else None
        if docs is not None and queries.num_rows:
            own, first = [], 0
            for row in shards.drop_columns(["docs"]).to_pylist():
                own.append(_Shard(row, first))
                first += own[-1].n
            place = _ascending(docs)
            for q in queries.to_pylist():
                asked, weights = np.array(q["asked"], np.int64), np.array(q["weights"], np.int64)
                exact = int(weights.sum()) * 1_000_000 < 1 << 53
                floor = q["floor"] or 1
                bounds = [s.bound(asked, weights) for s in own]
                best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for k in sorted(range(len(own)), key=lambda k: -bounds[k]):
                    if bounds[k] < floor:
                        break
                    got = own[k].scores(asked, weights, exact)
                    at = np.flatnonzero(got >= floor)
                    best_at, best = np.append(best_at, at + own[k].first), np.append(best, got[at])
                    if len(best) >= top:
                        order = np.lexsort((place[best_at], -best))[:top]
                        best_at, best = best_at[order], best[order]
                        floor = max(floor, int(best[-1]))
                out_row += [q["row"]] * len(best)
                out_doc.append(best_at)
                out_score.append(best)
        at = np.concatenate(out_doc) if out_doc else np.zeros(0, np.int64)
        found = docs.take(pa.array(at)) if docs is not None else shards.schema.field("docs").type.value_type
        found = found if isinstance(found, pa.Array) else pa.array([], found)
        return pa.table({"row": pa.array(out_row, pa.int64()), "doc": found, "score": pa.array(np.concatenate(out_score) if out_score else at, pa.int64())})

    return index.groupBy("bucket").cogroup(visits.groupBy("bucket")).applyInArrow(search, f"row long, doc {kind}, score long")


def _search_block(docs: DataFrame, queries: DataFrame, top: int, key: str) -> DataFrame | None:
    """row, doc, score, rank of the queries (row, text) of a block; None if no document has a term of theirs."""
    spark = docs.sparkSession
    asked = save(query_terms(queries), "asked")
    vocabulary = sorted(bytes(r["term"]) for r in asked.select("term").distinct().collect())  # at most the bytes of a block
    if not vocabulary:
        return None
    counts = save(counts_of(docs, vocabulary, key).withColumn("row", F.monotonically_increasing_id()), "counts")
    documents, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    degrees = counts.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("degree"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("degree") + 1))).cast("long")
    degrees = save(degrees.select("number", weight.alias("weight")), "weights")
    if degrees.isEmpty():
        return None
    index = save(index_of(into_buckets(counts, len(vocabulary)), documents, length, len(vocabulary)), "index")
    words = spark.createDataFrame(pd.DataFrame({"term": vocabulary, "number": np.arange(len(vocabulary), dtype=np.int32)}), "term binary, number int")
    weighed = asked.join(words, "term").join(degrees, "number").select("row", "number", (F.col("weight") * F.col("times")).alias("weight")).where("weight > 0")
    weighed = save(weighed, "weighed")
    tops = index.select("bucket", F.explode(F.arrays_zip("top_terms", "top_impacts")).alias("x")).groupBy("bucket", F.col("x.top_terms").alias("number")).agg(F.max("x.top_impacts").alias("impact"))
    bounds = weighed.join(tops, "number").groupBy("row", "bucket").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound"))
    by_bound = Window.partitionBy("row").orderBy(F.desc("bound"), "bucket")
    bounds = save(bounds.withColumn("turn", F.row_number().over(by_bound)), "bounds")
    per_row = weighed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("x"))
    per_row = save(per_row.select("row", F.col("x.number").alias("asked"), F.col("x.weight").alias("weights")), "queries")
    ranked = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best, done, upto = None, 0, FIRST
    while True:
        if best is None:
            left = bounds.withColumn("floor", F.lit(None).cast("long"))
        else:
            floor = best.groupBy("row").agg(F.when(F.count("*") >= top, F.min("score")).alias("floor"))
            left = bounds.where(F.col("turn") > done).join(floor, "row", "left").where("floor is null or bound >= floor")
            if left.isEmpty():
                return best
        now = left.where(F.col("turn") <= upto).select("bucket", "row", "floor").join(per_row, "row")
        now = save(now, "visits")
        found = visit(index.join(now.select("bucket").distinct(), "bucket", "left_semi"), now, top)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = save(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top), "best")
        done, upto = upto, 4 * upto + 1


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", query_key: str = "item_id") -> DataFrame:
    """query_key, rank, key, score: the `top` highest scores above 0 of each query."""
    spark = docs.sparkSession
    small_batches(spark)
    kinds = dict(queries.select(query_key).dtypes)[query_key], dict(docs.select(key).dtypes)[key]
    queries = save(queries.select(F.col(query_key).alias("item"), "text").withColumn("row", F.monotonically_increasing_id()), "items")
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    parts = [_search_block(docs, queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b), top, key) for b in range(blocks)]
    schema = f"{query_key} {kinds[0]}, rank int, {key} {kinds[1]}, score long"
    out = spark.createDataFrame([], schema)
    for part in parts:
        if part is not None:
            out = out.unionByName(part.join(queries, "row").select(F.col("item").alias(query_key), "rank", F.col("doc").alias(key), "score"))
    return out
