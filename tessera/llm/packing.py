"""Best-fit packing with large-item matching, planned on a histogram.

Documents become token ids; only those longer than the capacity are cut.
Items of equal length are interchangeable, so the packing is planned on the
histogram of lengths (never more entries than the capacity has tokens, however
many documents there are). Items above a third of the capacity are matched
greedily, at most two to a bin; the rest go, longest first, to the smallest gap that
holds them. The plan is a list of runs "ranks r in [lo, hi) of length L sit in bins
first + (r - lo) // per at place + ((r - lo) % per) * L", and each piece finds
its run by its rank among pieces of its length. Ranks come from counts by
(length, hash bucket), so even a length that a third of all pieces share is spread.

Defined cases: a null text is an empty one and has the end token alone; empty
tables give no rows; repeated rows are packed as often as they occur; ties of
length are ranked by hash bucket (of the whole piece, so rows without an id are spread too), then id and piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from math import isqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches, text_bytes
from .hashing import by_bytes

CAPACITY = 4096
END = 1
#: Words, and pre-tokens, whose ids a worker remembers.
KNOWN_WORDS, KNOWN_PARTS = 200_000, 300_000

# The pre-tokens of word_bpe_49k.json or a space, and characters for which all Unicode versions class letters and numbers alike.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")
_LATIN = regex.compile("[ -~\u00a1-\u012f]+")

_GAP_ID = 0xFFFFFFFF
_GAP = _GAP_ID.to_bytes(4, "little")

_tokenizers: dict = {}


class _Encoder:
    """Token ids of white-space separated words, as bytes. The pre-tokenizer drops white space and never joins over it, so
    the ids of a text are those of its words in order; likewise those of a word are those of its pre-tokens, of which there are fewer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a pre-token
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 256):
            some = parts[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(cuts) == len(some) + 1:
                data = ids.tobytes()
                self.parts.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self.parts.update(zip(some, self._plain(some)))

    def _by_parts(self, text: str) -> list[bytes]:
        """Ids of the words of a text in which they are parted by single spaces."""
        found = _PARTS.findall(text.lower())
        if len(self.parts) > KNOWN_PARTS:
            self.parts.clear()
        self.parts[" "] = _GAP
        self._learn_parts([p for p in set(found) if p not in self.parts])
        data = b"".join(map(self.parts.__getitem__, found))
        gaps = np.flatnonzero(np.frombuffer(data, "<u4") == _GAP_ID) * 4
        cuts = zip([0, *(gaps + 4).tolist()], [*gaps.tolist(), len(data)])
        return [data[a:b] for a, b in cuts]

    def _ids_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that aren't remembered. Words of Latin characters go by pre-token, others whole."""
        if not words:
            return {}
        text = b" ".join(words).decode("utf-8", "replace")
        if _LATIN.fullmatch(text) and "<|" not in text:
            return dict(zip(words, self._by_parts(text)))
        texts = [w.decode("utf-8", "replace") for w in words]
        latin = [bool(_LATIN.fullmatch(t)) and "<|" not in t for t in texts]
        out = self._ids_of([w for w, x in zip(words, latin) if x])
        rest = [w for w, x in zip(words, latin) if not x]
        out.update(zip(rest, self._plain([t for t, x in zip(texts, latin) if not x])))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        known = self.words
        new = self._ids_of(list({w for words in split for w in words if w not in known}))
        if len(known) + len(new) <= KNOWN_WORDS:
            known.update(new)
            new = {}
        if not new:
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([known.get(w) or new.get(w, b"") for w in words]) for words in split]


def _encoder(path: str) -> _Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = _Encoder(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, codec: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    With a codec of Arrow's (such as "zstd") the ids of each piece are compressed by it; see `plain_ids`.
    """
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    end = np.array([END], "<u4").tobytes()

    def cutter(batches):
        encoder = _encoder(tokenizer)
        for batch in by_bytes(batches):
            row, piece, data = [], [], []
            for k, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    row.append(k)
                    piece.append(n)
                    data.append(ids[at : at + 4 * capacity])
            length = [len(x) // 4 for x in data]
            if codec:
                data = [pa.compress(x, codec=codec, asbytes=True) for x in data]
            piece = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece),
                    pa.array(piece.astype(np.int64) * capacity),
                    pa.array(length, pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(cutter, f"doc_id {id_type}, piece int, start long, length long, ids binary")


def plain_ids(pieces: DataFrame, codec: str) -> DataFrame:
    """Pieces whose ids `tokenize` has compressed -> the same rows and columns with plain ids."""
    at = pieces.columns.index("ids")

    def expander(batches):
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            data = [pa.decompress(x, 4 * n, codec=codec, asbytes=True) for x, n in zip(batch.column("ids").to_pylist(), lengths)]
            yield batch.set_column(at, "ids", pa.array(data, pa.binary()))

    return pieces.mapInArrow(expander, pieces.schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, lo, hi, first bin, per bin, place) that pack every item of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("items must be from 1 to the capacity long")
    used: dict[int, int] = defaultdict(int)
    runs, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first bin, bins)]

    def put(n: int, count: int, first: int, per: int, place: int) -> None:
        runs.append((n, used[n], used[n] + count, first, per, place))
        used[n] += count
        left[n] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1  # the longest that fits beside it
        b = large[k] if k >= 0 else None
        if b == a and left[a] < 2:
            k -= 1
            b = large[k] if k >= 0 else None
        if b is None:
            count = left[a] if a + large[0] > capacity else 1
            put(a, count, bins, 1, 0)
            gaps[capacity - a].append((bins, count))
        elif b == a:
            count = left[a] // 2
            put(a, 2 * count, bins, 2, 0)
            gaps[capacity - 2 * a].append((bins, count))
        else:
            count = min(left[a], left[b])
            put(a, count, bins, 1, 0)
            put(b, count, bins, 1, a)
            gaps[capacity - a - b].append((bins, count))
        bins += count
        large = [n for n in large if left[n]] if not left[a] or b is not None and not left[b] else large
    open_gaps = sorted(g for g in gaps if g)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):
                per = capacity // n
                count = -(-left[n] // per)
                gap, (first, count), place = capacity, (bins, count), 0
                bins += count
            else:
                gap = open_gaps[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(k)
                place, per = capacity - gap, gap // n
            whole = min(count, left[n] // per)
            if whole:
                put(n, whole * per, first, per, place)
                _reopen(gaps, open_gaps, gap - per * n, first, whole)
            if whole < count:
                rest = left[n]
                if rest:
                    put(n, rest, first + whole, rest, place)
                    _reopen(gaps, open_gaps, gap - rest * n, first + whole, 1)
                _reopen(gaps, open_gaps, gap, first + whole + bool(rest), count - whole - bool(rest))
    return runs


def _reopen(gaps, open_gaps, gap: int, first: int, count: int) -> None:
    if gap and count:
        if not gaps[gap]:
            insort(open_gaps, gap)
        gaps[gap].append((first, count))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...) -> the same rows with sequence_id and offset. Pieces are evaluated once."""
    spark = pieces.sparkSession
    pieces = save(pieces, "pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("__n"))
    histogram = {r["length"]: r["__n"] for r in counts.collect()}  # capacity rows at most
    # a length of n pieces is ranked in about sqrt(n) buckets of about sqrt(n) pieces, so no task gets all of a frequent one
    buckets = spark.createDataFrame([(n, isqrt(c) + 1) for n, c in histogram.items()], "length long, __buckets long")
    pieces = pieces.join(F.broadcast(buckets), "length")
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "__buckets"]), "__buckets")).drop("__buckets")
    sizes = pieces.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    by_rank = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("__rank", F.row_number().over(by_rank) - 1).join(sizes, ["length", "__bucket"])
    by_length: dict[int, list] = defaultdict(list)
    for run in plan(histogram, capacity):
        by_length[run[0]].append(run[1:])
    shared = spark.sparkContext.broadcast({n: np.array(x, np.int64) for n, x in by_length.items()})

    def placer(batches):
        runs = shared.value
        for batch in batches:
            n = batch.num_rows
            seq, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
            length, rank, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank", "__before"))
            rank = rank + before
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if n else []:
                size = length[at[0]]
                lo, _, first, per, start = runs[int(size)][np.searchsorted(runs[int(size)][:, 0], rank[at], "right") - 1].T
                seq[at] = first + (rank[at] - lo) // per
                place[at] = start + (rank[at] - lo) % per * size
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(seq), pa.array(place)], [*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c != "__bucket"]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*kept).dtypes)
    return ranked.select(*kept, "__bucket", "__rank", "__before").mapInArrow(placer, f"{schema}, sequence_id long, offset long")
