"""N-gram Jaccard self-join: a grouped prefix join on word shingles.

1. Every text becomes its set of 64-bit shingle hashes; equal sets are one class, held by
   its least id. Copies therefore never multiply pairs.
2. Shingles are ordered rarest first by a count sketch over all texts (a fixed number
   of counters; any fixed order gives right results, a good one gives few candidates). The
   prefix of a set of size n has its first n - ceil(0.75 n) + 1 shingles; two sets that
   link share a shingle of their prefixes. Classes with the same prefix and size are one group.
3. Star links: in each posting list one group's class is compared with the others. That
   joins most of a large group of near copies with a linear number of pairs.
4. The rest: group pairs that share a posting, pass the size and position filters and aren't wholly in one
   component yet are expanded to member pairs in different components, and all of these are
   verified. Pairs inside a component need no look, so the components are exact.

All shuffles are by shingle, class or id; arrays of hashes are read for verified classes only.

Defined cases: fewer words than a shingle make one shingle of the whole sequence; null and
empty texts have an empty set and link with nothing, as do rows with a null id; repeated rows get
equal results; rows that share an id but not a text are one vertex, linked by any of its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small_batches, small_side, text_bytes
from .components import components
from .hashing import by_bytes, mixed, word_hashes

K = 5
#: The threshold as a fraction: intersection * DEN >= NUM * union.
NUM, DEN = 3, 4
#: Counters of the sketch of shingle frequencies, and how many go into one row of it.
SKETCH, BLOCK = 1 << 20, 1 << 14
#: Posting lists are compared with the leaders under so many orders of their groups.
LEADERS = 4
#: Pairs with leaders that are verified for a group: those that share the most posting lists.
TRIED = 2
#: Least and most bits of the parity map of a set; between them it has as many as the set has shingles, to the next power of two.
LEAST_MAP, MOST_MAP = 1024, 1 << 16
#: A shingle is hot if its counter holds so many times the mean.
HOT = 16

_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    out = []
    for h in word_hashes(texts):
        k = min(K, len(h))
        total = np.full(len(h) - k + 1 if k else 0, k, np.uint64)
        for j in range(k):
            total = mixed(total * _SALT + h[j : len(h) - k + 1 + j])
        out.append(np.unique(total))
    return out


def _counters(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(SKETCH)).astype(np.int64)


def _sketcher(batches):
    counts = np.zeros(SKETCH, np.int64)
    for batch in by_bytes(batches):
        counts += np.bincount(_counters(np.concatenate(shingles(batch.column("text").to_pylist()))), minlength=SKETCH)
    for block in np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)):
        part = counts[block * BLOCK : (block + 1) * BLOCK]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["block", "counts"])


def _add_blocks(pdf):
    import pandas as pd

    total = sum(np.frombuffer(x, "<i8") for x in pdf["counts"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def sketch(texts: DataFrame) -> np.ndarray:
    """Counts of shingles over all texts (binary), by hash modulo SKETCH. Tasks and then groups of tasks add up first."""
    parts = texts.select("text").mapInArrow(_sketcher, "block int, counts binary")
    parts = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    parts = parts.groupBy("block", "part").applyInPandas(_add_blocks, "block int, counts binary")
    rows = parts.groupBy("block").applyInPandas(_add_blocks, "block int, counts binary").collect()  # SKETCH counters, whatever the input
    total = np.zeros(SKETCH, np.int64)
    for r in rows:
        total[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def _signature(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _parity(h: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of shingles fall to k. Two maps differ in at most as many bits as the sets do in shingles."""
    size = LEAST_MAP
    while size < min(len(h), MOST_MAP):
        size *= 2
    bits = np.bincount((h >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _halved(a: bytes, size: int) -> np.ndarray:
    """The map of the given size in bytes, from a larger one."""
    x = np.frombuffer(a, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _apart(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that are in one of two sets only, from their maps."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_halved(a, size) ^ _halved(b, size)).sum())


def _possible(batches):
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb")]
        # sets of n and m that link differ in at most (n + m) * (DEN - NUM) / (NUM + DEN) shingles
        keep = [_apart(x, y) * (NUM + DEN) <= (n + m) * (DEN - NUM) for n, m, x, y in zip(*columns)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def prefixes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n, sig (of the set), gsig (of size and prefix), map, prefix (hashes, rarest first), hot
    (the place in prefix from which shingles are in so many texts that their postings must be spread)."""
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    texts = docs.select("doc_id", text_bytes().alias("text"))
    counts = sketch(texts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, max(HOT * counts.mean(), 1000)))

    def maker(batches):
        counts, limit = shared.value
        for batch in by_bytes(batches):
            ns, sigs, gsigs, maps, hots, fixed = [], [], [], [], [], []
            for h in shingles(batch.column("text").to_pylist()):
                n = len(h)
                common = counts[_counters(h)]
                order = np.argsort(common, kind="stable")[: n - -(-NUM * n // DEN) + 1]
                ns.append(n)
                sigs.append(_signature(h))
                gsigs.append(_signature(np.append(h[order], np.uint64(n))))
                maps.append(_parity(h))
                hots.append(int(np.searchsorted(common[order], limit)))
                fixed.append(h[order].view(np.int64))
            columns = [pa.array(ns, pa.int64()), *(pa.array(x, pa.binary()) for x in (sigs, gsigs, maps)), pa.array(fixed, pa.list_(pa.int64())), pa.array(hots, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "sig", "gsig", "map", "prefix", "hot"])

    return texts.mapInArrow(maker, f"doc_id {id_type}, n long, sig binary, gsig binary, map binary, prefix array<long>, hot int")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and its set, for the ids wanted."""
    id_type = dict(docs.select("doc_id").dtypes)["doc_id"]

    def maker(batches):
        for batch in by_bytes(batches):
            sets = [h.view(np.int64) for h in shingles(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "set"])

    return docs.select("doc_id", text_bytes().alias("text")).join(ids, "doc_id", "left_semi").mapInArrow(maker, f"doc_id {id_type}, set array<long>")


def _linked(n: Column, m: Column, both: Column) -> Column:
    return both * DEN >= (n + m - both) * NUM


def verified(docs: DataFrame, maps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose sets link. maps: id, n, map. Only pairs whose maps don't rule it out have their sets read."""
    pairs = pairs.join(maps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("map").alias("ma")), "a")
    pairs = pairs.join(maps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("map").alias("mb")), "b")
    kind = dict(pairs.dtypes)["a"]
    pairs = save(pairs.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(_possible, f"a {kind}, b {kind}"), "pairs")
    ids = save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    sets = save(sets_of(docs, small_side(ids)), "sets")
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    linked = _linked(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")))
    return save(both.where(linked).select("a", "b").distinct(), "links")


def _sizes_fit(n: Column, m: Column) -> Column:
    """n <= m sizes of sets that can link."""
    return (n <= m) & (n * DEN >= m * NUM)


def join(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    rows = save(prefixes(docs), "prefixes")
    usable = rows.where("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "n", "gsig"))
    classes = save(usable.groupBy("sig").agg(least.alias("r")).select("sig", F.col("r.doc_id").alias("id"), "r.n", "r.gsig"), "classes")
    groups = save(classes.groupBy("gsig").agg(F.min("id").alias("gid")), "groups")
    members = save(classes.join(groups, "gsig").select("gid", "id", "n"), "members")
    maps = rows.join(small_side(classes.select(F.col("id").alias("doc_id"), "sig")), ["doc_id", "sig"], "left_semi")
    maps = save(maps.select(F.col("doc_id").alias("id"), "n", "map"), "maps")

    leads = groups.select(F.col("gid").alias("doc_id"), "gsig")
    postings = usable.select("doc_id", "gsig", "n", "prefix", "hot").join(small_side(leads), ["doc_id", "gsig"], "left_semi")
    postings = postings.select(F.col("doc_id").alias("gid"), F.col("n").cast("int").alias("n"), "hot", F.posexplode("prefix").alias("pos", "token"))
    postings = _shared(postings)
    linked = verified(docs, maps, _stars(postings, members))
    label = components(linked)

    members = save(members.join(label.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "members")
    more = verified(docs, maps, _rest(postings, members))
    label = components(linked.unionByName(more))
    named = classes.join(label, "id", "left").select("sig", F.coalesce("component", "id").alias("__component"))
    out = rows.select("doc_id", "n", "sig").join(named, "sig", "left")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("__component")).alias("component_id"))


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of shingles that more than one group has.

    Lists of ordinary shingles are counted after one shuffle. Those of hot ones are counted before it and joined back, so that AQE can split them.
    """
    columns = ["token", "gid", "n", "pos"]
    plain = postings.where("pos < hot").select(*columns, F.count("*").over(Window.partitionBy("token")).alias("c")).where("c > 1")
    hot = postings.where("pos >= hot").select(*columns)
    hot = hot.join(hot.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "token")
    return save(plain.select(*columns).unionByName(hot.select(*columns)), "postings")


def _leaders(postings: DataFrame) -> DataFrame:
    """token and its leaders: the group that shares most of its prefix (edits make shingles that no other has), and the first under some hash orders."""
    share = save(postings.groupBy("gid", "n").agg((F.count("*") / F.col("n")).alias("share")), "share")
    order = [-F.col("share"), *(F.xxhash64("gid", F.lit(k)) for k in range(1, LEADERS))]
    marked = postings.select("token", "gid", "n").join(small_side(share), ["gid", "n"])
    heads = marked.groupBy("token").agg(*[F.min(F.struct(x.alias("o"), "gid", "n")).alias(f"l{k}") for k, x in enumerate(order)])
    return heads.select("token", F.array_distinct(F.array(*[F.struct(F.col(f"l{k}.gid").alias("gid"), F.col(f"l{k}.n").alias("n")) for k in range(LEADERS)])).alias("leads"))


def _hopeful(met: DataFrame) -> DataFrame:
    """met: a row for each shingle (place i, j) that the prefixes of g (size n) and h (size m) share -> pairs that may link.

    Sets that link share `least` shingles, so one at a place from which least are left in both; such shingles only are
    counted. All other shared ones come after the last of these in both sets, which bounds the intersection.
    """
    least = F.ceil((F.col("n") + F.col("m")) * NUM / (NUM + DEN))
    met = met.where(_sizes_fit(F.least("n", "m"), F.greatest("n", "m")) & (F.col("n") - F.col("i") >= least) & (F.col("m") - F.col("j") >= least))
    met = met.groupBy("g", "h", "n", "m").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    return met.where(F.col("c") + F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1) >= least).select("g", "h")


def _stars(postings: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct pairs of a posting's group, or a group's member, with its leader."""
    across = postings.join(_leaders(postings), "token").select(F.col("gid").alias("g"), "n", F.explode("leads").alias("l")).where("g <> l.gid")
    across = across.where(_sizes_fit(F.least("n", "l.n"), F.greatest("n", "l.n"))).groupBy("g", F.col("l.gid").alias("h")).agg(F.count("*").alias("c"))
    best = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("c"), "h"))
    across = across.withColumn("k", best).where(F.col("k") <= TRIED)
    across = across.select(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"))
    within = members.where("gid <> id").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    return save(across.unionByName(within).distinct(), "stars")


def _rest(postings: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of classes in different components that share a group, or are in groups that pass the filters."""
    groups = save(members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "comps")
    marked = postings.select("token", "gid", "n", "pos").join(small_side(groups), "gid")
    mixed = marked.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("token")
    marked = save(marked.join(mixed, "token", "left_semi"), "mixed")
    x = marked.select("token", F.col("gid").alias("g"), "n", F.col("pos").alias("i"), "lo", "hi")
    y = marked.select("token", F.col("gid").alias("h"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    least = F.ceil((F.col("n") + F.col("m")) * NUM / (NUM + DEN))
    apart = ~((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2")))
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("g") < F.col("h")))
    early = (F.col("n") - F.col("i") >= least) & (F.col("m") - F.col("j") >= least)
    met = x.join(y, (x["token"] == y["token"]) & ordered & _sizes_fit(F.col("n"), F.col("m")) & early & apart)
    pairs = _hopeful(met.select("g", "h", "n", "m", "i", "j"))
    same = members.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    left = members.select(F.col("gid").alias("g"), F.col("id").alias("a"), F.col("comp").alias("ca"))
    right = members.select(F.col("gid").alias("h"), F.col("id").alias("b"), F.col("comp").alias("cb"))
    both = pairs.unionByName(same).join(left, "g").join(right, "h").where("ca <> cb")
    return save(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
