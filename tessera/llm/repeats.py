"""Repeated passages by prefix-free parsing.

A 400-byte string is repeated if it also starts anywhere else. The trigger of a string is the
place of its least rolling hash of 32 bytes, so it depends on the string alone, and equal strings
have it at the same offset. Along a text the trigger stays for a run of starts; cut by the
distance from start to trigger, these runs are the phrases of the parse. All strings of a phrase
share a core, and the phrase as a whole (core and what its strings reach) is its content.

Phrases meet by core:
- equal phrases are repeated as a whole: the dictionary has the phrase twice;
- a core that occurs once isn't repeated;
- phrases with the same core but other contents (the ends of longer matches) are resolved
  string by string, which needs the text of their documents only.
The order of single suffixes, one row a byte, isn't made: cores of 337 bytes and more leave few strings to look at
(the README says what that means for the method named). Counts by core, content and string are combined
before their shuffle and joined back, so that a core of very many documents is no group of one task: AQE can split
the join. Strings are compared by hashes of 64 bits for core and 64 for content or string, both needed.

Defined cases: null texts are empty; texts under 400 bytes lose nothing; an emptied text has the
digest of nothing; repeated rows repeat each other's strings; rows with a null id are documents too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches, text_bytes
from .hashing import Hashes, by_bytes, mixed

LENGTH = 400
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: Starts of a phrase reach over at most so many distances to the trigger.
STEP = 64
#: Starts that are looked at in one numpy step.
CHUNK = 1 << 19

_PLACE = np.uint64((1 << 20) - 1)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of x."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def phrases(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """core, content, first and last start of every phrase of a text of 400 bytes or more."""
    hashes = Hashes(data)
    grams = hashes.grams(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    trigger = (_least((grams & ~_PLACE) | place, GRAMS) & _PLACE).astype(np.int64)
    step = (trigger - np.arange(len(trigger))) // STEP
    new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(step) != 0)) + 1
    lo = np.concatenate([[0], new])
    hi = np.concatenate([new - 1, [len(trigger) - 1]])
    at, q = trigger[lo], step[lo]
    core = hashes.of(at - q * STEP, at - (q + 1) * STEP + 1 + LENGTH)
    core = mixed(core + q.astype(np.uint64) * _SALT)
    shape = ((at - lo) * LENGTH + (at - hi)).astype(np.uint64)
    content = mixed(hashes.of(lo, hi + LENGTH) + shape * _SALT)
    return core, content, lo, hi


def _phrases_of(text: bytes):
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        core, content, lo, hi = phrases(data[at : at + CHUNK + LENGTH - 1])
        yield core, content, lo + at, hi + at


def _parser(batches):
    for batch in by_bytes(batches):
        rids = batch.column("rid").to_numpy()
        parts, owner = [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            for found in _phrases_of(text):
                parts.append(found)
                owner.append(np.full(len(found[0]), rids[k]))
        if not parts:
            continue
        core, content, lo, hi = (np.concatenate(x) for x in zip(*parts))
        rid = np.concatenate(owner)
        order = np.lexsort((content, core))
        core, content, lo, hi, rid = (x[order] for x in (core, content, lo, hi, rid))
        first = np.concatenate([[True], (core[1:] != core[:-1]) | (content[1:] != content[:-1])])
        heads, more = np.flatnonzero(first), np.flatnonzero(~first)
        counts = np.diff(np.append(heads, len(core)))
        offsets = np.concatenate([[0], np.cumsum(counts - 1)]).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array(x[more]) for x in (rid, lo, hi)], ["rid", "lo", "hi"])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x[heads].view(np.int64)) for x in (core, content, rid, lo, hi)), pa.ListArray.from_arrays(pa.array(offsets), rest)],
            ["core", "content", "rid", "lo", "hi", "more"],
        )


def _strings(batches):
    """rid, text, cells -> one row for each string of the phrases named in cells."""
    for batch in by_bytes(batches):
        out = []
        for rid, text, cells in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("cells").to_pylist()):
            data = np.frombuffer(text, np.uint8)
            cells = sorted(cells, key=lambda c: c["lo"])
            for base in range(0, len(data), CHUNK):
                own = [c for c in cells if base <= c["lo"] < base + CHUNK]
                if own:
                    hashes = Hashes(data[base : base + CHUNK + 2 * LENGTH])
                    n = np.array([c["hi"] - c["lo"] + 1 for c in own])
                    at = np.repeat([c["lo"] for c in own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    string = mixed(hashes.of(at - base, at - base + LENGTH))
                    out.append((np.repeat([c["core"] for c in own], n), string.view(np.int64), np.full(len(at), rid), at, np.repeat([c["witness"] for c in own], n)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["core", "string", "rid", "at", "witness"])


def spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings whose starts are in the (first, last) ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def _cutter(batches):
    for batch in by_bytes(batches):
        texts, found = [], []
        for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
            runs = spans([(s["lo"], s["hi"]) for s in starts])
            cuts = [0, *(x for run in runs for x in run), len(text)]
            texts.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            found.append([{"start": a, "end": b} for a, b in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(found, kind), pa.array(texts, pa.binary())], ["rid", "spans", "kept"])


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, whole, cut): rows has doc_id, rid, n_bytes and text_sha256 of every row of docs; whole has the rid of each text
    that is repeated from end to end; cut has rid, the removed spans and the kept bytes of each other text that loses some."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("string"), text_bytes()).alias("rid"), text_bytes().alias("text"))
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), text_bytes()).alias("rid"), F.octet_length(text_bytes()).cast("long").alias("n_bytes"), F.sha2(text_bytes(), 256).alias("text_sha256"))
    rows = save(rows, "rows")

    more = "array<struct<rid:long,lo:long,hi:long>>"
    parse = lambda: texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_parser, f"core long, content long, rid long, lo long, hi long, more {more}")
    times = F.sum(F.size("more") + 1)
    cores = parse().groupBy("core").agg(F.min("content").alias("least"), F.max("content").alias("most"), times.alias("n")).where("n > 1")
    cores = save(cores.select("core", (F.col("least") != F.col("most")).alias("mixed")), "cores")
    found = save(parse().join(cores, "core"), "phrases")
    # among cores with several contents: how often each has occurred, and one phrase that stands for it
    same = found.where("mixed").groupBy("core", "content").agg(times.alias("n"), F.min(F.struct("rid", "lo")).alias("first"))
    told = found.where("mixed").join(save(same, "contents"), ["core", "content"])
    told = told.select(*found.columns, (F.col("n") > 1).alias("repeated"), (F.struct("rid", "lo") == F.col("first")).alias("head"))
    found = found.where("not mixed").select("*", F.lit(True).alias("repeated"), F.lit(False).alias("head")).unionByName(told)

    sure = found.where("repeated").select(F.explode(F.concat(F.array(F.struct("rid", "lo", "hi")), "more")).alias("s")).select("s.*")
    sure = save(sure.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "sure")
    sizes = rows.groupBy("rid").agg(F.first("n_bytes").alias("n_bytes"))
    reach = F.aggregate(F.array_sort("starts"), F.lit(0).cast("long"), lambda r, s: F.when(s["lo"] <= r, F.greatest(r, s["hi"] + LENGTH)).otherwise(r))
    whole = save(sure.select("rid", reach.alias("reach")).join(sizes, "rid").where("reach >= n_bytes").select("rid"), "whole")

    cells = found.where("mixed and (not repeated or head)")
    cells = cells.select("rid", F.struct("lo", "hi", "core", F.col("repeated").alias("witness")).alias("c")).groupBy("rid").agg(F.collect_list("c").alias("cells"))
    part = sure.join(whole, "rid", "left_anti").select("rid").union(cells.select("rid")).distinct()
    involved = save(texts.join(part, "rid", "left_semi").dropDuplicates(["rid"]), "texts")
    strings = involved.join(cells, "rid").select("rid", "text", "cells").mapInArrow(_strings, "core long, string long, rid long, at long, witness boolean")
    strings = save(strings, "strings")
    twice = strings.groupBy("core", "string").agg(F.count("*").alias("n"), F.bool_and("witness").alias("known")).where("n > 1 and not known").select("core", "string")
    strings = strings.where("not witness").join(twice, ["core", "string"])
    late = strings.select("rid", F.struct(F.col("at").alias("lo"), F.col("at").alias("hi")).alias("s")).groupBy("rid").agg(F.collect_list("s").alias("starts"))
    starts = sure.join(whole, "rid", "left_anti").unionByName(late.join(whole, "rid", "left_anti"))
    starts = starts.groupBy("rid").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = involved.join(starts, "rid").mapInArrow(_cutter, "rid long, spans array<struct<start:long,end:long>>, kept binary")
    return rows, whole, cut


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs, and whether anything of it was removed."""
    rows, whole, cut = repeated(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cut = cut.select("rid", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    nothing = hashlib.sha256(b"").hexdigest()
    gone = whole.select("rid", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"))
    out = rows.join(cut.unionByName(gone), "rid", "left")
    lost = F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes"))
    return out.select(
        "doc_id", "n_bytes", lost.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"), (lost > 0).alias("has_repeats"),
    )
