"""Byte-level BPE encoding and decoding with content-defined chunks that documents share.

A chunk ends where a rolling hash of `WINDOW` bytes is in the least of `SPREAD` parts of its range, so equal passages fall into equal chunks
wherever they stand. Digests of all chunks are counted into a bitmap of fixed size; texts of chunks whose bit says "maybe
again" are shuffled by digest, and each that occurs twice is encoded once. The others occur once, and are encoded where
they are. Then every document joins its chunks. Pre-tokens are found from left to right and look at most `Encoder.margin` characters
ahead, so from a pre-token's start that is right, a chunk's pre-tokens are right up to that far before its end. At each
joint the text from the last such start is encoded anew until a pre-token starts where one of the next chunk does; from there
the next chunk's ids hold. Where none does, the text that is encoded anew doubles, over as many chunks as that takes.

Encodings of shared chunks are joined to the texts that use them by digest, gathered per text (never more than the text has) and
joined to the documents; texts without a chunk that may be shared are not shuffled.

Pre-tokens of Latin texts are remembered by a worker; other texts go to the tokenizers library, whose ids and pre-tokens are used
as they are. Decoding puts the bytes of ids in a row and replaces what isn't UTF-8, as the library does.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded alike; rows without an id stay; a text
without a trigger is one chunk, however long; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from operator import sub
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches, text_bytes
from .hashing import STEP_BYTES, by_bytes

WINDOW = 24
SPREAD = 1024
_WORDS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (3, 2, 1)]
_MIX, _LEAST = np.uint64(0x9FB21C651E98DF25), np.uint64((1 << 64) // SPREAD)
#: Bits of the map of digests that may occur again: 2^MAP_BITS of them, 32 MB.
MAP_BITS = 28
#: First and last pre-token starts that are kept of a shared chunk; characters of the next chunk that a joint first looks at.
EDGE, AHEAD = 12, 48
#: Pre-tokens that a worker remembers.
KNOWN = 300_000

# The pre-tokens of the tokenizer for characters that all Unicode versions class alike (Latin ones, with classes written out).
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-į", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_LATIN = re.compile("[\t\n\r -~¡-į]*")

_encoders: dict = {}


class Chunk(NamedTuple):
    """Ids (little-endian, unsigned, 32 bits), and where pre-tokens start or end: characters, and ids before there. 0 and the whole length are among them."""

    ids: bytes
    places: np.ndarray
    counts: np.ndarray

    def edges(self) -> Chunk:
        """The same ids with the first and last places only."""
        at = np.unique(np.concatenate([np.arange(len(self.places))[:EDGE], np.arange(len(self.places))[-EDGE:]]))
        return Chunk(self.ids, self.places[at], self.counts[at])


def _places(lengths, n: int) -> np.ndarray:
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(lengths, np.int64, n), out=out[1:])
    return out


class Encoder:
    """Ids of texts with the starts of their pre-tokens, and bytes of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile("|".join(map(re.escape, added.values()))) if added else None
        #: A pre-token is decided by no more than so many characters behind its start or end.
        self.margin = max([3, *map(len, added.values())]) + 2
        self.parts: dict[str, bytes] = {}
        self.bytes_of = self._bytes_of(added)
        self.stored = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"
        self.led = np.array([x[:1] == b" " for x in self.bytes_of])  # ids that begin with a space

    def _bytes_of(self, added: dict[int, str]) -> list[bytes]:
        """The alphabet of byte-level BPE: printable Latin-1 characters stand for themselves, other bytes for those from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            out[k] = token.encode() if k in added or not all(c in byte for c in token) else bytes(byte[c] for c in token)
        return out

    def encode(self, text: str) -> Chunk:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[Chunk]:
        known = self.parts
        if len(known) > KNOWN:
            known.clear()
        found = [_PARTS.findall(x) if _LATIN.fullmatch(x) and not (self.added and self.added.search(x)) else None for x in texts]
        ids = [None if parts is None else list(map(known.get, parts)) for parts in found]
        lacking = [(parts, i, [k for k, x in enumerate(i) if x is None]) for parts, i in zip(found, ids) if i and None in i]
        if lacking:
            self._learn(list({parts[k] for parts, _, at in lacking for k in at}))
            for parts, i, at in lacking:
                for k in at:
                    i[k] = known[parts[k]]
        return [self._by_library(x) if parts is None else self._chunk(len(x), parts, i) for x, parts, i in zip(texts, found, ids)]

    def _chunk(self, length: int, parts: list[str], ids: list[bytes]) -> Chunk:
        """Of many pre-tokens only the places of the first and last are found."""
        data = b"".join(ids)
        if len(parts) <= 2 * EDGE:
            return Chunk(data, _places(map(len, parts), len(parts)), _places(map(len, ids), len(ids)) >> 2)
        chars = [0, *accumulate(map(len, parts[:EDGE])), *list(accumulate(map(len, parts[: -EDGE - 1 : -1]), sub, initial=length))[::-1]]
        counts = [0, *accumulate(map(len, ids[:EDGE])), *list(accumulate(map(len, ids[: -EDGE - 1 : -1]), sub, initial=len(data)))[::-1]]
        return Chunk(data, np.array(chars), np.array(counts) >> 2)

    def _by_library(self, text: str) -> Chunk:
        whole = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in whole.word_ids], np.int64)
        last = np.flatnonzero(np.append(words[1:] != words[:-1], True)) if len(words) else np.zeros(0, np.int64)
        ends = np.maximum.accumulate(np.array([e for _, e in whole.offsets], np.int64))
        first = np.zeros(1, np.int64)
        return Chunk(np.array(whole.ids, "<u4").tobytes(), np.append(first, ends[last]), np.append(first, last + 1))

    def _learn(self, parts: list[str]) -> None:
        """Remembers the ids of pre-tokens. Those led by a space have no other, so many go as one text that falls apart at its spaces."""
        led = [p for p in parts if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        for at in range(0, len(led), 512):
            now = led[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(now)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [*(np.flatnonzero(self.led[ids]) * 4).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.parts.update(zip(now, [data[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        rest = [p for p in parts if not (p[0] == " " and len(p) > 1 and not p[1].isspace())]
        if rest:
            ids = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self.parts.update(zip(rest, ids, strict=True))

    def pack(self, chunk: Chunk) -> tuple[bytes, bytes]:
        """A chunk to be stored; its ids take two bytes each if the vocabulary allows that."""
        ids = np.frombuffer(chunk.ids, "<u4").astype(self.stored)
        return ids.tobytes(), np.stack([chunk.places, chunk.counts]).astype("<i4").tobytes()

    def unpack(self, ids: bytes, places: bytes) -> Chunk:
        pair = np.frombuffer(places, "<i4").astype(np.int64).reshape(2, -1)
        return Chunk(np.frombuffer(ids, self.stored).astype("<u4").tobytes(), pair[0], pair[1])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def triggers(data: bytes) -> np.ndarray:
    """Ends of windows whose rolling hash is in the least of SPREAD parts: a polynomial of the window's three 8-byte words, rolled over every byte."""
    found = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), STEP_BYTES):
        part = data[at : at + STEP_BYTES + WINDOW - 1]
        for phase in range(8):  # words that start at a byte of this remainder
            words = np.frombuffer(part, "<u8", (len(part) - phase) // 8, phase)
            if len(words) > 2:
                rolled = (words[:-2] * _WORDS[0] + words[1:-1] * _WORDS[1] + words[2:] * _WORDS[2]) * _MIX
                found.append(np.flatnonzero(rolled < _LEAST) * 8 + (at + phase + WINDOW))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text. A trigger less than a window behind another doesn't count, so a run of one character isn't cut to pieces; a cut is at a character's start."""
    whole = b"".join(texts)
    ends = _places(map(len, texts), len(texts))
    out = []
    padded = np.frombuffer(whole + bytes(4), np.uint8)
    cuts = triggers(whole)
    for k, text in enumerate(texts):
        lo, hi = ends[k], ends[k + 1]
        own = cuts[np.searchsorted(cuts, lo + WINDOW) : np.searchsorted(cuts, hi)]
        own = own[np.diff(own, prepend=-WINDOW) >= WINDOW]
        for _ in range(3):
            own = own + ((padded[own] & 0xC0) == 0x80)
        own = [0, *np.unique(own[own < hi] - lo).tolist(), hi - lo]
        out.append([text[a:b] for a, b in zip(own, own[1:])])
    return out


def joined(encoder: Encoder, text: str, starts: np.ndarray, encoded: list[Chunk]) -> bytes:
    """Ids of a text from those of its chunks; starts: where these start, and the end of the text."""
    out = []
    chunk, first, end, after = encoded[0], 0, int(starts[1]), 1  # the chunk at hand starts at `first`; the next one is number `after`
    s = t = 0  # its ids from number t, which stands at character s, are right
    while after < len(encoded):
        k = int(np.searchsorted(chunk.places, end - first - encoder.margin, "right")) - 1
        p, tp = (int(chunk.places[k]), int(chunk.counts[k])) if k >= 0 and chunk.places[k] >= s else (s, t)
        out.append(chunk.ids[4 * t : 4 * tp])
        begin, following, far = first + p, encoded[after], int(starts[after + 1])
        most, ahead = min(far + encoder.margin, len(text)), AHEAD
        while True:
            upto = min(end + ahead, most)
            anew = encoder.encode(text[begin:upto])
            sound = upto - begin if upto == len(text) else upto - begin - encoder.margin
            lo, hi = np.searchsorted(anew.places, end - begin), np.searchsorted(anew.places, min(sound, far - begin), "right")
            places = anew.places[lo:hi] - (end - begin)
            at = np.minimum(np.searchsorted(following.places, places), len(following.places) - 1)
            agree = np.flatnonzero(following.places[at] == places)
            if len(agree) or upto == most:
                break
            ahead *= 4
        if len(agree):
            out.append(anew.ids[: 4 * int(anew.counts[lo + agree[0]])])
            chunk, first, end, after = following, end, far, after + 1
            s, t = int(places[agree[0]]), int(following.counts[at[agree[0]]])
        else:  # no start agrees: what follows is encoded anew, twice as much each time
            last = int(np.searchsorted(starts, begin + 2 * (far - begin)))
            last = min(max(last, after + 1), len(encoded))
            chunk, first, end, after = encoder.encode(text[begin : starts[last]]), begin, int(starts[last]), last
            s = t = 0
    out.append(chunk.ids[4 * t :])
    return b"".join(out)


def _digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _repeated(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the digests that occur more than once, and the number of its bits less one; up to 2^MAP_BITS bits, 64 for each such digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [_short(_digest(c)) for parts in chunks(batch.column("text").to_pylist()) for c in parts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["digest"])

    again = rows.mapInArrow(digests, "digest long").groupBy("digest").agg(F.count("*").alias("times")).where("times > 1").select("digest")
    again = save(again, "repeated")
    bits = min(MAP_BITS, max(15, (64 * again.count()).bit_length()))
    mask = (1 << bits) - 1
    bit = F.col("digest").bitwiseAND(mask) + 1  # Spark numbers bits from 1
    parts = again.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        at = (r["part"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - at]
    return out, mask


def _shared(rows: DataFrame, bitmap, mask: int, tokenizer: str) -> DataFrame:
    """digest, ids, places: each chunk that the bitmap has, encoded once."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in by_bytes(batches):
            new = {}
            for parts in chunks(batch.column("text").to_pylist()):
                for c in parts:
                    d = _digest(c)
                    if d not in seen and _has(bitmap.value, mask, d):
                        new[d] = c
            seen = seen | set(new) if len(seen) < KNOWN else set(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["digest", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in by_bytes(batches):
            found = encoder.encode_all([x.decode() for x in batch.column("text").to_pylist()])
            ids, places = zip(*[encoder.pack(c.edges()) for c in found])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(ids, pa.binary()), pa.array(places, pa.binary())], ["digest", "ids", "places"])

    once = rows.mapInArrow(texts, "digest binary, text binary").groupBy("digest").agg(F.any_value("text").alias("text"))
    return save(once.mapInArrow(encode, "digest binary, ids binary, places binary"), "chunks")


def _has(bitmap: np.ndarray, mask: int, digest: bytes) -> bool:
    bit = _short(digest) & mask
    return bool(bitmap[bit >> 3] >> (bit & 7) & 1)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, ids (little-endian, unsigned, 32 bits), n_chunks, n_shared (chunks whose ids come from another place)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.select(key).dtypes)[key]
    rows = docs.select(text_bytes().alias("text"))
    found, mask = _repeated(rows)
    bitmap = spark.sparkContext.broadcast(found)
    shared = _shared(rows, bitmap, mask, tokenizer)
    docs = docs.select(F.col(key).alias("key"), text_bytes().alias("text"))

    def encoder_of(apart: bool):
        """apart: only texts without a chunk that may be shared."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(tokenizer)
            for batch in by_bytes(batches):
                texts = batch.column("text").to_pylist()
                owned = batch.column("known").to_pylist() if "known" in batch.schema.names else [None] * len(texts)
                at, ids, n, reused, kept = [], [], [], [], []
                for k, (text, parts, own) in enumerate(zip(texts, chunks(texts), owned)):
                    digests = [_digest(c) for c in parts]
                    if apart and any(_has(bitmap.value, mask, d) for d in digests):
                        continue
                    there = {x["digest"]: encoder.unpack(x["ids"], x["places"]) for x in own} if own else {}
                    at.append(k)
                    kept.append((text.decode(), [c.decode() for c in parts], [there.get(d) for d in digests]))
                new = iter(encoder.encode_all([x for _, strings, found in kept for x, c in zip(strings, found) if c is None]))
                for text, strings, found in kept:
                    n.append(len(found))
                    reused.append(sum(c is not None for c in found))
                    found = [next(new) if c is None else c for c in found]
                    ids.append(joined(encoder, text, _places(map(len, strings), len(strings)), found))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), pa.array(ids, pa.binary()), pa.array(n, pa.int32()), pa.array(reused, pa.int32())], [key, "ids", "n_chunks", "n_shared"])

        return run

    schema = f"{key} {kind}, ids binary, n_chunks int, n_shared int"
    return docs.mapInArrow(encoder_of(True), schema).unionByName(_with_chunks(docs, shared, bitmap, mask).mapInArrow(encoder_of(False), schema))


def _with_chunks(docs: DataFrame, shared: DataFrame, bitmap, mask: int) -> DataFrame:
    """key, text and known (digest, ids and places of each shared chunk) of the texts that have a chunk that may be shared. Equal texts are looked up once."""

    def uses_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            row, digests = [], []
            for k, parts in enumerate(chunks(batch.column("text").to_pylist())):
                found = {d for d in map(_digest, parts) if _has(bitmap.value, mask, d)}
                row += [k] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([batch.column("whole").take(pa.array(row, pa.int32())), pa.array(digests, pa.binary())], ["whole", "digest"])

    def using(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            hit = [any(_has(bitmap.value, mask, _digest(c)) for c in parts) for parts in chunks(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(hit, pa.bool_()))

    docs = docs.withColumn("whole", F.md5("text"))
    uses = docs.select("whole", "text").mapInArrow(uses_of, "whole string, digest binary").distinct()
    known = uses.join(shared, "digest").groupBy("whole").agg(F.collect_list(F.struct("digest", "ids", "places")).alias("known"))
    known = save(known, "known")  # so that the join is dealt by itself, and a text that many rows share can be split
    return docs.mapInArrow(using, docs.schema).join(known, "whole", "left").select("key", "text", "known")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (ids, and other columns) -> the same with the text of the ids as decoded."""

    def decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in by_bytes(batches, "ids", 4 * STEP_BYTES):
            yield batch.append_column("decoded", pa.array([encoder.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string()))

    return encoded.mapInArrow(decoder, ", ".join(f"`{c}` {t}" for c, t in [*encoded.dtypes, ("decoded", "string")]))
