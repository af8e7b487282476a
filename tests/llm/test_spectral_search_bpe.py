"""Whitening, ranked search and BPE against brute force, with nulls, ties, long texts, repeated rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, ranked_search, whitening

VECTORS = "vec_id long, embedding array<float>, label int, component int"
DOCS = "doc_id long, text string, score int, rank int"
ODD = [(901, ""), (902, None), (903, " \n\t--"), (904, "lorem " * 20_000), (905, "Ärger ärger STRASSE straße"), (905, "Ärger ärger STRASSE straße"), (None, "lorem ipsum"), (906, "字字 字"), (907, "a\u0000b C_d")]


def whitened(c):
    x = np.floor(1024 * c.astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return centred @ u / np.sqrt(e), e / np.trace(v), [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]


@pytest.mark.parametrize("decay", [0.0, 0.5])
def test_whitening(spark, decay):
    rng = np.random.default_rng(4)
    c = (rng.standard_normal((400, 40)) * np.exp(-decay * np.arange(40))).astype(np.float32)
    c = np.concatenate([c, c[:30]])
    odd = [(900, None), (901, [float("nan")] * 40), (902, [None] * 40), (903, [1.0] * 39), (904, []), (905, [float("inf")] + [0.0] * 39)]
    rows = [(k, v.tolist(), 0, 0) for k, v in enumerate(c)] + [(k, v, 0, 0) for k, v in odd]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    want, explained, deviations = whitened(c)
    assert len(out) == 8 * len(c) and set(out.n) == {len(c)}
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    first = out[out.component == 1].set_index("vec_id").sort_index()
    assert first.deviation.tolist() == deviations == [int(v) for v in first.deviation_exact]
    assert np.allclose(out[out.vec_id == 0].sort_values("component").explained, explained, rtol=1e-9) and out.identity_error.max() < 1e-9


def test_whitening_odd(spark):
    frame = lambda rows: spark.createDataFrame([(k, v, 0, 0) for k, v in rows], VECTORS)
    assert whitening.whiten(frame([])).count() == 0 and whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(frame([(None, [0.5, 1.0])])).collect()
    assert [(r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(None, 1, 0, None, 0.0, None), (None, 2, 0, None, 0.0, None)]
    line = whitening.whiten(frame([(1, [0.0, 0.0, 3.0]), (2, [1.0, 1.0, 3.0])])).toPandas()  # one direction varies
    assert np.allclose(sorted(line[line.component == 1].whitened), [-1, 1]) and line[line.component > 1].whitened.isna().all() and line.identity_error.max() < 1e-12
    far = whitening.whiten(frame([(1, [3e30]), (2, [-3e30])])).collect()
    assert far[0]["deviation"] is None and int(far[0]["deviation_exact"]) == (2 * 2**53) ** 2


def brute_search(docs, items, top=20):
    split = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(d, split(t)) for d, t in docs]
    rows = [(d, w) for d, w in rows if w]
    total, length = len(rows), sum(len(w) for _, w in rows)
    df = Counter(t for _, w in rows for t in set(w))
    out = []
    for item, text in items:
        found = []
        for d, words in rows:
            tf, m = Counter(words), 75 + 25 * len(words) * total // length
            score = sum(int(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


@pytest.mark.parametrize("bucket, shard, block", [(16, 4, 1 << 24), (4096, 256, 200)])
def test_search(spark, monkeypatch, bucket, shard, block):
    monkeypatch.setattr(ranked_search, "BUCKET", bucket)
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 3))) for _ in range(120)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(150)]
    docs += [(200 + k, docs[k % 3][1]) for k in range(60)] + ODD  # copies: ties by id
    items = [(k, " ".join(rng.choice(words) for _ in range(12))) for k in range(12)] + [(20, "lorem Straße 字字"), (21, None), (22, ""), (23, "zzzz"), (24, "a a a"), (None, "b c"), (20, "a")]
    got = ranked_search.search(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS), spark.createDataFrame([(*i, 3, 4) for i in items], "item_id long, text string, doc_id int, score int"))
    assert ordered(map(tuple, got.collect())) == ordered(brute_search(docs, items))


def test_search_odd(spark):
    docs, items = spark.createDataFrame([(1, "a b", 0, 0)], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0 and ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs, spark.createDataFrame([(1, "q")], "item_id long, text string")).count() == 0
    assert [tuple(r) for r in ranked_search.search(docs, items).collect()] == brute_search([(1, "a b")], [(1, "a b")])


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.repeat(np.arange(4), 64))
    term = np.concatenate([rng.choice(50, 10, replace=False) + 50 * t for t in topic])
    shards = ranked_search.bisected(np.repeat(np.arange(256), 10), term, 256, 200, 64)
    assert sorted(np.concatenate(shards)) == list(range(256)) and all(len(set(topic[s])) == 1 for s in shards)


PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "s", "re", "'", "'re", "'ll", " ", "  ", "\n", "\t", "1", "é", "ж", "字", "🙂", "<|endoftext|>", "<|endo", "|>", "!", "ſ", "́", "²", "İ", " "]


def test_joints(monkeypatch):
    library, encoder, rng = Tokenizer.from_file(PATH), bpe.Encoder(PATH), random.Random(1)
    for turn in range(1500):
        monkeypatch.setattr(bpe, "AHEAD", rng.choice([1, 5, 48]))
        monkeypatch.setattr(bpe, "EDGE", rng.choice([1, 3, 12]))
        some = rng.sample(PIECES, rng.randint(1, 8))
        text = "".join(rng.choice(some) for _ in range(rng.randint(2, 150)))
        starts = [0, *sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 9)))), len(text)]
        chunks = [c.edges() for c in encoder.encode_all([text[a:b] for a, b in zip(starts, starts[1:])])]
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.joined(encoder, text, np.array(starts), chunks), "<u4").tolist() == want, (text, starts)
        ids = [rng.randrange(50_257) for _ in range(30)]  # whatever they say, in UTF-8 or not
        assert encoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_chunks():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ñ字") for _ in range(20_000))
    texts = [x.encode() for x in ("", "é" * 5000, "a" * 100_000, "12" + shared, shared + "345", "ж" + shared[7:])]
    found = bpe.chunks(texts)
    assert [b"".join(c) for c in found] == texts and all(c.decode() for parts in found[1:] for c in parts)
    assert len(found[2]) == 1 and len(set(found[3]) & set(found[4]) & set(found[5])) > 5


def test_bpe(spark):
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    words = ["".join(rng.choice("abcdeéж") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    shared = " ".join(rng.choice(words) for _ in range(3000))
    long = "".join(rng.choice("abcdef") for _ in range(60_000))  # a single pre-token
    rows = [(k, f"{k} {shared[100 * k :]}<|endoftext|>{k}") for k in range(8)] + [(20, long), (21, long + " x"), (22, shared), (22, shared)] + ODD
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)
    out = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"], r["n_shared"]) for r in bpe.decode(bpe.encode(frame, PATH), PATH).collect()]
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((x[:3] for x in out), key=key) == sorted(((d, i, library.decode(i, skip_special_tokens=False)) for (d, _), i in zip(rows, ids)), key=key)
    assert sum(x[3] for x in out) > 50
    assert bpe.decode(bpe.encode(frame.limit(0), PATH), PATH).count() == 0
