"""run() and its stages against brute force, with odd rows, and extra columns named like those that stages make."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import language_id, mixing, secret_scan
from tessera.llm.queries import tokenizer_path

from test_operators import brute_jaccard, slow_spans, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row int, __spans int, __language string, found_lang int, OWN_ID int, own_row int, own_spans int, own_blob int, copies int, length int"
EXTRA = (1, 2, "x", 3, 4, 5, 6, 7, 8, 9)


def rows_of():
    words, rng = texts(40, 31, (30, 90))
    rows = [(k, t, "en" if k % 2 else None, "ab"[k % 2], k) for k, t in enumerate(words)]
    rows += [(100 + k, t + " more", "en", None, 0) for k, t in enumerate(words[:8])]  # near copies
    rows += [(0, words[0], None, "a", 0), (1, "another text of one id " + words[30], "en", "b", 0)]  # the same row but one; an id that is shared
    rows += [(None, words[2], "en", "a", 0), (None, words[3] + " tail", "en", "a", 0), (None, "alone " + " ".join(words[5].split()[::-1]), "en", "a", 0), (None, "alone " + " ".join(words[5].split()[::-1]), "en", "a", 0)]
    rows += [(200, None, "en", "a", 0), (201, "", "en", None, 0), (202, " \n", None, "a", 0), (203, "12 34", "en", "a", 0), (None, None, None, None, None)]
    rows += [(300, words[9] + " password = hunter22x", "en", "a", 0), (None, "secret: abcdefgh12 " + words[10][::-1], "en", "b", 0)]
    return rows


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, *EXTRA) for r in rows_of()], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def bag(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def slow_near_copies(rows):
    """Rows that stay: keys by id, or by text where there is none."""
    keys, own = [], {}
    for r in rows:
        keys.append(r[0] if r[0] is not None else own.setdefault(r[1], 10**6 + len(own)))
    merged = {}
    for k, r in zip(keys, rows):
        merged.setdefault(k, []).append(r[1])
    flat = [(k, t) for k, ts in merged.items() for t in ts]
    label = {}
    for k, _, c in brute_jaccard(list(enumerate(t for _, t in flat))):  # over texts; then ids that share a text's component are one
        label.setdefault(c, set()).add(flat[k][0])
    joined = {k: k for k in merged}
    changed = True
    while changed:
        changed = False
        for group in label.values():
            m = min(joined[k] for k in group)
            for k in group:
                changed |= joined[k] != m
                joined[k] = m
    return Counter({(r[0], r[1]): 1 for k, r in zip(keys, rows) if joined[k] == k})


def test_language_stage(spark, documents):
    folder, docs = documents
    out = P.identify_language(spark, docs, folder)
    assert out.columns == docs.columns
    want = Counter((r[0], r[1]) for r in rows_of() if r[1] and re.search("[A-Za-z]", r[1]))
    assert bag(out, "doc_id", "text") == want  # one language is learned, so all texts with a letter are of it
    langs, _ = language_id.train(docs.where(~language_id.held_out()))
    assert langs == ["en"]


def test_near_copies_stage(spark, documents):
    folder, docs = documents
    out = P.drop_near_copies(spark, docs, folder)
    assert out.columns == docs.columns and bag(out, "doc_id", "text") == slow_near_copies(rows_of())


def test_secrets_stage(spark, documents):
    folder, docs = documents
    out = P.redact_secrets(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(slow_spans(r["text"] or "") == "" for r in out.collect())
    assert bag(out, "doc_id", "text") == Counter((r[0], slow_redacted(r[1])) for r in rows_of())


def slow_redacted(text):
    if text is None:
        return None
    cover = np.zeros(len(text), bool)
    for span in filter(None, slow_spans(text).split(",")):
        _, a, b = span.split(":")
        cover[int(a) : int(b)] = True
    return re.sub("\0+", "[REDACTED]", "".join("\0" if c else x for x, c in zip(text, cover)))


def test_mixing_stage(spark, documents):
    folder, docs = documents
    out = P.mix_sources(spark, docs, folder)
    sized = mixing.copies(mixing.measured(docs)).groupBy("doc_id", "source", "size").agg({"copies": "sum"}).collect()
    want = Counter()
    for r in sized:
        want[r[0], r[1]] += r[3]
    assert out.columns == docs.columns and bag(out, "doc_id", "source") == +want


def check_packed(packed, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    got = Counter(bytes(r["ids"]) for r in packed)
    want = Counter()
    for r in docs:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.update(np.array(ids[at : at + 4096], "<u4").tobytes() for at in range(0, len(ids), 4096))
    assert got == want
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        assert [a for a, _ in sorted(items)] == [0, *np.cumsum([n for _, n in sorted(items)])[:-1].tolist()] and sum(n for _, n in items) <= 4096


def test_packing_stage(spark, documents):
    folder, docs = documents
    check_packed(P.pack_sequences(spark, docs, folder).collect(), docs.collect())


def test_run_is_its_stages(spark, documents):
    folder, docs = documents
    packed = P.run(spark, folder).collect()
    kept = [r for r in rows_of() if r[1] and re.search("[A-Za-z]", r[1])]
    kept = [(i, slow_redacted(t)) for i, t in slow_near_copies(kept)]
    source = {(r[0], slow_redacted(r[1])): r[3] for r in rows_of()}
    docs = spark.createDataFrame([(i, t, source[i, t]) for i, t in kept], "doc_id long, text string, source string")
    check_packed(packed, P.mix_sources(spark, docs, folder).collect())


def test_empty_tables(spark, documents):
    folder, docs = documents
    for _, stage in P.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0 and set(out.columns) >= {"doc_id"}


def test_fixture_has_secrets(documents):
    assert sum(bool(slow_spans(r[1] or "")) for r in rows_of()) == 2 and secret_scan.RULES_VERSION
