"""Small fixtures for each training-data operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from tessera.llm import chat, common, components, jaccard, language_id, mixing, near_vectors, packing, quality, repeats, secret_scan, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n\t", "en", None, 3), (903, "x" * 300_000, "en", "a", 1), (904, "12 34", None, "b", 5), (904, "12 34", None, "b", 5)]


def docs(spark, rows):
    """With an extra column whose name clashes with inner ones."""
    return spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", score int, __text int")


def texts(n, seed=0, size=(5, 200)):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(*size))) for _ in range(n)], rng


def table_of(spark, rows):
    return docs(spark, [(k, t, "en", "a", None) for k, t in enumerate(rows)] + ODD)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (None, 4)] + [(k, k + 1) for k in range(100, 140)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, **{k: 100 for k in range(100, 141)}}
    assert components.components(edges.limit(0)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((200, 32))
    x = np.concatenate([base, base[:50] + 0.05 * rng.standard_normal((50, 32)), base[:3]]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] * 32, 0), (503, [None] * 32, 0), (504, [1.0], 0), (None, x[0].tolist(), 0)]
    out = near_vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).toPandas()
    assert len(out) == len(rows) + len(odd)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = near_vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).where("vec_id < 500").toPandas().set_index("vec_id")
    least = np.arange(len(x))
    while True:  # the least id over links, until nothing changes
        now = np.array([least[row].min() for row in u @ u.T >= 0.95])
        if (now == least).all():
            break
        least = now
    assert (found.component_id.sort_index().to_numpy() == least).all() and (found.kept.sort_index().to_numpy() == (least == np.arange(len(x)))).all()
    got = out.dropna(subset=["vec_id"]).set_index("vec_id").n_links
    assert (got[got.index < 500].sort_index().to_numpy() == linked).all()
    assert (got[got.index >= 500] == 0).all()
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def offset_pairs(n, dim=64, cosine=0.8):
    """n vectors whose mean pairwise cosine is as given, each with one at cosine 0.951."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    x[:, 0] += (dim * cosine / (1 - cosine)) ** 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, 0.951 * x + (1 - 0.951**2) ** 0.5 * z


@pytest.mark.parametrize("n", [20_000, 10_000_000])
def test_share_missed_under_a_common_offset(n):
    x, y = offset_pairs(10_000)
    mean, projections, parts, near = near_vectors.plan(x, n, 64)
    found = np.zeros(len(x), bool)
    for p in projections:
        differ = ((x - mean) @ p > 0) != ((y - mean) @ p > 0)
        found |= np.any([differ[:, a : a + w].sum(axis=1) <= 1 for a, w in parts], axis=0) & (differ.sum(axis=1) <= near)
    assert found.mean() >= 0.99


def test_near_vectors_with_a_common_offset(spark):
    x, y = offset_pairs(600)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    out = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    u = np.concatenate([x, y])
    linked = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = out.sort_values("vec_id").n_links.to_numpy()
    assert (got <= linked).all() and got.sum() >= 0.99 * linked.sum() >= 1180


def test_language_id(spark):
    rng = random.Random(2)
    speak = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    rows = [(k, speak("aeioub" if k % 2 else "xyzrst"), "aa" if k % 2 else "bb", "s", 0) for k in range(60)]
    d = docs(spark, rows + ODD)
    model = language_id.train(d.where(~language_id.held_out()))
    out = language_id.identify(d, model).collect()
    assert len(out) == len(rows) + len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert all(by[k]["lang_pred"] == lang for k, _, lang, _, _ in rows)
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (900, 901, 902, 904))
    assert all(0 <= r["score"] <= 1 for r in out)
    nothing = language_id.train(d.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(d, nothing).collect()} == {"und"}


def plain_bayes(rows, text):
    """Counts of n-grams by language, smoothed, without numpy."""
    counts = {}
    for lang, t in rows:
        own = counts.setdefault(lang, {})
        for x in language_id._indices(t):
            for i in x.tolist():
                own[i] = own.get(i, 0) + 1
    here = [i for x in language_id._indices(text) for i in x.tolist()]
    logs = {}
    for lang, own in counts.items():
        total = sum(own.values()) + 0.5 * language_id.BUCKETS
        logs[lang] = sum(math.log((own.get(i, 0) + 0.5) / total) for i in here) * min(len(here), 64) / len(here)
    top = max(logs, key=logs.get)
    return top, 1 / sum(math.exp(v - logs[top]) for v in logs.values())


@pytest.mark.parametrize("chunk,step", [(1 << 20, 1 << 16), (50, 120)])
def test_language_scores_are_those_of_plain_naive_bayes(spark, monkeypatch, chunk, step):
    rows, rng = texts(60, 21, (3, 60))
    named = [(k, t if k % 3 else t.replace("a", "h").replace("b", "g"), "xyz"[k % 3], "s", 0) for k, t in enumerate(rows)]
    langs, logp = language_id.train(docs(spark, named[:45]))
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    monkeypatch.setattr(language_id, "STEP", step)
    asked = [None, "", " 12"] + [t for _, t, _, _, _ in named[45:]]
    names, scores = language_id.score_texts(asked, langs, logp)
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3
    for text, name, score in zip(asked[3:], names[3:], scores[3:]):
        want, posterior = plain_bayes([(lang, t) for _, t, lang, _, _ in named[:45]], text)
        assert name == want and abs(score - posterior) < 1e-3


def test_language_held_out_accuracy(spark):
    rows = common.table(spark, "/root/testdata/sf0.01", "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(rows.where("not held_out"))
    out = language_id.identify(rows.where("held_out and lang is not null"), model, ("doc_id", "lang")).where("lang_pred <> 'und'").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_language_chunks(monkeypatch):
    text = "abcdefghij" * 30
    whole = np.sort(np.concatenate(list(language_id._indices(text))))
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert (np.sort(np.concatenate(list(language_id._indices(text)))) == whole).all()


def check_plan(counts, capacity):
    bins, seen = {}, {}
    for n, lo, hi, first, per, place in packing.plan(counts, capacity):
        for r in range(lo, hi):
            assert (n, r) not in seen
            seen[n, r] = 1
            b = bins.setdefault(first + (r - lo) // per, [])
            b.append((place + (r - lo) % per * n, n))
    assert len(seen) == sum(counts.values())
    for items in bins.values():
        at = 0
        for place, n in sorted(items):
            assert place == at
            at += n
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def test_plan():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 64, 100])
        counts = {n: rng.randint(0, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(20, capacity)))}
        bins = check_plan(counts, capacity)
        total = sum(n * c for n, c in counts.items())
        large = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert max(-(-total // capacity), large) <= bins <= max(1.3 * max(total / capacity, large), 3) + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    from tessera.llm.queries import tokenizer_path

    rows, _ = texts(30, 4)
    rows += ["it's <|endoftext|> ok", "caf" + chr(0xE9) + " 12" + chr(0xBD) + "x", chr(0x4E2D) + " b"]
    d = table_of(spark, rows)
    pieces = packing.pack(packing.tokenize(d, tokenizer_path())).toPandas()
    plain = Tokenizer.from_file(tokenizer_path())
    for k, t in enumerate(rows):
        ids = b"".join(pieces[pieces.doc_id == k].sort_values("piece").ids)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids + [1]
    assert (pieces[pieces.doc_id.isin([900, 901, 902])].length == 1).all() and len(pieces[pieces.doc_id == 904]) == 2
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 4096
    assert packing.pack(packing.tokenize(d.limit(0), tokenizer_path())).count() == 0


def test_compressed_ids(spark):
    from pyspark.sql import functions as F

    from tessera.llm.queries import tokenizer_path

    rows, _ = texts(40, 8)
    d = table_of(spark, [*rows, "ab cd " * 9000])
    plain = packing.tokenize(d, tokenizer_path(), 1000)
    small = packing.tokenize(d, tokenizer_path(), 1000, "zstd")
    told = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", F.hex("ids")).na.fill(-1).collect())
    assert told(packing.plain_ids(small, "zstd")) == told(plain) != told(small)
    assert packing.plain_ids(small, "zstd").schema == plain.schema and packing.plain_ids(small.limit(0), "zstd").count() == 0


def slow_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality(spark):
    rng = random.Random(5)
    for _ in range(100):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert quality.repeat_words(words) == slow_repeats(words)
    assert quality.text_stats("a # b\n\na # b\n\u00e9\u00a0x".encode()) == (7, 9, 2, 1, 0)
    good, _ = texts(80, 6, (60, 200))
    rows = good + [" ".join(w + "###" for w in t.split()) for t in good[:20]]
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(100)] + [(1, None), (None, 1)], "doc_id long, quality int")
    out = quality.judge(table_of(spark, rows), labels).toPandas()
    assert len(out) == 106 and not out[out.base_failed].kept.any()
    assert out[out.doc_id < 80].kept.mean() >= 0.95
    assert out[(out.doc_id >= 80) & (out.doc_id < 100)].anomaly.mean() > out[out.doc_id < 80].anomaly.mean()
    assert quality.judge(table_of(spark, rows).limit(0), labels).count() == 0
    assert quality.judge(table_of(spark, rows), labels.limit(0)).where("not kept and not base_failed").count() == 0


def test_isolation_forest():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.standard_normal((500, 5)), [[9.0] * 5]])
    forest = quality.grow(rows)
    feature, value, path, size = forest
    assert size == quality.SAMPLE and feature.shape[0] == quality.TREES
    paths = []
    for x in rows[-20:]:  # walked node by node
        total = 0.0
        for t in range(quality.TREES):
            node = 0
            while feature[t, node] >= 0:
                node = 2 * node + (1 if x[feature[t, node]] <= value[t, node] else 2)
            total += path[t, node]
        paths.append(2.0 ** -(total / quality.TREES / quality._mean_path(size)))
    got = quality.anomaly(forest, rows)
    assert np.allclose(got[-20:], paths) and got.argmax() == 500 and got[500] > 0.6
    tree = quality.grow(np.array([[0.0], [1.0]]))
    assert np.allclose(tree[2][tree[0] < 0].max(), 1.0)  # two rows are parted by one split


def test_quality_threshold(spark):
    rows = [(k, 100, 500, 0, 0, 0, 1, k / 1000) for k in range(1000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, anomaly double")
    labels = spark.createDataFrame([(k, int(k < 900)) for k in range(1000)] + [(5, 1), (None, 0), (6, None)], "doc_id long, quality int")
    best = max(range(1001), key=lambda s: (sum(k >= s for k in range(900)) <= 0.005 * 900) * (sum(k >= s for k in range(900, 1000)) / 100 - sum(k >= s for k in range(900)) / 900 + 1))
    assert quality.calibrate(scored, labels) == best / 1000


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = {k: k for k, _ in rows}
    changed = True
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {(k, len(s), comp[k]) for (k, _), s in zip(rows, sets)}


@pytest.mark.parametrize("hot", [16, 0])
def test_jaccard(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rows, rng = texts(40, 7, (1, 80))
    for t in list(rows[:25]):
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "new%d" % rng.randint(0, 99)
            rows.append(" ".join(w).upper())
    named = list(enumerate(rows)) + [(r[0], r[1]) for r in ODD]
    got = {tuple(r) for r in jaccard.join(table_of(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_jaccard(named)
    assert jaccard.join(table_of(spark, rows).limit(0)).count() == 0


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(8)
    for n in (10, 900, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        assert jaccard._apart(jaccard._parity(a), jaccard._parity(b)) <= len(np.setxor1d(a, b))


def test_chat(spark):
    strange = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <<SYS>>", "", None, "a\\", "[ROLE]x[/ROLE]", " [INST] "]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in strange for r in ("user", "assistant", "system", "tool<s>", None))]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (None, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_log(chat.plain_log(turns))
    text = "".join(r["segment"] for r in segments.where("conv_id = 1").orderBy("place").collect())
    want = sorted(((k, r or "", t or "") for c, k, r, t in rows if c == 1), key=lambda x: x[0])
    assert chat.parse(text) == [(r, t) for _, r, t in want]
    out = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert out[2]["n_turns"] == 2 and out[1]["formatted_chars"] == len(text) and out[None]["n_turns"] == 1
    learnt = "".join(t for _, r, t in want if r == "assistant")
    assert out[1]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest() and out[1]["loss_chars"] == len(learnt)
    assert chat.read_back(chat.format_log(chat.plain_log(turns.limit(0)))).count() == 0


def test_chat_streamed_log(spark):
    """The log of streamed turns folds to the turns: ties of turn, nulls, long texts, extra columns with clashing names."""
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "a</s>b" * 60_000), (1, 2, None, None), (1, None, "user", "first"), (2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, 0, "user", "tie a"), (None, 5, "system", "日本"), (3, 7, "tool", "")]
    turns = spark.createDataFrame([(*r, "x", 9) for r in rows], "conv_id long, turn long, role string, text string, event string, seq int")
    kept = lambda log: [(r["conv_id"], r["role"], r["text"]) for r in chat.fold(log).orderBy("conv_id", "place").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert kept(chat.streamed_log(turns)) == [(c, r or "", t or "") for c, _, r, t in sorted(rows, key=key)]
    assert sorted(map(tuple, chat.read_back(chat.format_log(chat.streamed_log(turns))).collect()), key=str) == sorted(map(tuple, chat.read_back(chat.format_log(chat.plain_log(turns))).collect()), key=str)
    assert chat.fold(chat.streamed_log(turns.limit(0))).count() == 0


def test_chat_many_deltas(spark):
    n = 100_000
    log = spark.range(n + 1).selectExpr("1L as conv_id", "id as seq", "if(id = 0, 'message', if(id = 1000, 'edit', 'delta')) as event", "'m' as message_id", "'assistant' as role", "concat('<', id, '>') as text")
    began = time.time()
    assert [r["text"] for r in chat.fold(log).collect()] == ["".join(f"<{k}>" for k in range(1000, n + 1))]
    assert time.time() - began < 30


def test_chat_fold(spark):
    log = [
        (1, 0, "message", "a", "user", "hi"), (1, 1, "message", "b", "assistant", "he"), (1, 2, "delta", "b", None, "llo"), (1, 3, "edit", "a", None, "hey"),
        (1, 4, "regenerate", "b", None, None), (1, 5, "delta", "b", None, "yo"), (1, 6, "message", "c", "user", "x"), (1, 7, "delete", "c", None, None), (1, 8, "delta", "d", "assistant", "late"),
    ]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, event string, message_id string, role string, text string")).orderBy("place").collect()
    assert [(r["role"], r["text"]) for r in out] == [("user", "hey"), ("assistant", "yo"), ("assistant", "late")]


def slow_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_url_rules(spark):
    rng = random.Random(9)
    pick = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rules = {(pick(), rng.choice(["/", "/x", "/x/y", "/x/yz"])): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{pick().upper()}{rng.choice(['', '/x', '/x/yzw', '/q'])}{rng.choice(['', '?a=/x', '#f'])}" for _ in range(300)] + [None, "", "no scheme/x", "http://", "x://a?b://c"]
    pages = spark.createDataFrame([(k, u, k) for k, u in enumerate(urls)] + [(0, urls[0], 0)], "page_id long, url string, host int").repartition(5)
    frame = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    out = url_rules.judge(pages, frame).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        assert (r["host"], r["path"]) == (host.lower(), path)
        assert (r["rule"], r["verdict"]) == slow_rule(host.lower(), path, rules)
    assert {r["verdict"] for r in url_rules.judge(pages, frame.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), frame).count() == 0


def slow_spans(text):
    kinds = [("assign", re.compile(secret_scan.ASSIGN)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(kinds) for m in p.finditer(text) if ok[kind](m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


SECRETS = ["password = hunter22 x", chr(0x1F600) + " API_KEY:'abcdef123' secret: token: abcdefgh", "AKIA" + "A1" * 9 + " AKIAshort", "dead" * 8 + " token=ab", "secret=" + "ab" * 20, "none", "token=secret=abcdefgh"]


def test_secret_scan(spark):
    d = table_of(spark, SECRETS + SECRETS[:2])
    found, ledger = secret_scan.scan_all(d)
    text = {k: t or "" for k, t in list(enumerate(SECRETS + SECRETS[:2])) + [(r[0], r[1]) for r in ODD]}
    rows = found.select("doc_id", secret_scan.joined(common.F.col("spans")).alias("s")).collect()
    assert len(rows) == len(SECRETS) + 2 + len(ODD)
    assert all(r["s"] == slow_spans(text[r["doc_id"]]) for r in rows)
    more = docs(spark, [(50, "password: newsecret", "en", "a", 0), (51, SECRETS[0], "en", "a", 0)])
    fresh = secret_scan.scan(more, secret_scan.blobs(more), ledger)
    assert fresh.count() == 1  # the other blob is in the ledger
    assert secret_scan.scan(more, secret_scan.blobs(more), ledger, "2").count() == 2
    assert secret_scan.scan_all(d.limit(0))[0].count() == 0


def test_redacted(spark):
    d = table_of(spark, SECRETS)
    found, _ = secret_scan.scan_all(d)
    out = d.join(found.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", secret_scan.redacted(common.F.col("text"), common.F.col("spans")).alias("t")).collect()
    by = {r["doc_id"]: r["t"] for r in out}
    assert by[0] == "[REDACTED] x" and by[5] == "none" and "abcdef123" not in by[1] and by[4] == "[REDACTED]" and by[900] is None


def test_many_secrets_in_one_text(spark):
    text = " ".join(["dead" * 8 + " " + chr(0x1F600)] * 3000)
    d = docs(spark, [(1, text, "en", "a", 0)])
    found, _ = secret_scan.scan_all(d)
    began = time.time()
    row = d.join(found, "doc_id").select(secret_scan.joined(common.F.col("spans")).alias("s"), secret_scan.redacted(common.F.col("text"), common.F.col("spans")).alias("t")).first()
    assert time.time() - began < 60 and row["s"] == slow_spans(text) and row["t"] == " ".join(["[REDACTED] " + chr(0x1F600)] * 3000)


def test_scan_history(spark):
    first, second = table_of(spark, SECRETS), table_of(spark, SECRETS[:3] + ["token: newsecret1"])
    found, ledger = secret_scan.scan_history([first, second, second.limit(0)])
    assert found.count() == first.count() + second.count()
    assert ledger.groupBy("blob").count().where("count > 1").count() == 0 and ledger.count() == secret_scan.blobs(first.unionByName(second)).select("blob").distinct().count()
    want = sorted(slow_spans(r["text"] or "") for r in first.unionByName(second).collect())
    assert sorted(r["s"] for r in found.select(secret_scan.joined(common.F.col("spans")).alias("s")).collect()) == want


def test_secrets_without_an_id(spark):
    rows = [(None, SECRETS[0], "en", "a", 0), (None, SECRETS[0], "en", "a", 0), (None, SECRETS[3], "en", "a", 0), (7, SECRETS[3], "en", "a", 0), (None, None, "en", "a", 0), (None, "none", "en", "a", 0)]
    found, ledger = secret_scan.scan_all(docs(spark, rows))
    got = sorted(((r["doc_id"] or 0), r["s"]) for r in found.select("doc_id", secret_scan.joined(common.F.col("spans")).alias("s")).collect())
    assert got == sorted((r[0] or 0, slow_spans(r[1] or "")) for r in rows) and ledger.count() == 4


def test_whole_keys_are_redacted(spark):
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = "\n".join(["MIIEowIBAAKCAQEA" * 4] * 3 + ["dead" * 8, "Zm9v=="])
    cases = {
        f"{chr(0x1F600)} a {head}\n{body}\n{foot} b password = hunter22 c": f"{chr(0x1F600)} a [REDACTED] b [REDACTED] c",
        f"a {head}\nProc-Type: 4,ENCRYPTED\n\n{body}\nplain words": "a [REDACTED]\nplain words",
        f"{head}\n{body}\n text {head} x {foot} y": "[REDACTED]\n text [REDACTED] y",
        f"a {head} is a header": "a [REDACTED] is a header",
        f"{head}{'A' * 200_000}{foot}": "[REDACTED]",
        f"{head}\n" + "\n".join(["A" * 64] * 3000): "[REDACTED]",
    }
    d = docs(spark, [(k, t, "en", "a", 0) for k, t in enumerate(cases)])
    found, _ = secret_scan.scan_all(d)
    out = d.join(found, "doc_id").select("doc_id", secret_scan.redacted(common.F.col("text"), common.F.col("spans")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in out} == dict(enumerate(cases.values()))


def slow_cut(rows):
    seen = {}
    for t in rows:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    out, spans = [], []
    for t in rows:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                cover[i : i + 400] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~cover]) if t else b"")
        spans.append(int((np.diff(np.concatenate([[0], cover, [0]])) == 1).sum()))
    return out, spans


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows, rng = texts(12, 10, (150, 400))
    shared = [rows[0][:n] for n in (399, 400, 401, 700)]
    rows += [rows[k][:300] + shared[k % 4] + rows[k][300:] for k in range(1, 9)] + [rows[1], rows[1], rows[2] + "z", "ab" * 450]
    d = docs(spark, [(k, t, "en", "a", 0) for k, t in enumerate(rows)] + [r for r in ODD if r[0] != 903])
    every = [(k, t.encode()) for k, t in enumerate(rows)] + [(r[0], (r[1] or "").encode()) for r in ODD if r[0] != 903]
    cut, spans = slow_cut([t for _, t in every])
    want = {(k, len(t), len(t) - len(c), n, hashlib.sha256(c).hexdigest(), len(c) < len(t)) for (k, t), c, n in zip(every, cut, spans)}
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["has_repeats"]) for r in repeats.digests(d).collect()}
    assert got == want
    assert repeats.digests(d.limit(0)).count() == 0


def test_mixing(spark):
    rows, rng = texts(400, 11)
    d = docs(spark, [(k, t, "en", ["a", "b", "c", None][min(3, k % 9)], 0) for k, t in enumerate(rows)] + ODD)
    sized = mixing.copies(mixing.measured(d)).toPandas()
    assert len(sized) == len(rows) + len(ODD)
    per = sized.groupby("source", dropna=False).agg(size=("size", "sum"), total=("source_size", "first"), target=("target", "first"))
    assert (per["size"] == per.total).all() and abs(per.target.sum() - 1.5 * per.total.sum()) < 1e-6 and (per.target <= 2 * per.total + 1e-9).all()
    taken = (sized["size"] * sized.copies).groupby(sized.source.fillna("~")).sum()
    assert (abs(taken.to_numpy() - per.target.to_numpy()) <= 0.25 * per.target.to_numpy() + 300).all() and sized.copies.max() <= 2
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sized.copies.sum()
    assert mixing.mix(d.limit(0)).count() == 0


def test_queries_and_pipeline(spark):
    import duckdb

    import __spark_entry__
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = __spark_entry__.queries()
    assert sum(k.startswith("op") and k[2].isdigit() for k in names) == 13 and "pipeline" in names
    rows = common.table(spark, sf, "documents")
    near = corpus_pipeline.drop_near_copies(spark, rows, sf)
    want = {c for _, _, c in brute_jaccard([(r["doc_id"], r["text"]) for r in rows.collect()])}
    assert near.columns == rows.columns and {r["doc_id"] for r in near.collect()} == want
    clean = corpus_pipeline.redact_secrets(spark, rows, sf)
    assert clean.count() == rows.count() and all(slow_spans(r["text"]) == "" for r in clean.collect())
    known = corpus_pipeline.identify_language(spark, table_of(spark, [r["text"] for r in rows.limit(30).collect()]), sf)
    assert not {900, 901, 902, 904} & {r["doc_id"] for r in known.collect()} and known.count() >= 29
    for name in ("op6_chat_formatting", "op7_url_filters", "op8_secret_scans", "op10_source_mixing", "op12_ranked_search"):
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "benchmark"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        columns = sorted(names[name](spark, sf).columns)
        want = con.sql(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
        near_enough = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(repr(near_enough(r)) for r in names[name](spark, sf).select(*columns).collect()) == sorted(repr(near_enough(r)) for r in want)
