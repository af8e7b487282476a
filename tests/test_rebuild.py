"""Rebuild with hand-over, suites over named graphs in one scan, and isolation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import machine, patterns, rebuild
from tessera.sources.generations import Generations, StalePointer
from tessera.streaming import apply as A

EVENTS = "source string, ts timestamp_ntz, rcid long, action string, entity_id string, revid long, old_revid long"
TEXTS = "entity_id string, revid long, kind string, line string"
SOURCES = "source string, ts timestamp_ntz, rcid long, status string, code string"
T0 = dt.datetime(2024, 1, 1)
line = lambda e, r: f'<http://b/entity/{e}> <http://schema.org/version> "{r}" .'


def burst(n, entities=7):
    """Edits of several entities in turn, each with its next revision, five a second; and a delete."""
    rows, heads = [], {}
    for k in range(n):
        e = f"Q{k % entities + 1}"
        old, heads[e] = heads.get(e, 0), heads.get(e, 0) + 1
        rows.append(("s", T0 + dt.timedelta(seconds=k // 5), k + 1, "ENTITY_EDIT", e, heads[e], old))
    return rows + [("s", T0 + dt.timedelta(seconds=n), n + 1, "ENTITY_DELETE", "Q2", None, None)]


def inputs(spark, rows):
    texts = [(e, r, "entity", line(e, r)) for _, _, _, a, e, r, _ in rows if a == "ENTITY_EDIT"]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame([], A.RESOLVED), spark.createDataFrame(texts, TEXTS)


def start(spark):
    return rebuild.Candidate(spark.createDataFrame([("urn:kg:global", "g")], "graph string, line string"), spark.createDataFrame([], machine.STATE), spark.createDataFrame([], SOURCES))


def test_hand_over(spark, tmp_path):
    rows = burst(500)
    events, resolved, texts = inputs(spark, rows)
    clean = rebuild.catch_up(start(spark), events, resolved, texts)
    want = sorted(map(tuple, clean.dataset.collect()))
    assert want == sorted([("urn:kg:global", "g")] + [(f"urn:kg:entity:Q{k}", line(f"Q{k}", r)) for k, r in ((1, 72), (3, 72), (4, 71), (5, 71), (6, 71), (7, 71))])
    c0 = spark.createDataFrame([("s", rows[222][1], rows[222][2])], "source string, ts timestamp_ntz, rcid long")
    snapshot = rebuild.catch_up(start(spark), events, resolved, texts, c0)
    assert [tuple(r) for r in snapshot.sources.collect()] == [("s", rows[222][1], 223, "HEALTHY", None)]
    heads = spark.createDataFrame([("s", rows[-1][1], rows[-1][2])], "source string, ts timestamp_ntz, rcid long")
    store = Generations(spark, f"file://{tmp_path}/store")
    with pytest.raises(rebuild.RebuildFailed, match="CANDIDATE_NOT_CURRENT"):
        rebuild.promote(store, "early", snapshot, heads, 0)
    overlap = events.where("rcid > 150").unionByName(events.where("rcid between 400 and 420"))  # from before the snapshot, and some twice
    candidate = rebuild.catch_up(snapshot, overlap, resolved, texts, heads)
    assert sorted(map(tuple, candidate.dataset.collect())) == want
    with pytest.raises(rebuild.RebuildFailed, match="CANONICAL_EQUALITY_FAILED"):
        rebuild.promote(store, "other", candidate, heads, 0, expected=clean.dataset.where("graph <> 'urn:kg:entity:Q3'"))
    assert rebuild.promote(store, "one", candidate, heads, 0, expected=clean.dataset)["generation"] == "one"
    with pytest.raises(StalePointer):
        rebuild.promote(store, "two", candidate, heads, 0)
    assert sorted((r["graph"], r["line"]) for r in store.read().collect()) == want
    # a stream goes on from the candidate: what it has is skipped, what is new applies
    root = A.Root(spark, f"{tmp_path}/root")
    root.seed(candidate.states, candidate.sources)
    more = rows + [("s", T0 + dt.timedelta(seconds=900), 900, "ENTITY_EDIT", "Q1", 73, 72)]
    spark.createDataFrame(more, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    new = texts.unionByName(spark.createDataFrame([("Q1", 73, "entity", line("Q1", 73))], TEXTS))
    A.apply_stream(stream, new, root.path, f"{tmp_path}/checkpoint").awaitTermination()
    got = sorted(map(tuple, A.applied(spark, root.path, store.read().select("graph", "line")).collect()))
    assert got == sorted([x for x in want if x[0] != "urn:kg:entity:Q1"] + [("urn:kg:entity:Q1", line("Q1", 73))])
    with pytest.raises(ValueError):
        root.seed(candidate.states, candidate.sources)


def test_stopped_candidate_is_not_promoted(spark, tmp_path):
    rows = burst(20)
    events, resolved, texts = inputs(spark, rows)
    candidate = rebuild.catch_up(start(spark), events, resolved, texts.where("not (entity_id = 'Q3' and revid = 2)"))
    heads = spark.createDataFrame([("s", rows[-1][1], rows[-1][2])], "source string, ts timestamp_ntz, rcid long")
    with pytest.raises(rebuild.RebuildFailed, match="ENTITY_MISSING: s"):
        rebuild.promote(Generations(spark, f"file://{tmp_path}/store"), "x", candidate, heads, 0)
    assert sorted(map(tuple, rebuild.catch_up(candidate, events, resolved, texts).dataset.collect())) == sorted(map(tuple, rebuild.catch_up(start(spark), events, resolved, texts).dataset.collect()))


def test_nothing_is_folded_after_an_ambiguous_event(spark, monkeypatch):
    """That event stops its source whatever the states are; the other source goes on, and results are those of a fold of everything."""
    own = [(*r[:3], "UNKNOWN" if k in (60, 200) else r[3], *r[4:]) for k, r in enumerate(burst(300))]
    rows = own + [("t", ts, rcid, a, e and e.replace("Q", "P"), r, o) for _, ts, rcid, a, e, r, o in burst(50)]
    events, resolved, texts = inputs(spark, rows)
    texts = texts.unionByName(texts.where("entity_id like 'P%'").selectExpr("entity_id", "revid", "'schema' as kind", "'x' as line"))
    folded = machine.fold(machine.steps(events, resolved), start(spark).states, texts, 4)
    decided = spark.createDataFrame(machine.outcomes(folded).collect(), folded.schema)
    seen = {}
    monkeypatch.setattr(rebuild, "save", lambda df, name, own=rebuild.save: seen.setdefault(name, own(df, name)))
    got = rebuild.catch_up(start(spark), events, resolved, texts)
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows_of(got.dataset) == rows_of(machine.applied(start(spark).dataset, decided, texts))
    assert rows_of(got.states) == rows_of(machine.entity_states(decided, start(spark).states))
    assert rows_of(got.sources) == rows_of(machine.source_states(decided))
    assert {r["source"]: r["n"] for r in seen["folded"].groupBy("source").agg(F.count("*").alias("n")).collect()} == {"s": 61, "t": 51}
    reached, past = machine.reachable(events)
    assert (reached.where("source = 's'").count(), past.count()) == (61, 240)
    assert decided.where("outcome = 'HELD'").count() == 240 and {tuple(r) for r in machine.held(machine.steps(past, resolved)).collect()} == {tuple(r) for r in decided.where("outcome = 'HELD'").collect()}


def test_suite_in_one_scan_and_graph_variables(spark, tmp_path):
    rows = [("g1", '<a> <p> "x" .'), ("g2", '<a> <p> "y"@en .'), ("g2", "<b> <q> <b> ."), ("http://h", "<http://h> <q> <c> .")]
    spark.createDataFrame(rows, "graph string, line string").write.parquet(f"{tmp_path}/quads")
    quads = patterns.quads(spark.read.parquet(f"{tmp_path}/quads"))
    checks = {
        "x": patterns.holds(("?s", "<p>", '"x"'), "g1"), "x in g2": patterns.holds(("?s", "<p>", '"x"'), "g2"), "self": patterns.holds(("?s", "?p", "?s")), "en": patterns.holds(("?s", "?p", "?o"), "?g") & (patterns.language(quads["o"]) == "en"),
    }
    once = patterns.asked_once(quads, checks)
    assert [tuple(r) for r in once.collect()] == [("x", True), ("x in g2", False), ("self", True), ("en", True)]
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {r["answer"] for r in patterns.asked_once(quads.limit(0), checks).collect()} == {False}
    assert sorted(map(tuple, patterns.match_in(quads, "?g", ("?s", "<p>", "?o")).select("g", "s", "o").collect())) == [("<g1>", "<a>", '"x"'), ("<g2>", "<a>", '"y"@en')]
    assert [tuple(r) for r in patterns.match_in(quads, "?g", ("?g", "<q>", "?o")).select("g", "o").collect()] == [("<http://h>", "<c>")]
    assert [tuple(r) for r in patterns.match_in(quads, "g2", ("?s", "<q>", "?s")).collect()] == [("<b>",)]


def test_isolation(spark):
    frame = lambda rows: spark.createDataFrame(rows, "instance string, label string")
    own = frame([("a", "A"), ("b", "B"), ("c", "C")])
    assert patterns.isolation_faults(own, own.unionByName(frame([("a", "else"), ("a", "A")]))).count() == 0
    got = patterns.isolation_faults(own, frame([("a", "A"), ("a", "B"), ("b", "B"), ("a", "B")]))
    assert sorted(map(tuple, got.collect())) == [("a", "b", "LEAKED"), ("c", "c", "HIDDEN")]
