"""The state machine of a source against a loop over events in cursor order, and the verified stream against the machine."""

import datetime as dt
import random

import pytest

from tessera.operators import machine
from tessera.streaming import apply as A

EVENTS = "source string, ts timestamp_ntz, rcid long, action string, entity_id string, revid long, old_revid long"
T0 = dt.datetime(2024, 1, 1)
TEXTS = "entity_id string, revid long, kind string, line string"


def text(entity, revid, said=None):
    rows = [(entity, revid, "entity", f'<http://b/entity/{entity}> <http://schema.org/version> "{said or revid}"^^<http://www.w3.org/2001/XMLSchema#integer> .')]
    return rows + ([(entity, revid, "schema", f"<http://b/prop/direct/{entity}> <p> \"{revid}\" .")] if entity[0] == "P" else [])


def loop(events, resolved, texts, states):
    """One source, one event after the other; each as a coordinator would take it."""
    texts = {(e, r): [x for x in texts if x[:2] == (e, r)] for e, r, _, _ in texts}
    states = {e: list(s) for e, s in states.items()}
    graphs, cursor = {}, None

    def edit(e, revid, old, restore):
        row = states.get(e, [0, 0, "PENDING"])
        if restore and row[2] not in ("DELETED", "RESTORING", "CURRENT"):
            return "UNDELETE_WITHOUT_TOMBSTONE"
        if not restore:
            if revid <= row[0]:
                states[e] = row
                return None
            if row[0] and old != row[0]:
                states[e] = [row[0], revid, "GAP"]
                return "REVISION_GAP"
        else:
            states[e] = [row[0], row[1], "RESTORING"]
        found = texts.get((e, revid), [])
        own, schema = [x[3] for x in found if x[2] == "entity"], [x[3] for x in found if x[2] == "schema"]
        if not own:
            return "ENTITY_MISSING"
        if e[0] == "P" and not schema:
            return "PROPERTY_SCHEMA_PARTITION_MISSING"
        if f'/{e}> <http://schema.org/version> "{revid}"' not in own[0]:
            return "BACKEND_VERIFY_FAILED"
        states[e] = [revid, max(row[1], revid), "CURRENT"]
        graphs[f"urn:kg:entity:{e}"] = set(own)
        if e[0] == "P":
            graphs[f"urn:kg:schema:{e}"] = set(schema)
        return None

    for ts, rcid, action, e, revid, old in sorted(events, key=lambda x: x[:2]):
        code = None
        if action == "UNKNOWN":
            code = "AMBIGUOUS_EVENT"
        elif action == "ENTITY_DELETE":
            row = states.get(e, [0, 0, "PENDING"])
            states[e] = [*row[:2], "DELETED"]
            graphs[f"urn:kg:entity:{e}"] = set()
            if e[0] == "P":
                graphs[f"urn:kg:schema:{e}"] = set()
        elif action in ("ENTITY_UNDELETE", "ENTITY_MERGE", "ENTITY_REDIRECT"):
            clear, entities = resolved.get(rcid, (False, []))
            code = None if clear and entities else "AMBIGUOUS_LIFECYCLE"
            for who, at in entities if code is None else []:
                code = edit(who, at, states.get(who, [0])[0], action == "ENTITY_UNDELETE")
                if code:
                    break
        elif action != "NON_ENTITY_CHANGE":
            code = edit(e, revid, old, False)
        if code:
            return states, graphs, cursor, code
        cursor = (ts, rcid)
    return states, graphs, cursor, None


def history(seed):
    rng = random.Random(seed)
    names, heads, events, resolved, texts = ["Q1", "Q2", "Q3", "P4", "P5"], {}, [], {}, []
    for rcid in range(1, 40):
        e, ts = rng.choice(names), T0 + dt.timedelta(seconds=rcid // 2)
        action = rng.choices(["ENTITY_EDIT", "ENTITY_DELETE", "ENTITY_UNDELETE", "ENTITY_MERGE", "NON_ENTITY_CHANGE", "UNKNOWN"], [60, 8, 8, 8, 8, 1])[0]
        if action == "NON_ENTITY_CHANGE":
            events.append((ts, rcid, action, None, None, None))
            continue
        touched = sorted({e, rng.choice(names)}) if action == "ENTITY_MERGE" else [e]
        for x in touched if action not in ("ENTITY_DELETE", "UNKNOWN") else []:
            old, heads[x] = heads.get(x, 0), heads.get(x, 0) + rng.choices([0, 1, 2], [1, 30, 1])[0]
            if rng.random() > 0.02:
                texts += text(x, heads[x], 7_777 if rng.random() < 0.02 else None)[: 1 if rng.random() < 0.03 else None]
        if action in ("ENTITY_UNDELETE", "ENTITY_MERGE"):
            resolved[rcid] = (rng.random() > 0.03, [(x, heads[x]) for x in touched])
        events.append((ts, rcid, action, e, heads.get(e, 0), max(0, heads.get(e, 0) - 1)))
    return events, resolved, sorted(set(texts)), {"Q1": (0, 0, "CURRENT"), "P4": (0, 0, "DELETED")}


def frames(spark, sources):
    rows, found, texts, states = [], [], [], []
    for k, (events, resolved, own, first) in enumerate(sources):
        tag = lambda e: None if e is None else f"{e}{k}"
        rows += [(f"s{k}", ts, rcid, action, tag(e), r, o) for ts, rcid, action, e, r, o in events]
        found += [(f"s{k}", rcid, clear, [(tag(e), tag(e), r, False) for e, r in entities]) for rcid, (clear, entities) in resolved.items()]
        texts += [(tag(e), r, kind, line.replace(f"/{e}>", f"/{e}{k}>")) for e, r, kind, line in own]
        states += [(tag(e), *s) for e, s in first.items()]
    return spark.createDataFrame(rows, EVENTS), spark.createDataFrame(found, A.RESOLVED), spark.createDataFrame(texts, TEXTS), spark.createDataFrame(states, machine.STATE)


def test_machine_equals_a_loop(spark):
    sources = [history(seed) for seed in range(40)]
    events, resolved, texts, states = frames(spark, sources)
    decided = machine.outcomes(machine.fold(machine.steps(events, resolved), states, texts, 4))
    decided = spark.createDataFrame(decided.collect(), decided.schema)
    got = {r["entity_id"]: tuple(r)[1:] for r in machine.entity_states(decided, states).select("entity_id", "indexed_revision", "latest_seen_revision", "status").collect()}
    told = {r["source"]: r for r in machine.source_states(decided).collect()}
    before = spark.createDataFrame([(f"urn:kg:entity:{e}{k}", "old") for k in range(len(sources)) for e in ("Q1", "Q2", "P4")], "graph string, line string")
    graphs: dict = {}
    for graph, line in machine.applied(before, decided, texts).collect():
        graphs.setdefault(graph, set()).add(line)
    codes = set()
    for k, source in enumerate(sources):
        want_states, want_graphs, cursor, code = loop(*source)
        codes.add(code)
        known = lambda x: {e: s for e, s in x.items() if s != (0, 0, "PENDING")}
        assert known({e: tuple(s) for e, s in want_states.items()}) == known({e[:2]: s for e, s in got.items() if e[2:] == str(k)}), k
        row = told[f"s{k}"]
        assert (row["code"], row["status"]) == (code, "REBUILD_REQUIRED" if code else "HEALTHY") and ((row["ts"], row["rcid"]) if row["rcid"] else None) == cursor, k
        for e in ("Q1", "Q2", "Q3", "P4", "P5"):
            for kind in ("entity", "schema"):
                want = want_graphs.get(f"urn:kg:{kind}:{e}", {"old"} if kind == "entity" and e in ("Q1", "Q2", "P4") else set())
                assert graphs.get(f"urn:kg:{kind}:{e}{k}", set()) == {x.replace(f"/{e}>", f"/{e}{k}>") for x in want}, (k, e, kind)
    assert len(codes) >= 6, codes


def test_machine_of_nothing(spark):
    events, resolved, texts, states = (f.limit(0) for f in frames(spark, [history(0)]))
    decided = machine.outcomes(machine.fold(machine.steps(events, resolved), states, texts, 2))
    assert decided.count() == 0 and machine.entity_states(decided, states).count() == 0 and machine.source_states(decided).count() == 0


ROWS = [
    ("s", T0, 1, "ENTITY_EDIT", "Q1", 10, 0), ("s", T0, 2, "ENTITY_EDIT", "P2", 5, 0), ("s", T0, 3, "ENTITY_EDIT", "Q1", 11, 10),
    ("s", T0, 4, "ENTITY_EDIT", "Q1", 10, 0), ("s", T0, 5, "ENTITY_DELETE", "P2", None, None), ("s", T0, 6, "ENTITY_EDIT", "Q3", 4, 0), ("s", T0, 7, "ENTITY_EDIT", "Q1", 12, 11),
]


def run(spark, tmp_path, texts, phase=lambda *a: None):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    contents = lambda: spark.createDataFrame(texts, TEXTS)
    query = A.apply_stream(stream, contents, f"{tmp_path}/root", f"{tmp_path}/checkpoint", on_phase=phase)
    try:
        query.awaitTermination()
        return None
    except Exception as error:
        return str(error)


def seen(spark, tmp_path, before):
    root = A.Root(spark, f"{tmp_path}/root")
    states = {r["entity_id"]: (r["indexed_revision"], r["latest_seen_revision"], r["status"]) for r in root.read("states").collect()}
    return sorted(map(tuple, A.applied(spark, root.path, before).collect())), states, [(r["rcid"], r["status"], r["code"]) for r in root.read("sources").collect()]


def test_stream_verifies_stops_and_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "COMPACT", 2)
    for k, part in enumerate((ROWS[:3], ROWS[3:])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    before = spark.createDataFrame([("urn:kg:entity:Q1", "old"), ("urn:kg:entity:Q3", "old"), ("urn:kg:global", "g")], "graph string, line string")
    line = lambda e, r: text(e, r)[0][3]
    texts = [x for e, r in (("Q1", 10), ("Q1", 11), ("Q1", 12), ("P2", 5)) for x in text(e, r)]
    first = None
    for phase in A.PHASES:  # cut off at each phase of the second batch: what the first one did stays, and nothing else is seen

        def cut(name, batch, phase=phase):
            if name == phase and batch == 1:
                raise RuntimeError(f"INJECTED_{phase}")

        assert f"INJECTED_{phase}" in run(spark, tmp_path, texts, cut)
        now = seen(spark, tmp_path, before)
        first = first or now
        assert now == first and now[1] == {"Q1": (11, 11, "CURRENT"), "P2": (5, 5, "CURRENT")} and now[2] == [(3, "HEALTHY", None)]
        assert ("urn:kg:schema:P2", text("P2", 5)[1][3]) in now[0]
    held = [("urn:kg:entity:Q1", line("Q1", 11)), ("urn:kg:entity:Q3", "old"), ("urn:kg:global", "g")]
    assert "s stopped: ENTITY_MISSING" in run(spark, tmp_path, texts)  # Q3 has no text: what came before it is done, P2's delete too
    assert seen(spark, tmp_path, before) == (held, {"Q1": (11, 11, "CURRENT"), "P2": (5, 5, "DELETED"), "Q3": (0, 0, "PENDING")}, [(5, "REBUILD_REQUIRED", "ENTITY_MISSING")])
    wrong = text("Q3", 4, 5)
    assert "s stopped: BACKEND_VERIFY_FAILED" in run(spark, tmp_path, texts + wrong)
    assert seen(spark, tmp_path, before)[0] == held
    assert run(spark, tmp_path, texts + text("Q3", 4)) is None
    graphs, states, sources = seen(spark, tmp_path, before)
    assert graphs == [("urn:kg:entity:Q1", line("Q1", 12)), ("urn:kg:entity:Q3", line("Q3", 4)), ("urn:kg:global", "g")]
    assert states == {"Q1": (12, 12, "CURRENT"), "P2": (5, 5, "DELETED"), "Q3": (4, 4, "CURRENT")} and sources == [(7, "HEALTHY", None)]


@pytest.mark.parametrize("event, code", [(("s", T0, 2, "ENTITY_EDIT", "Q1", 9, 7), "REVISION_GAP"), (("s", T0, 2, "UNKNOWN", "Q1", 2, 1), "AMBIGUOUS_EVENT"), (("s", T0, 2, "ENTITY_MERGE", "Q1", 2, 1), "AMBIGUOUS_LIFECYCLE")])
def test_stream_stops(spark, tmp_path, event, code):
    spark.createDataFrame([("s", T0, 1, "ENTITY_EDIT", "Q1", 1, 0), event, ("s", T0, 3, "ENTITY_EDIT", "Q2", 1, 0)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    before = spark.createDataFrame([], "graph string, line string")
    assert f"s stopped: {code}" in run(spark, tmp_path, text("Q1", 1) + text("Q1", 9) + text("Q2", 1))
    graphs, states, sources = seen(spark, tmp_path, before)
    assert graphs == [("urn:kg:entity:Q1", text("Q1", 1)[0][3])] and sources == [(1, "REBUILD_REQUIRED", code)]
    assert states == {"Q1": (1, 9, "GAP") if code == "REVISION_GAP" else (1, 1, "CURRENT")}
