import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.errors import PySparkException

from tessera.functions.escapes import decode_text, encode_text
from tessera.operators import compare, control, normalize, partition, patterns
from tessera.sources import triples as T
from tessera.sources.generations import Generations, StalePointer

E, S = "<http://b/entity/Q1>", "<http://b/entity/statement/Q1-1>"
MINI = [
    f'{E} <http://b/label> "x"@en .',
    f"{E} <http://b/prop/P1> {S} .",
    f"{S} <http://b/prop/statement/value/P1> <http://b/value/v1> .",
    '<http://b/value/v1> <http://b/amount> "+0042.00"^^<http://www.w3.org/2001/XMLSchema#decimal> .',
    "<http://b/entity/P1> <http://b/novalue> <http://b/prop/novalue/P1> .",
    "<http://b/prop/novalue/P1> <http://b/complementOf> _:x .",
    '_:x <http://b/type> "Restriction" .',
    '<http://other/thing> <http://b/p> "free" .',
]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_partition_of_a_small_graph(spark):
    out = partition.partition(T.scan(lines(spark, MINI))).collect()
    graphs = {}
    for r in out:
        graphs.setdefault(r["graph"], set()).add(MINI.index(r["line"]))
    assert graphs == {"urn:kg:entity:Q1": {0, 1, 2, 3}, "urn:kg:entity:P1": {4}, "urn:kg:schema:P1": {5, 6}, "urn:kg:global": {7}}


def test_shared_nodes_are_copied_to_each_owner(spark):
    two = MINI + [s.replace("Q1", "Q2") for s in MINI[:3]]
    out = partition.partition(T.scan(lines(spark, two)).dropDuplicates(["line"]))
    assert out.where("line like '%amount%'").count() == 2


def test_scan_rejects_bad_lines(spark):
    with pytest.raises(PySparkException, match="unsupported N-Triples line"):
        T.scan(lines(spark, ["<a> <b> nonsense ."])).collect()
    with pytest.raises(PySparkException, match="UNKNOWN_DUMP_METADATA"):
        normalize.kept(T.scan(lines(spark, ['<http://wikiba.se/ontology#Dump> <http://x> "1" .']))).collect()


def test_decimals_and_quads(spark):
    row = lines(spark, [MINI[3]]).select(normalize.line_form(T.F.col("line")).alias("x")).first()
    assert '"42"^^' in row["x"]
    cases = ["+0042.00", "-0.0", "0.50", "100", "-007.10"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(normalize.decimal(T.F.col("c"))).collect()]
    assert got == ["42", "0", "0.5", "100", "-7.1"]
    quad = lines(spark, MINI[:1]).select(T.quad_line(T.F.col("line"), T.F.lit("urn:g")).alias("line"))
    assert T.scan_quads(quad).first().asDict() == {"line": MINI[0], "g": "urn:g"}


def test_line_form_decodes_escapes_of_every_line(spark):
    u = chr(92) + "u"
    cases = {
        f'<s>\t\t<p> "{u}65E5x"@ja .': f'<s> <p> "{chr(0x65E5)}x"@ja .',
        f'<s> <p> "a{chr(92)}U0001F600 {u}0022" .': f'<s> <p> "a{chr(0x1F600)} {u}0022" .',
        f'<s> <p> "{u}002B05.0"^^<http://www.w3.org/2001/XMLSchema#decimal> .': '<s> <p> "5"^^<http://www.w3.org/2001/XMLSchema#decimal> .',
        '<s> <p> ""^^<http://www.w3.org/2001/XMLSchema#decimal> .': '<s> <p> ""^^<http://www.w3.org/2001/XMLSchema#decimal> .',
        '<s> <p> "plain" .': '<s> <p> "plain" .',
    }
    out = lines(spark, cases).select("line", normalize.line_form(T.F.col("line")).alias("x")).collect()
    assert {r["line"]: r["x"] for r in out} == cases


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.nt").write_text("# c\n\n" + "\n".join(MINI) + "\n")
    assert T.read_lines(spark, f"file://{tmp_path}/a.nt").count() == len(MINI)


def test_colours_ignore_labels(spark):
    shape = ['_:a <p> "1" .', "_:a <q> _:b .", '_:b <p> "2" .', '_:c <p> "3" .', '_:d <p> "3" .']
    one = compare.colours(T.scan(lines(spark, shape))).collect()
    two = compare.colours(T.scan(lines(spark, [s.replace("_:a", "_:zz") for s in shape]))).collect()
    assert sorted(r["colour"] for r in one) == sorted(r["colour"] for r in two)
    by = {r["node"]: r["colour"] for r in one}
    assert by["_:c"] == by["_:d"] and len(set(by.values())) == 3


def slow_colours(rows):
    """Classes of blank nodes of (s, p, o), refined for n + 1 rounds on whole signatures."""
    nodes = sorted({x for s, _, o in rows for x in (s, o) if x.startswith("_:")})
    now = dict.fromkeys(nodes, 0)
    for _ in range(len(nodes) + 1):
        show = lambda x, n, now=now: "@SELF" if x == n else ("@", now[x]) if x in now else x
        signs = {n: repr(sorted(repr((show(s, n), p, show(o, n))) for s, p, o in rows if n in (s, o))) for n in nodes}
        place = {x: k for k, x in enumerate(sorted(set(signs.values())))}
        now = {n: place[signs[n]] for n in nodes}
    return now


@pytest.mark.parametrize("ends", ["12", "11"])
def test_colours_of_long_chains(spark, ends):
    rows = [(f"_:{c}{k}", "<next>", f"_:{c}{k + 1}") for c in "ab" for k in range(9)] + [(f"_:{c}9", "<value>", f'"{e}"') for c, e in zip("ab", ends)]
    want = slow_colours(rows)
    got = {r["node"]: r["colour"] for r in compare.colours(T.scan(lines(spark, [f"{s} {p} {o} ." for s, p, o in rows]))).collect()}
    assert len(got) == 20 and len(set(got.values())) == len(set(want.values())) == (20 if ends == "12" else 10)
    assert all((got[x] == got[y]) == (want[x] == want[y]) for x in got for y in got)


def test_diff(spark):
    a, b = [spark.createDataFrame(x, "graph string, line string") for x in ([("g", "1"), ("g", "2")], [("g", "2"), ("h", "3")])]
    assert sorted(map(tuple, compare.diff(a, b, ["graph", "line"]).collect())) == [("canonicalOnly", "g", "1"), ("generationOnly", "h", "3")]
    assert {r["graph"]: (r["missing"], r["extra"], r["valid"]) for r in compare.by_graph(a, b).collect()} == {"g": (1, 0, False), "h": (0, 1, False)}


def test_diff_of_canonical_forms(spark):
    u, decimal = chr(92) + "u", "^^<http://www.w3.org/2001/XMLSchema#decimal>"
    one = [("g", f'<s> <p> "+0042.00"{decimal} .'), ("g", f'<s>\t<p> "{u}65E5" .'), ("g", "<s> <p> _:a ."), ("g", "_:a <p> _:b ."), ("g", '_:b <p> "2" .'), ("h", "<s> <p> _:a ."), ("g", "_:t <p> <s> ."), ("g", "_:u <p> <s> .")]
    two = [("g", f'<s> <p> "42"{decimal} .'), ("g", f'<s> <p> "{chr(0x65E5)}" .'), ("g", "<s> <p> _:b ."), ("g", "_:b <p> _:zz ."), ("g", '_:zz <p> "2" .'), ("h", "<s> <p> _:b ."), ("g", "_:t <p> <s> ."), ("g", "_:u <p> <s> .")]
    other = [(g, x.replace('"2"', '"3"')) for g, x in two]
    a, b, c = [spark.createDataFrame(x, "graph string, line string") for x in (one, two, other)]
    assert compare.diff(a, b, ["graph", "line"]).count() == 0
    assert {r["graph"]: (r["missing"], r["extra"], r["valid"]) for r in compare.by_graph(a, b).collect()} == {"g": (0, 0, True), "h": (0, 0, True)}
    assert sum('"3"' in r["line"] for r in compare.diff(a, c, ["graph", "line"]).collect()) == 1
    moved = spark.createDataFrame([(g, x.replace("_:b", "_:other") if g == "h" else x) for g, x in two], "graph string, line string")
    assert compare.diff(b, moved, ["graph", "line"]).count() > 0  # labels hold for the whole dataset


def test_patterns(spark):
    t = T.scan(lines(spark, MINI)).select("s", "p", "o")
    assert patterns.select(t, [("?e", "<http://b/prop/P1>", "?s"), ("?s", "<http://b/prop/statement/value/P1>", "?v")]).first()["v"] == "<http://b/value/v1>"
    assert not patterns.ask(t, [("?x", "<http://none>", "?y")]).first()["answer"]
    with pytest.raises(ValueError):
        patterns.select(t, [("?a", "<p>", "?b"), ("?c", "<p>", "?d")])


def test_pointer_is_compare_and_swap(spark, tmp_path):
    store = Generations(spark, f"file://{tmp_path}/g")
    data = spark.createDataFrame([("g", "GLOBAL", "l")], "graph string, partition_kind string, line string")
    store.load("a", data)
    store.load("b", data)
    store.promote("a", 0)
    with pytest.raises(StalePointer):
        store.promote("b", 0)
    assert store.promote("b", 1)["previous"] == "a"
    assert store.rollback(2)["generation"] == "a"
    with pytest.raises(ValueError):
        store.promote("missing", 3)
    late = Generations(spark, f"file://{tmp_path}/g")
    late.pointer = lambda: {"version": 2, "generation": "b", "previous": "a"}  # read before the other's promotion
    with pytest.raises(StalePointer):
        late.promote("b", 2)
    assert store.read().count() == 1


def test_legal_and_routable(spark):
    row = spark.range(1).select(
        control.legal(T.F.lit("READY"), T.F.lit("SERVING")), control.legal(T.F.lit("RETIRED"), T.F.lit("SERVING")),
        control.routable(T.F.lit("RETIRING"), T.F.lit("ROLLBACK")), control.routable(T.F.lit("RETIRED"), T.F.lit("NONE")), control.health(T.F.lit("STALE")),
    ).first()
    assert tuple(row) == (True, False, True, False, "degraded")


def test_escapes():
    u = chr(92) + "u"
    assert decode_text(f"{u}65E5 {u}0022 {chr(92)}{u}0041 {chr(92)}U0001F600") == chr(0x65E5) + f" {u}0022 {chr(92)}{u}0041 " + chr(0x1F600)
    assert encode_text(chr(0x65E5) + "a" + chr(0x1F600)) == f"{u}65E5a{chr(92)}U0001F600"


def slow_isomorphic(a, b):
    """Whether some renaming of blank nodes makes one set of triples the other."""
    nodes = lambda rows: sorted({x for r in rows for x in r if x.startswith("_:")})
    if len(nodes(a)) != len(nodes(b)) or len(set(a)) != len(set(b)):
        return False
    for order in itertools.permutations(nodes(b)):
        name = dict(zip(nodes(a), order))
        if {tuple(name.get(x, x) for x in r) for r in a} == set(b):
            return True
    return False


def canonical_lines(spark, rows):
    return sorted(r["line"] for r in compare.canonical_text(lines(spark, [" ".join((*r, ".")) for r in rows])).collect())


RING = [(f"_:n{k}", "<p>", f"_:n{(k + 1) % 6}") for k in range(6)]
TWO_RINGS = [(f"_:n{k}", "<p>", f"_:n{k // 3 * 3 + (k + 1) % 3}") for k in range(6)]
PAIRS = [("_:a", "<p>", "_:b"), ("_:b", "<p>", "_:a"), ("_:c", "<p>", "_:d"), ("_:d", "<p>", "_:c")]


@pytest.mark.parametrize("a,b", [
    (RING, TWO_RINGS), (RING, [(s[:2] + "x" + s[3:], p, o[:2] + "x" + o[3:]) for s, p, o in RING[::-1]]), (PAIRS, [(o, p, s) for s, p, o in PAIRS]),
    (PAIRS, PAIRS[:2] + [("_:c", "<p>", "_:c"), ("_:d", "<p>", "_:d")]), ([("_:a", "<p>", '"1"'), ("_:b", "<p>", '"1"')], [("_:z", "<p>", '"1"'), ("_:y", "<p>", '"1"')]),
    ([("_:a", "<p>", '"1"'), ("_:b", "<p>", '"1"')], [("_:z", "<p>", '"1"')]),
])
def test_canonical_text_tells_isomorphic_graphs(spark, a, b):
    one, two = canonical_lines(spark, a), canonical_lines(spark, b)
    assert (one == two) == slow_isomorphic(a, b) and len(one) == len(set(a))


def test_long_list_takes_few_rounds(spark, monkeypatch):
    """A list of 10,000 blank nodes, and an equal one whose labels are shuffled: colours in at most 40 written rounds, and no difference."""
    n, rng = 10_000, random.Random(4)
    label = rng.sample(range(n), n)
    first = [f"_:a{k} <p> _:a{k + 1} ." for k in range(n - 1)] + [f'_:a{n - 1} <q> "end" .']
    other = [f"_:b{label[k]} <p> _:b{label[k + 1]} ." for k in range(n - 1)] + [f'_:b{label[n - 1]} <q> "end" .']
    rounds = []
    real = compare.save
    monkeypatch.setattr(compare, "save", lambda df, name: rounds.append(name) or real(df, name))
    coloured = compare.colours(T.scan(lines(spark, first)))
    assert coloured.select("colour").distinct().count() == n and len(rounds) <= 40
    assert compare.diff(lines(spark, first), lines(spark, other), ["line"]).count() == 0
    assert compare.diff(lines(spark, first), lines(spark, other[1:]), ["line"]).count() == 2 * n - 1


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    n, rng = 2_000, random.Random(5)
    names = [f"_:{k:05d}" for k in rng.sample(range(n), n)]
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    edges = spark.createDataFrame(list(zip(names, names[1:])), "s string, o string")
    rounds = []
    real = compare.save
    monkeypatch.setattr(compare, "save", lambda df, name: rounds.append(name) or real(df, name))
    got = compare._components(nodes, edges).collect()
    assert {r["component"] for r in got} == {"_:00000"} and len(got) == n and len(rounds) <= 60


def test_search_has_a_limit(spark):
    rows = lines(spark, [f"_:a <p> _:b{k} ." for k in range(9)] + [f"_:b{k} <p> _:a ." for k in range(9)] + [f"_:c <p> _:d{k} ." for k in range(9)] + [f"_:d{k} <p> _:c ." for k in range(9)])
    with pytest.raises(Exception, match="RDF_CANONICALIZATION_SEARCH_LIMIT"):
        compare.canonical_text(rows).collect()


def test_partition_of_one_entity(spark):
    t = T.scan(lines(spark, MINI))
    entity = partition.entities(t).first()["entity_id"]
    assert partition.entity_partition(t, entity).where(f"graph like '%:entity:{entity}'").count() > 0
    with pytest.raises(ValueError):
        partition.entity_partition(t, "Q999")


def test_lax_scan_and_filters(spark):
    odd = lines(spark, ["<a> <b> nonsense .", '<a> <b> "x y"@en-GB .', "_:b <b> <c>."])
    out = sorted((r["s"], r["o"], r["o_kind"]) for r in T.scan(odd, strict=False).collect())
    assert out == [("<a>", '"x y"@en-GB', "literal"), ("<a>", "nonsense", "literal"), ("_:b", "<c>", "iri")]
    for bad in ("<a> <b>", "<a> _:p <c> .", '"s" <b> <c> .', "<a> <b> <c>", "<a> <b>  ."):
        with pytest.raises(Exception, match="UNSUPPORTED_SYNTAX"):
            T.scan(lines(spark, [bad]), strict=False).collect()
    assert patterns.literal('a"b\\', "ja") == '"a\\"b\\\\"@ja' and patterns.literal("1", datatype="x") == '"1"^^<x>'
    long = '<a> <b> "' + "x\\n" * 50_000 + '" .'
    assert len(T.terms(T.scan(lines(spark, [long]))).first()["o_lex"]) == 150_000


def test_replay_keeps_a_graph_without_text(spark):
    from tessera.operators import sync

    before = spark.createDataFrame([("urn:kg:entity:Q1", "old"), ("urn:kg:global", "g")], "graph string, line string")
    decided = spark.createDataFrame([("Q1", 5, "APPLY"), ("Q2", 1, "APPLY"), ("Q2", 2, "OLDER")], "entity_id string, revid long, decision string")
    contents = spark.createDataFrame([("Q2", 1, "new")], "entity_id string, revid long, line string")
    assert sorted(map(tuple, sync.replay(before, decided, contents).collect())) == [("urn:kg:entity:Q1", "old"), ("urn:kg:entity:Q2", "new"), ("urn:kg:global", "g")]
    assert list(map(tuple, sync.without_text(decided, contents).collect())) == [("Q1", 5)]


def test_reset_needs_its_token(spark):
    from tessera.operators import sync

    rows = lines(spark, MINI)
    assert sync.reset(rows, "i", "reset:i").count() == 0
    with pytest.raises(ValueError):
        sync.reset(rows, "i", "reset:j")


def test_small_rings_take_few_rounds(spark, monkeypatch):
    """Rings have no end, but doubling stops once it tells nothing new, however many rings there are."""
    rings = [f"_:r{k}x{j} <p> _:r{k}x{(j + 1) % 3} ." for k in range(200) for j in range(3)]
    rounds = []
    real = compare.save
    monkeypatch.setattr(compare, "save", lambda df, name: rounds.append(name) or real(df, name))
    assert compare.colours(T.scan(lines(spark, rings))).select("colour").distinct().count() == 1
    assert rounds.count("ways") <= 4


def saved(monkeypatch):
    """Names and frames that compare saves from here on."""
    made = []
    real = compare.save
    monkeypatch.setattr(compare, "save", lambda df, name: made.append((name, df)) or real(df, name))
    return made


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same_classes(spark, rows):
    want = slow_colours(rows)
    got = {r["node"]: r["colour"] for r in compare.colours(T.scan(lines(spark, [" ".join((*r, ".")) for r in rows]))).collect()}
    assert got.keys() == want.keys()
    return all((got[x] == got[y]) == (want[x] == want[y]) for x in got for y in got)


def test_lists_and_rings_need_no_rounds_over_all_lines(spark, monkeypatch):
    """Lists of 1 to 7 nodes, rings of 2, 3 and 6, and self-links: told apart by doubling alone, in which finished nodes take no further part."""
    rows = [(f"_:l{n}x{k}", "<p>", f"_:l{n}x{k + 1}" if k + 1 < n else f'"{n % 3}"') for n in range(1, 8) for k in range(n)]
    rows += [(f"_:r{n}{c}x{k}", "<p>", f"_:r{n}{c}x{(k + 1) % n}") for n in (2, 3, 6) for c in "ab" for k in range(n)] + [("_:r6ax0", "<q>", '"1"'), ("_:own", "<p>", "_:own"), ("_:also", "<p>", "_:also")]
    made = saved(monkeypatch)
    assert same_classes(spark, rows)
    assert not [name for name, _ in made if name in ("arcs", "colours")]
    counts = [df.count() for name, df in made if name == "ways"]
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]


def test_nodes_with_branches_are_refined(spark):
    rng = random.Random(6)
    rows = sorted({(f"_:{rng.randrange(12)}", rng.choice(["<p>", "<q>"]), rng.choice([f"_:{rng.randrange(12)}", '"1"'])) for _ in range(20)})
    assert same_classes(spark, rows)


def test_ids_that_clash_are_made_anew(spark, monkeypatch):
    real = compare._id
    monkeypatch.setattr(compare, "_id", lambda term, seed: real(term, seed) if seed else T.F.length(term).cast("long"))
    assert same_classes(spark, [("_:a", "<p>", "_:b"), ("_:b", "<p>", '"1"'), ("_:c", "<p>", '"1"')])


def test_colours_read_triples_once(spark, monkeypatch):
    made = saved(monkeypatch)
    compare.colours(T.scan(lines(spark, ['_:a <p> "1" .', "<s> <p> _:a ."]))).collect()
    assert plan(made[0][1]).count("LogicalRDD") == 1


def test_bridge_puts_a_line_together_once(spark):
    from tessera.plans import catalog

    kept = plan(catalog.kept_triples(spark, "/root/testdata/sf0.001").where("line like '%_:%' and s <> 'x' and o <> 'x'"))
    assert kept.count("concat_ws(") == 1


def test_diff_makes_what_it_compares_once_a_pass(spark):
    """Each side is read for lines with and without escapes; what makes its lines isn't repeated for every test of them, nor are rows grouped before they are dealt."""
    rows = spark.createDataFrame([("g", f"<s> <p> {k} .") for k in range(5)], "graph string, line string")
    other = rows.select("graph", T.F.replace("line", T.F.lit("4 ."), T.F.lit("5 .")).alias("line"))
    found = compare.diff(rows, other, ["graph", "line"])
    assert sorted(r["line"] for r in found.collect()) == ["<s> <p> 4 .", "<s> <p> 5 ."]
    assert len(re.findall(r"(?<!_)replace\(", plan(found))) == 2
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in physical and "bit_or" not in physical[physical.rindex("Exchange") :]
