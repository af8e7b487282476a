"""Read-only graph patterns over the union of a generation's graphs, as DataFrame calls.

A pattern is (s, p, o) where a string that starts with `?` is a variable, and `a` as predicate is rdf:type. There is no query
text and no planner: joins go to Catalyst. A FILTER is a condition on the bindings: select(...).where(...), with lexical() of a term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def literal(lex: str, lang: str | None = None, datatype: str | None = None) -> str:
    """The term of a plain, tagged or typed literal."""
    escaped = lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{escaped}"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")


def lexical(term: Column) -> Column:
    """STR(): what stands between the quotes of a literal, or the brackets of an IRI."""
    return F.when(term.startswith("<"), F.regexp_extract(term, "^<(.*)>$", 1)).otherwise(F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1))


def language(term: Column) -> Column:
    return F.regexp_extract(term, '"@([A-Za-z0-9-]+)$', 1)


def union_of(dataset: DataFrame, graphs: list[str] | None = None) -> DataFrame:
    """The logical dataset: distinct triples of the named graphs, or of all."""
    rows = dataset if graphs is None else dataset.where(F.col("graph").isin(graphs))
    return rows.select("s", "p", "o").distinct()


def match(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of one pattern."""
    rows, bound = triples, {}
    pattern = (pattern[0], TYPE if pattern[1] == "a" else pattern[1], pattern[2])
    for column, term in zip(("s", "p", "o"), pattern):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term in bound:
            rows = rows.where(F.col(column) == F.col(bound[term]))
        else:
            bound[term] = column
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in bound.items()])


def select(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a basic graph pattern; patterns must share a variable with those before them."""

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError("a pattern without a shared variable would be a cross product; ask for each part")
        return left.join(right, shared)

    return reduce(joined, [match(triples, p) for p in patterns])


def ask(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    return select(triples, patterns).limit(1).agg((F.count("*") > 0).alias("answer"))


def suite(triples: DataFrame, checks: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    """name, answer of each check: whether its patterns have a binding."""
    return reduce(DataFrame.unionByName, [ask(triples, p).select(F.lit(name).alias("name"), "answer") for name, p in checks.items()])


def quads(dataset: DataFrame) -> DataFrame:
    """graph, s, p, o of a dataset (graph, line)."""
    parts = F.split("line", " ", 3)
    return dataset.select("graph", F.get(parts, F.lit(0)).alias("s"), F.get(parts, F.lit(1)).alias("p"), F.regexp_replace(F.get(parts, F.lit(2)), r"\s*\.$", "").alias("o"))


def match_in(rows: DataFrame, graph: str, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of GRAPH graph { pattern } over quads; graph is an IRI's text, or a variable, which is bound as well."""
    if graph.startswith("?"):
        found = rows.select(F.concat(F.lit("<"), "graph", F.lit(">")).alias("_g"), "s", "p", "o")
        same = [c for c, t in zip("spo", pattern) if t == graph]  # a variable that also stands in the pattern
        for c in same:
            found = found.where(F.col(c) == F.col("_g"))
        variables = {t[1:]: c for c, t in reversed(list(zip("spo", pattern))) if t.startswith("?")}
        found = found.where(holds(pattern))
        return found.select(F.col("_g").alias(graph[1:]), *[F.col(c).alias(v) for v, c in sorted(variables.items()) if v != graph[1:]])
    return match(rows.where(F.col("graph") == graph), pattern)


def holds(pattern: tuple[str, str, str], graph: str | None = None) -> Column:
    """Whether a row of triples, or of quads where a graph is named, matches one pattern."""
    pattern = (pattern[0], TYPE if pattern[1] == "a" else pattern[1], pattern[2])
    tests, first = [F.lit(True)], {}
    for column, term in zip("spo", pattern):
        if not term.startswith("?"):
            tests.append(F.col(column) == term)
        elif term in first:
            tests.append(F.col(column) == F.col(first[term]))
        else:
            first[term] = column
    if graph is not None and not graph.startswith("?"):
        tests.append(F.col("graph") == graph)
    return reduce(Column.__and__, tests)


def asked_once(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """name, answer of checks that each look for one row (conditions, such as `holds(...) & filter`): all in a single scan and one aggregate."""
    found = rows.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"c{k}") for k, c in enumerate(checks.values())])
    return found.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("answer")) for k, name in enumerate(checks)])))


def isolation_faults(own: DataFrame, seen: DataFrame) -> DataFrame:
    """own (instance, label), seen (instance, label) -> instance, other, fault: labels of another instance that one shows (LEAKED), and instances that don't
    show their own (HIDDEN, with other = instance). By label, so no instance meets all others."""
    own, seen = own.distinct(), seen.distinct()
    met = seen.join(own.withColumnRenamed("instance", "other"), "label")
    leaked = met.where("other <> instance").select("instance", "other", F.lit("LEAKED").alias("fault")).distinct()
    hidden = own.join(seen, ["instance", "label"], "left_anti").select("instance", F.col("instance").alias("other"), F.lit("HIDDEN").alias("fault")).distinct()
    return leaked.unionByName(hidden)


def construct(bindings: DataFrame, template: list[tuple[str, str, str]]) -> DataFrame:
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    parts = [bindings.select(*[term(t).alias(c) for c, t in zip(("s", "p", "o"), row)]) for row in template]
    return reduce(DataFrame.unionByName, parts).distinct()


def describe(triples: DataFrame, subject: str) -> DataFrame:
    return triples.where(F.col("s") == subject)
