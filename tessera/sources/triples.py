"""Triples as rows: N-Triples and N-Quads text in and out, and the bridge from the relational tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

# Terms after the grammar of N-Triples (IRIREF, BLANK_NODE_LABEL, STRING_LITERAL_QUOTE, LANGTAG). Looser where texts in use are:
# an IRI may hold any character but blanks and angle brackets, a literal may escape any character, and a language tag may begin with a digit.
IRI = r"<[^\x00-\x20<>]++>"
BNODE = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}_-])?"
QUOTED = r'"(?:[^"\\]++|\\.)*+"'
TAG = "@[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"
LITERAL = rf"{QUOTED}(?:{TAG}|\^\^{IRI})?"
#: Neither subject nor predicate has a blank in it, so a line falls apart at its first two runs of them.
BLANKS, STOP = r"\s+", r"\s*\.$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of N-Triples text files, trimmed, without blank and comment lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.where("line <> '' and line not like '#%'")


#: A whole line of the strict scan.
LINE = rf"^(?:{IRI}|{BNODE}){BLANKS}{IRI}{BLANKS}(?:{IRI}|{BNODE}|{LITERAL}){STOP}"
# Error codes of the two scans.
STRICT_CODE, LAX_CODE = "unsupported N-Triples line", "RDF_NORMALIZATION_UNSUPPORTED_SYNTAX"


def scan(lines: DataFrame, strict: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """lines (line) -> line, s, p, o and o_kind, and the columns to keep; a line that doesn't parse fails the job.

    Lines are checked once, by a filter of their own; the terms are plain parts of a split, so later filters on them stay cheap wherever Catalyst puts them.
    """
    parts = F.split("line", BLANKS, 3)
    s, p, rest = (F.get(parts, F.lit(k)) for k in range(3))
    o = F.regexp_replace(rest, STOP, "")
    fits = F.col("line").rlike(LINE) if strict else s.rlike(f"^(?:{IRI}|{BNODE})$") & p.rlike(f"^{IRI}$") & rest.rlike(STOP) & (o != "")
    fail = F.raise_error(F.concat(F.lit((STRICT_CODE if strict else LAX_CODE) + ": "), F.coalesce("line", F.lit("null"))))
    checked = lines.where(F.when(F.coalesce(fits, F.lit(False)), True).otherwise(fail.cast("boolean")))
    return parted(checked, keep)


def parted(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """lines (line) that scan() has checked -> line, s, p, o and o_kind, and the columns to keep. Most lines have single blanks and no other space, and need no pattern.

    A step builds on the columns of the one before, so that a line is split once.
    """
    odd = F.col("line").contains("  ")
    for c in "\t\n\x0b\f\r":
        odd = odd | F.col("line").contains(c)
    rows = lines.select(*keep, "line", odd.alias("_odd"))
    rows = rows.select(*keep, "line", "_odd", F.when(F.col("_odd"), F.split("line", BLANKS, 3)).otherwise(F.split("line", " ", 3)).alias("_parts"))
    rows = rows.select(*keep, "line", "_odd", *[F.get("_parts", F.lit(k)).alias(c) for k, c in enumerate(("s", "p", "_rest"))])
    o = F.when(~F.col("_odd") & F.endswith("_rest", F.lit(" .")), F.substr("_rest", F.lit(1), F.length("_rest") - 2)).otherwise(F.regexp_replace("_rest", STOP, ""))
    return rows.select(*keep, "line", "s", "p", o.alias("o")).select("*", kind(F.col("o")).alias("o_kind"))


def kind(term: Column) -> Column:
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "bnode").otherwise("literal")


def terms(triples: DataFrame) -> DataFrame:
    """Adds lexical form, language and datatype of literal objects."""
    lex = F.regexp_extract("o", rf"^({QUOTED})", 1)
    lex = F.substr(lex, F.lit(2), F.length(lex) - 2)
    return triples.select(
        "*",
        F.when(F.col("o_kind") == "literal", lex).alias("o_lex"),
        F.nullif(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("o_lang"),
        F.nullif(F.regexp_extract("o", r'"\^\^<([^>]+)>$', 1), F.lit("")).alias("o_datatype"),
    )


def quad_line(line: Column, graph: Column) -> Column:
    return F.concat(F.regexp_replace(line, r"\s*\.$", ""), F.lit(" <"), graph, F.lit("> ."))


def scan_quads(lines: DataFrame) -> DataFrame:
    """lines of N-Quads -> line (as a triple) and g; a line without a graph fails the job."""
    pattern = r"^(.*)\s<([^>]+)>\s*\.$"
    g = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 2)).otherwise(F.raise_error(F.lit("N-Quads line without a graph")))
    return lines.select(F.concat(F.regexp_extract("line", pattern, 1), F.lit(" .")).alias("line"), g.alias("g"))


# The bridge, in SQL that Spark and DuckDB both run: one row (s, p, o) for each triple.
BRIDGE = """
  select concat('<http://b/entity/Q', 1000000 + c_custkey, '>') as s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' as p, '<http://wikiba.se/ontology#Item>' as o from customer
  union all select concat('<http://b/entity/Q', 1000000 + c_custkey, '>'), '<http://www.w3.org/2000/01/rdf-schema#label>', concat('"', c_name, '"@en') from customer
  union all select concat('<http://b/entity/Q', 1000000 + c_custkey, '>'), '<http://b/prop/direct/P1>', concat('"', c_mktsegment, '"') from customer
  union all select concat('<http://b/entity/Q', 1000000 + c_custkey, '>'), '<http://b/prop/direct/P2>', concat('<http://b/entity/Q', 100 + c_nationkey, '>') from customer
  union all select concat('<http://b/wiki/Special:EntityData/Q', 1000000 + c_custkey, '>'), '<http://schema.org/version>', concat('"', c_custkey % 50 + 1, '"^^<http://www.w3.org/2001/XMLSchema#integer>') from customer
  union all select concat('<http://b/wiki/Special:EntityData/Q', 1000000 + c_custkey, '>'), '<http://schema.org/about>', concat('<http://b/entity/Q', 1000000 + c_custkey, '>') from customer
  union all select concat('<http://b/wiki/Special:EntityData/Q', 1000000 + c_custkey, '>'), '<http://schema.org/softwareVersion>', '"1.0.0"' from customer
  union all select concat('<http://b/entity/Q', 100 + n_nationkey, '>'), '<http://www.w3.org/2000/01/rdf-schema#label>', concat('"', n_name, '"@en') from nation
  union all select concat('<http://b/entity/Q', 100 + n_nationkey, '>'), '<http://b/prop/direct/P3>', concat('<http://b/entity/Q', 200 + n_regionkey, '>') from nation
  union all select concat('<http://b/wiki/Special:EntityData/Q', 100 + n_nationkey, '>'), '<http://schema.org/version>', concat('"', n_nationkey + 1, '"^^<http://www.w3.org/2001/XMLSchema#integer>') from nation
  union all select concat('<http://b/entity/Q', 1000000 + o_custkey, '>'), '<http://b/prop/P4>', concat('<http://b/entity/statement/Q', 1000000 + o_custkey, '-', o_orderkey, '>') from orders
  union all select concat('<http://b/entity/statement/Q', 1000000 + o_custkey, '-', o_orderkey, '>'), '<http://b/prop/statement/P4>', concat('"', o_orderstatus, '"') from orders
  union all select concat('<http://b/entity/statement/Q', 1000000 + o_custkey, '-', o_orderkey, '>'), '<http://b/prop/qualifier/value/P5>', concat('<http://b/value/v', cast(floor(o_totalprice / 1000) as bigint), '>') from orders
  union all select concat('<http://b/entity/statement/Q', 1000000 + o_custkey, '-', o_orderkey, '>'), '<http://www.w3.org/ns/prov#wasDerivedFrom>', concat('<http://b/reference/', md5(o_orderpriority), '>') from orders
  union all select distinct concat('<http://b/value/v', cast(floor(o_totalprice / 1000) as bigint), '>'), '<http://wikiba.se/ontology#quantityAmount>', concat('"+0', cast(floor(o_totalprice / 1000) as bigint), '.500"^^<http://www.w3.org/2001/XMLSchema#decimal>') from orders
  union all select distinct concat('<http://b/reference/', md5(o_orderpriority), '>'), '<http://b/prop/reference/P6>', concat('"', o_orderpriority, '"') from orders
  union all select concat('<http://b/entity/P', k, '>'), '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://wikiba.se/ontology#Property>' from props
  union all select concat('<http://b/entity/P', k, '>'), '<http://wikiba.se/ontology#directClaim>', concat('<http://b/prop/direct/P', k, '>') from props
  union all select concat('<http://b/entity/P', k, '>'), '<http://wikiba.se/ontology#novalue>', concat('<http://b/prop/novalue/P', k, '>') from props
  union all select concat('<http://b/prop/direct/P', k, '>'), '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://www.w3.org/2002/07/owl#DatatypeProperty>' from props
  union all select concat('<http://b/prop/novalue/P', k, '>'), '<http://www.w3.org/2002/07/owl#complementOf>', concat('_:genid', k) from props
  union all select concat('_:genid', k), '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://www.w3.org/2002/07/owl#Restriction>' from props
  union all select '<http://wikiba.se/ontology#Dump>', '<http://schema.org/dateModified>', concat('"2024-01-0', k, '"') from props
"""
PROPS = "props(k) as (values (1), (2), (3), (4), (5), (6))"
BRIDGED = f"with {PROPS}, bridge as ({BRIDGE})"


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational tables as lines of N-Triples.

    A line is made by a generator of one element, as filters aren't pushed through one: pushed into the union they would put each line together anew for every
    test of it, and those of terms would split it anew.
    """
    sql = BRIDGE
    for name in ("customer", "nation", "orders"):
        sql = sql.replace(f" from {name}", f" from {{{name}}}")
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders")}
    props = spark.range(1, 7).select(F.col("id").alias("k"))
    rows = spark.sql(sql.replace(" from props", " from {props}"), props=props, **frames)
    return rows.select(F.explode(F.array(F.concat_ws(" ", "s", "p", "o", F.lit(".")))).alias("line"))
