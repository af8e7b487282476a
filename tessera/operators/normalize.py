"""Normalising triples: export metadata apart, lexical forms, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import escapes
from ..sources.triples import parted

# Export metadata.
DUMP = "<http://wikiba.se/ontology#Dump>"
DUMP_PREDICATES = [
    "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>",
    "<http://creativecommons.org/ns#license>",
    "<http://schema.org/softwareVersion>",
    "<http://schema.org/dateModified>",
    "<http://www.w3.org/2002/07/owl#imports>",
]
EXPORT_PREDICATES = ["<http://creativecommons.org/ns#license>", "<http://schema.org/softwareVersion>"]


def routed(triples: DataFrame, full_dump: bool = True) -> DataFrame:
    """Adds category: DUMP_EXPORT, ENTITY_EXPORT or null for triples that are kept. An unknown dump predicate fails the job."""
    known = F.col("p").isin(DUMP_PREDICATES) if full_dump else F.lit(False)
    dump = F.when(known, "DUMP_EXPORT").otherwise(F.raise_error(F.concat(F.lit("RDF_NORMALIZATION_UNKNOWN_DUMP_METADATA: "), "p")))
    export = F.col("s").contains("/wiki/Special:EntityData/") & F.col("p").isin(EXPORT_PREDICATES)
    # most lines name neither, and their terms needn't be looked at
    neither = ~(F.col("line").contains(DUMP) | F.col("line").contains("/wiki/Special:EntityData/"))
    return triples.withColumn("category", F.when(neither, F.lit(None)).when(F.col("s") == DUMP, dump).when(export, "ENTITY_EXPORT"))


def kept(triples: DataFrame, full_dump: bool = True) -> DataFrame:
    """Distinct triples without export metadata. Only lines are shuffled, as terms are parts of them."""
    return parted(routed(triples, full_dump).where("category is null").select("line").distinct())


def provenance(triples: DataFrame, full_dump: bool = True) -> DataFrame:
    return routed(triples, full_dump).where("category is not null").select("category", F.col("p").alias("predicate"), F.col("o").alias("object"))


def decimal(lex: Column) -> Column:
    """The canonical form of a decimal: no plus, leading zeros, trailing fraction zeros or negative zero. What isn't digits with a sign or fraction stays."""
    # a sign, digits from the first that counts, and a fraction up to its last one that counts
    x = F.regexp_replace(lex, r"^\+?(-?)0*([0-9]+)(?:\.0*|(\.[0-9]*[1-9])0*)?$", "$1$2$3")
    return F.when(~lex.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), lex).when(lex.startswith("-") & (x == "-0"), "0").otherwise(x)


_DECIMAL = '"^^<http://www.w3.org/2001/XMLSchema#decimal>'


def line_form(line: Column) -> Column:
    """Tabs as one space, escapes as characters, decimals in canonical form."""
    line = F.when(line.contains("\t"), F.regexp_replace(line, r"\t+", " ")).otherwise(line)
    return _decimal_form(F.coalesce(escapes.decode(F.when(line.rlike(r"\\[uU]"), line)), line))


def in_line_form(rows: DataFrame) -> DataFrame:
    """rows with their column line in line_form(); only lines with an escape go through Python."""
    odd = F.coalesce(F.col("line").contains("\\u") | F.col("line").contains("\\U"), F.lit(False))
    plain = F.when(F.col("line").contains("\t"), F.regexp_replace("line", r"\t+", " ")).otherwise(F.col("line"))
    # made by a generator, as filters aren't pushed through one and so don't make the form anew for every test of it
    once = lambda form: F.explode(F.array(form))
    others = [c for c in rows.columns if c != "line"]
    few = rows.where(~odd).select(*others, plain.alias("line"))
    # a line with one literal falls apart at its quotes, and a number in it needs few patterns
    few = few.select(*others, "line", F.when(F.col("line").contains(_DECIMAL), F.split("line", '"')).alias("_parts"))
    part = lambda k: F.get("_parts", F.lit(k))
    single = (F.size("_parts") == 3) & part(2).startswith(_DECIMAL[1:])
    form = F.when(F.col("_parts").isNull(), F.col("line")).when(single, F.concat(part(0), F.lit('"'), decimal(part(1)), F.lit('"'), part(2))).otherwise(_decimal_form(F.col("line")))
    few, many = few.select(*others, once(form).alias("line")), rows.where(odd).select(*others, once(line_form(F.col("line"))).alias("line"))
    return few.unionByName(many).select(*rows.columns)


def _decimal_form(line: Column) -> Column:
    pattern = r'"([+-]?[0-9]+(?:\.[0-9]+)?)"(\^\^<http://www\.w3\.org/2001/XMLSchema#decimal>)'
    lex = F.regexp_extract(line, pattern, 1)
    head, tail = F.regexp_extract(line, f"(?s)^(.*){pattern}", 1), F.regexp_extract(line, f"(?s){pattern}(.*)$", 3)
    datatype = F.lit("^^<http://www.w3.org/2001/XMLSchema#decimal>")
    return F.when(line.contains(_DECIMAL) & line.rlike(pattern), F.concat(head, F.lit('"'), decimal(lex), F.lit('"'), datatype, tail)).otherwise(line)


#: What a line of each class contains anywhere; the first that it contains decides.
CLASSES = {
    "statement": "/entity/statement/",
    "reference": "/reference/",
    "value": "/value/",
    "qualifier": "/prop/qualifier/",
    "direct-claim": "/prop/direct/",
    "label": "rdf-schema#label",
    "description": "schema.org/description",
    "alias": "skos/core#altLabel",
    "entity-metadata": "Special:EntityData",
}


def triple_class(line: Column) -> Column:
    found = F.lit("other")
    for name, part in reversed(CLASSES.items()):
        found = F.when(line.contains(part), name).otherwise(found)
    return found


def checksum(lines: Column) -> Column:
    """SHA-256 of sorted distinct lines, a newline after each; an aggregate over a bounded graph, such as one entity's."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(lines)), "\n"), F.lit("\n")).cast("binary"), 256)
