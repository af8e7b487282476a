"""What stands in lines and differences: categories, treatments, values, summaries, and what must be there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import escapes
from ..functions.names import NAMES, Names
from .normalize import DUMP, EXPORT_PREDICATES, triple_class

# Categories of subjects by what they contain, in the order of the rules.
SUBJECTS = [("ENTITY", "/entity/Q"), ("ENTITY_DOCUMENT", "/wiki/Special:EntityData/"), ("BLANK_NODE", "_:"), ("VALUE", "/value/"), ("REFERENCE", "/reference/"), ("STATEMENT", "/entity/statement/")]
#: Predicates whose lines say how a text was serialised.
SERIALISATION = ["creativecommons.org/ns#license", "schema.org/softwareVersion"]


def subject_category(s: Column) -> Column:
    found = F.lit("OTHER")
    for name, part in reversed(SUBJECTS):
        found = F.when(s.startswith(part) if part == "_:" else s.contains(part), name).otherwise(found)
    return found


def object_category(o: Column) -> Column:
    return F.when(o.startswith("_:"), "BLANK_NODE").when(o.startswith("<"), "IRI").otherwise("LITERAL")


def subject_type(s: Column, names: Names = NAMES) -> Column:
    return F.when(s.contains("/wiki/Special:EntityData/"), "entity-export").when(s == DUMP, "dump-export").when(s.contains("/entity/"), names.entity_type).otherwise("other")


def treatment(s: Column, p: Column) -> Column:
    """(semantic, treatment) that is proposed for a difference: provenance moves to the manifest, all else is unknown."""
    # What a semantic and a treatment are called.
    of = lambda semantic, what: F.struct(F.lit(semantic).alias("semantic"), F.lit(what).alias("treatment"))
    export = s.contains("/wiki/Special:EntityData/") & p.isin(EXPORT_PREDICATES)
    return (
        F.when(s == DUMP, of("export-provenance", "MOVE_TO_GENERATION_MANIFEST"))
        .when(export, of("entity-export-provenance", "MOVE_TO_GENERATION_MANIFEST"))
        .otherwise(of("unclassified", "REJECT_UNKNOWN"))
    )


def classified(triples: DataFrame, source: str, stability: str, names: Names = NAMES) -> DataFrame:
    """What an inventory says of each triple of a source: predicate, subject_type, source, stability, semantic, treatment."""
    made = triples.select(F.regexp_extract("p", "^<(.*)>$", 1).alias("predicate"), subject_type(F.col("s"), names).alias("subject_type"), treatment(F.col("s"), F.col("p")).alias("t"))
    return made.select("predicate", "subject_type", F.lit(source).alias("source"), F.lit(stability).alias("stability"), "t.*")


def summary(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def diff_summary(differences: DataFrame) -> DataFrame:
    """direction, class and n of differences (direction, line)."""
    return summary(differences.select("direction", triple_class(F.col("line")).alias("class")), "direction", "class")


def manifest_values(provenance: DataFrame) -> DataFrame:
    """Distinct (predicate, value) of provenance rows; a row for each, so a predicate with many values is no group."""
    return provenance.select("predicate", F.col("object").alias("value")).distinct()


def without_serialisation(lines: DataFrame) -> DataFrame:
    return lines.where(~reduce(Column.__or__, [F.col("line").contains(x) for x in SERIALISATION]))


def older_line_form(line: Column) -> Column:
    """The older normal form: one space for tabs, all code-point escapes as characters, and decimals without plus and trailing zeros; leading zeros stay."""
    datatype = r"\^\^<http://www\.w3\.org/2001/XMLSchema#decimal>"
    line = F.regexp_replace(line, r"\t+", " ")
    line = F.coalesce(escapes.decode_all(F.when(line.rlike(r"\\[uU]"), line)), line)
    line = F.regexp_replace(line, rf'"\+(-?[0-9]+(?:\.[0-9]+)?)"(?={datatype})', '"$1"')
    # digits stand on both sides of a point before zeros go, and the point goes with them
    line = F.regexp_replace(line, rf'"(-?[0-9]+\.[0-9]*[1-9])0+"(?={datatype})', '"$1"')
    return F.regexp_replace(line, rf'"(-?[0-9]+)\.0+"(?={datatype})', '"$1"')


def missing(lines: DataFrame, needles: list[str]) -> DataFrame:
    """needle of each that no line contains: one pass, and one row per needle."""
    seen = lines.agg(*[F.coalesce(F.bool_or(F.contains("line", F.lit(n))), F.lit(False)).alias(f"n{k}") for k, n in enumerate(needles)])
    rows = F.array(*[F.struct(F.lit(n).alias("needle"), F.col(f"n{k}").alias("seen")) for k, n in enumerate(needles)])
    return seen.select(F.inline(rows)).where("not seen").select("needle")
