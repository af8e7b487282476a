"""Splitting triples into an entity graph each, a schema graph each property, and a global graph, by reachability.

All closures of all entities run together: a frontier of (owner, node) rows is joined with the triples on the subject until
it is empty. Rounds follow the depth of the data, not its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import NAMES, Names, checked_entity
from ..sources.store import save

# Objects that an entity's closure follows, and subjects that belong to an entity.
FOLLOWED = "/(entity/statement|value|reference)/"
ROOT = r"(?:/entity|/wiki/Special:EntityData)/([QP][1-9][0-9]*)>$"


#: Frontiers with about as many nodes at most are sent to all tasks, to see whether any arc goes on from them.
FEW = 50_000


def _closure(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(owner, node) reachable from seeds over arcs (s, o)."""
    seen = frontier = save(seeds.distinct(), "closure")
    while not frontier.isEmpty():
        onward = arcs
        if frontier.agg(F.approx_count_distinct("node")).first()[0] <= FEW:  # ends, such as values, are few though many own them; arcs needn't be shuffled for them
            nodes = save(frontier.select(F.col("node").alias("s")).distinct(), "nodes")
            onward = save(arcs.join(F.broadcast(nodes), "s", "left_semi"), "arcs")
            if onward.isEmpty():
                break
        step = frontier.join(onward, frontier["node"] == onward["s"]).select("owner", F.col("o").alias("node")).distinct()
        frontier = save(step.join(seen, ["owner", "node"], "left_anti"), "closure")
        seen = seen.unionByName(frontier)
    return seen


def entities(triples: DataFrame) -> DataFrame:
    found = F.regexp_extract("s", r"/entity/([QP][1-9][0-9]*)>$", 1)
    return triples.select(found.alias("entity_id")).where("entity_id <> ''").distinct()


def partition(triples: DataFrame, names: Names = NAMES, distinct: bool = False) -> DataFrame:
    """triples (line, s, p, o, o_kind) -> graph, partition_kind, line. A line that several entities reach is in each of their graphs. distinct: lines are known
    to occur once, as kept() gives them.

    A line goes where its subject belongs, so subjects are dealt to graphs first, and lines are joined to them once.
    """
    s = F.col("s")
    named = triples.where(s.contains("/entity/") | s.contains("/wiki/Special:EntityData/")).select(F.regexp_extract("s", ROOT, 1).alias("owner"), s.alias("node")).where("owner <> ''")
    named = save(named.distinct(), "named")
    own = named.where(F.col("node").rlike(r"/entity/[QP][1-9][0-9]*>$")).select("owner").distinct()
    followed = triples.where((F.col("o_kind") != "literal") & F.col("o").rlike(FOLLOWED)).select("s", "o")
    owned = _closure(save(followed, "arcs"), named.join(own, "owner", "left_semi"))

    properties = triples.where(s.contains("/entity/P")).select(F.regexp_extract("s", r"/entity/(P[1-9][0-9]*)>$", 1).alias("owner"), "o", "o_kind").where("owner <> '' and o_kind = 'iri'")
    seeds = save(properties.where(~F.col("o").rlike(FOLLOWED)).select("owner", F.col("o").alias("node")).distinct(), "seeds")
    known = triples.select(s.alias("node")).join(seeds.select("node").distinct(), "node", "left_semi").distinct()
    blanks = triples.where("o_kind = 'bnode'").select("s", "o")
    schema_nodes = _closure(save(blanks, "arcs"), seeds.join(known, "node", "left_semi").select("owner", "node"))

    lines = triples.select("s", "line") if distinct else triples.select("s", "line").distinct()
    held = owned.select("owner", "node", F.lit(True).alias("entity")).unionByName(schema_nodes.select("owner", "node", F.lit(False).alias("entity")))
    graph = F.when(F.col("entity"), names.graph("entity", checked_entity(F.col("owner")))).otherwise(names.graph("schema", checked_entity(F.col("owner"), "^P[1-9][0-9]*$")))
    kind = F.when(F.col("entity"), "ENTITY").otherwise("PROPERTY_SCHEMA")
    assigned = held.join(lines, held["node"] == lines["s"]).select(graph.alias("graph"), kind.alias("partition_kind"), "line")
    nodes = held.select(F.col("node").alias("s")).distinct()
    rest = lines.join(nodes, "s", "left_anti").select(names.graph("global").alias("graph"), F.lit("GLOBAL").alias("partition_kind"), "line")
    return assigned.unionByName(rest)


def entity_partition(triples: DataFrame, entity: str, names: Names = NAMES) -> DataFrame:
    """The partition of one entity's response; a response without lines of the entity fails."""
    made = partition(triples, names)
    own = made.where(F.col("graph") == names.graph("entity", F.lit(entity)))
    if own.isEmpty():
        raise ValueError(f"no lines of {entity}")
    return made


def closure_of(triples: DataFrame, ids: DataFrame, base: str) -> DataFrame:
    """Distinct lines of the entities in ids (id) and of what they reach over IRI objects."""
    named = lambda kind: F.concat(F.lit(f"<{base}/{kind}/"), "id", F.lit(">")).alias("node")
    roots = ids.select(named("entity")).unionByName(ids.select(named("wiki/Special:EntityData"))).select(F.lit("all").alias("owner"), "node")
    followed = triples.where((F.col("o_kind") == "iri") & F.col("o").rlike(FOLLOWED)).select("s", "o")
    reached = _closure(save(followed, "arcs"), roots).select(F.col("node").alias("s"))
    return triples.join(reached, "s", "left_semi").select("line").distinct()
