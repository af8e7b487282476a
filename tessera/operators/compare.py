"""Canonical comparison of graphs and datasets."""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import count, groupby, permutations, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import save
from ..sources.triples import BNODE, scan
from .normalize import in_line_form

# Lines with a blank node as subject or object.
BOUND = r"^_:|^\S+\s+\S+\s+_:"


def sided(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """side ("0" or "1") and both sides' rows of `on`, lines in normal form and blank nodes under canonical names; a row may come twice.

    Labels hold for a whole side, and graphs count in names. Both sides are coloured together, so in the same number of rounds. Rows without blank nodes are
    neither shuffled nor written here.
    """
    sides = expected.select(F.lit("0").alias("side"), *on).unionByName(actual.select(F.lit("1").alias("side"), *on))
    if "line" not in on:
        return sides
    others = [c for c in on if c != "line"]
    # filters aren't pushed through a generator, so what makes a line is done once a pass and not for every test of it
    sides = sides.select("side", *others, F.explode(F.array("line")).alias("line"))
    has = lambda x: F.col("line").contains(x)
    bound = F.coalesce(has("_:") & F.col("line").rlike(BOUND), F.lit(False))
    inside = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:"), "side", F.lit("."), F.substr(c, F.lit(3)))).otherwise(F.col(c))
    # only an escape can bring in what a blank node's label needs
    apart = in_line_form(sides.where(has("_:") | has("\\u") | has("\\U"))).where(bound).distinct()
    rows = save(scan(apart, keep=["side", *others]).select("side", *others, "p", inside("s").alias("s"), inside("o").alias("o")), "bound")
    forms = in_line_form(sides)
    if rows.isEmpty():
        return forms
    names, seed = canonical_names(rows.select("s", F.concat_ws(" ", "p", *others).alias("p"), "o"))
    for end in ("s", "o"):
        rows = rows.withColumn("node", _id(end, seed)).join(names, "node", "left")
        rows = rows.withColumn(end, F.when(F.col(end).startswith("_:"), F.coalesce("name", end)).otherwise(F.col(end))).drop("node", "name")
    rows = rows.withColumn("line", F.concat_ws(" ", "s", "p", "o", F.lit("."))).select("side", *on)
    return forms.where(~bound).select("side", *on).unionByName(rows)


def _held(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """Distinct rows of `on` in canonical form, and e: 1 for the first side, 2 for the second, 3 for both. One shuffle of both sides.

    Rows are dealt before they are grouped: as most are distinct until both sides meet, grouping them in their own tasks first would only fill memory.
    """
    rows = sided(expected, actual, on).select(*on, F.when(F.col("side") == "0", 1).otherwise(2).alias("e"))
    return rows.repartition(*on).groupBy(*on).agg(F.bit_or("e").alias("e"))


def diff(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    """direction (canonicalOnly, generationOnly) and the columns of `on`: the two set differences of the canonical forms."""
    direction = F.when(F.col("e") == 1, "canonicalOnly").otherwise("generationOnly")
    return _held(expected, actual, on).where("e <> 3").select(direction.alias("direction"), *on)


def by_graph(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """graph, missing, extra, valid from datasets of (graph, line), in canonical form."""
    return _held(expected, actual, ["graph", "line"]).groupBy("graph").agg(
        F.count_if(F.col("e") == 1).alias("missing"), F.count_if(F.col("e") == 2).alias("extra"), (F.count_if(F.col("e") != 3) == 0).alias("valid")
    )


def _id(term: str, seed: int) -> Column:
    """A term as a number. _coloured() looks by a second hash whether two blank nodes share one, and takes another seed if they do."""
    return F.xxhash64(F.lit(seed), term)


def _digest(h: Column) -> list[Column]:
    """Parts of a digest of many hashes: sums of their halves, so that no sum overflows, and their number."""
    return [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.count(h)]


def colours(triples: DataFrame) -> DataFrame:
    """node, colour of each blank node: a hash of its incident lines, refined with its neighbours' colours until stable.

    A round only ever splits colours, so the colouring is stable once their count no longer grows: after n + 1 rounds at most.
    Chains, such as lists, are told apart before by doubling: what a node sees along its only link of a direction is hashed over 1, 2, 4, ... links, so rounds
    follow the logarithm of a chain's length. That says no more than rounds of one link would, so what is stable in the end is the same.
    Lines are combined by a sum of hashes, so a node with any number of lines needs no list; labels never enter a colour.
    """
    coloured, seed = _coloured(triples)
    return _labels(triples, seed).join(coloured, "id").select("node", "colour")


def _labels(triples: DataFrame, seed: int) -> DataFrame:
    """Distinct node, id of all blank nodes."""
    nodes = triples.select(F.explode(F.array("s", "o")).alias("node")).where(F.col("node").startswith("_:"))
    return nodes.distinct().withColumn("id", _id("node", seed))


def _coloured(triples: DataFrame) -> tuple[DataFrame, int]:
    """id, mark (the code of the label's first character) and colour of each blank node, and the seed of the ids."""
    bare = lambda c: F.when(F.col(c).rlike(f"^{BNODE}$"), F.lit("@BNODE")).otherwise(F.col(c))
    blank = lambda c: F.col(c).startswith("_:")
    for seed in count():

        def arc(own, other, out):
            h = F.xxhash64(F.lit("out" if out else "in"), "p", F.when(F.col("s") == F.col("o"), "@SELF").otherwise(bare(other)))
            columns = {"id": _id(own, seed), "check": F.hash(own), "mark": F.ascii(F.substr(own, F.lit(3), F.lit(1))), "other": F.when(blank(other), _id(other, seed)), "h": h, "out": F.lit(out)}
            return F.when(blank(own), F.struct(*[c.alias(name) for name, c in columns.items()]))

        # both ends in one pass, as what gives the triples may be a long way
        arcs = triples.where(blank("s") | blank("o")).select(F.inline(F.array(arc("s", "o", True), arc("o", "s", False)))).where("id is not null")
        made = {"mark": F.max("mark"), "colour": F.xxhash64(*_digest(F.col("h"))), "clash": F.min("check") != F.max("check")}
        for side, link in (("out", F.col("out")), ("in", ~F.col("out"))):
            link = link & (F.col("other") != F.col("id"))  # null, so not counted, where the other end is no blank node
            made |= {f"n_{side}": F.count_if(link), f"next_{side}": F.max(F.when(link, F.col("other"))), f"h_{side}": F.max(F.when(link, F.col("h")))}
        now = arcs.repartition("id").groupBy("id").agg(*[c.alias(name) for name, c in made.items()])
        only = lambda side, yes, no=None: F.when(F.col(f"n_{side}") == 1, yes).otherwise(F.lit(None).cast("long") if no is None else no)
        ways = [x for side in ("out", "in") for x in (only(side, F.col(f"next_{side}")).alias(f"next_{side}"), only(side, F.xxhash64(f"h_{side}", "colour"), F.col("colour")).alias(f"seen_{side}"))]
        now = save(now.select("id", "mark", "colour", "clash", (F.greatest("n_out", "n_in") > 1).alias("branches"), *ways), "ways")
        clashes, branches = now.agg(F.count_if("clash"), F.count_if("branches")).first()
        if clashes:
            continue
        if branches:
            return _refined(now.select("id", "mark", "colour"), save(arcs.select(F.col("id").alias("node"), "other", "h", F.when(F.col("out"), "out").otherwise("in").alias("side")), "arcs")), seed
        return _chained(now.drop("colour", "clash", "branches")), seed


def _chained(now: DataFrame) -> DataFrame:
    """id, mark, colour where no node has two links of a direction, so that there are lists and rings only.

    Of each node: next_out and next_in, the nodes 1, 2, 4, ... links away, null beyond an end; seen_out and seen_in, a hash of what stands before them, itself included.
    If y is next to x one way, then x is next to y the other way, so each node tells both of its next ones what they would have to ask it, and one that has
    seen both ends takes no further part. A list that is longer than the way so far has ends to be seen in each round, so once no way ends only rings are left;
    they say nothing new once no more kinds of ways are seen. By then a node's colour tells those of its neighbours, so no further round can split it.
    """
    done, before, kinds = [], None, None
    while True:
        open_ = now.where("next_out is not null or next_in is not null")
        done.append(now.where("next_out is null and next_in is null"))
        ways = open_.agg(F.count("next_out") + F.count("next_in")).first()[0]
        if ways == before:
            seen = open_.agg(F.count_distinct(F.when(F.col("next_out").isNotNull(), F.col("seen_out"))) + F.count_distinct(F.when(F.col("next_in").isNotNull(), F.col("seen_in")))).first()[0]
            if seen == kinds:
                break
            kinds = seen
        if ways == 0:
            break
        before = ways
        told = lambda to, what, a, b: F.when(F.col(to).isNotNull(), F.struct(F.col(to).alias("id"), F.lit(what).alias("what"), F.lit(None).cast("int").alias("mark"), F.col(a).alias("a"), F.col(b).alias("b"), *[F.lit(None).cast("long").alias(c) for c in "cd"]))
        own = F.struct("id", F.lit(0).alias("what"), "mark", F.col("next_out").alias("a"), F.col("seen_out").alias("b"), F.col("next_in").alias("c"), F.col("seen_in").alias("d"))
        rows = open_.select(F.inline(F.array(own, told("next_in", 1, "next_out", "seen_out"), told("next_out", 2, "next_in", "seen_in")))).where("id is not null")
        of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
        met = rows.repartition("id").groupBy("id").agg(
            F.max("mark").alias("mark"), of(0, "a").alias("next_out"), of(0, "b").alias("seen_out"), of(0, "c").alias("next_in"), of(0, "d").alias("seen_in"),
            of(1, "a").alias("after_out"), of(1, "b").alias("more_out"), of(2, "a").alias("after_in"), of(2, "b").alias("more_in"),
        )
        ahead = [x for side in ("out", "in") for x in (
            F.when(F.col(f"next_{side}").isNotNull(), F.col(f"after_{side}")).alias(f"next_{side}"),
            F.when(F.col(f"next_{side}").isNotNull(), F.xxhash64(f"seen_{side}", f"more_{side}")).otherwise(F.col(f"seen_{side}")).alias(f"seen_{side}"),
        )]
        now = save(met.select("id", "mark", *ahead), "ways")
    every = reduce(DataFrame.unionByName, [*done, open_])
    return every.select("id", "mark", F.xxhash64("seen_out", "seen_in").alias("colour"))


def _refined(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """id, mark, colour of any graph: ways along only links, then rounds of one link over all arcs (node, other, h, side) until stable."""
    now = nodes.select(F.col("id").alias("node"), "colour")
    linked = arcs.where("other is not null")
    now = _along(now, linked.where("node <> other"))
    distinct, before = now.select("colour").distinct().count(), 0
    while distinct > before:
        near = now.withColumnRenamed("node", "other").withColumnRenamed("colour", "c")
        met = linked.join(near, "other").select("node", F.xxhash64("h", "c").alias("h"), F.lit(None).cast("long").alias("colour"))
        # its own colour, which tells of all its lines, is part of what a node becomes, so that no round undoes a split
        both = met.unionByName(now.select("node", F.lit(None).cast("long").alias("h"), "colour")).repartition("node").groupBy("node")
        now = save(both.agg(F.xxhash64(*_digest(F.col("h")), F.max("colour")).alias("colour")), "colours")
        distinct, before = now.select("colour").distinct().count(), distinct
    return nodes.select("id", "mark").join(now.withColumnRenamed("node", "id"), "id")


def _along(coloured: DataFrame, links: DataFrame) -> DataFrame:
    """Colours (node, colour) with what stands along each node's only link of a side (links: node, other, h, side), by doubling."""
    only = links.groupBy("node", "side").agg(F.count("*").alias("n"), F.min("other").alias("next"), F.min("h").alias("h")).where("n = 1")
    now = save(only.join(coloured, "node").select("node", "side", "next", F.xxhash64("h", "colour").alias("seen")), "ways")
    ended, before = now.where("next is null"), None
    while True:
        # ways that have ended are kept as they are; a ring has no end, and says nothing new once no way ends and no more kinds of ways are seen
        open_ = now.where("next is not null")
        state = open_.agg(F.count("*"), F.count_distinct("seen")).first()
        if state[0] == 0 or state == before:
            break
        before = state
        far = open_.unionByName(ended).select(F.col("node").alias("next"), "side", F.col("next").alias("after"), F.col("seen").alias("more"))
        last = coloured.select(F.col("node").alias("next"), F.col("colour").alias("end"))
        met = open_.join(far, ["next", "side"], "left").join(last, "next", "left")
        now = save(met.select("node", "side", F.col("after").alias("next"), F.xxhash64("seen", F.coalesce("more", "end")).alias("seen")), "ways")
        ended = ended.unionByName(now.where("next is null"))
    now = ended.unionByName(now.where("next is not null"))
    both = now.groupBy("node").agg(F.xxhash64(*_digest(F.xxhash64("side", "seen"))).alias("way"))
    return save(coloured.join(both, "node", "left").select("node", F.xxhash64("colour", F.coalesce("way", F.lit(0))).alias("colour")), "colours")


#: Orders of tied nodes that are tried in one component; beyond them the job fails, as it must somewhere: they grow with the factorial of the tied nodes.
SEARCH_LIMIT = 100_000
#: Copies of one component are numbered in so many parts.
PARTS = 256
FORMS = pa.schema([("component", pa.string()), ("node", pa.string()), ("form", pa.string()), ("place", pa.int64())])


def canonical_names(triples: DataFrame, limit: int = SEARCH_LIMIT) -> tuple[DataFrame, int]:
    """triples (s, p, o) with nodes `_:<side>.<label>` -> node (its id), name, and the seed of the ids; names are alike on both sides where what they stand for is.

    A node whose colour no other of its side has is named by it. Those that stay tied are put in order by component (nodes tied and
    linked): of all orders within equal colours the one with the least text. Components with one text are copies of each other
    and are numbered. A component with more orders than the limit fails the job.
    """
    coloured, seed = _coloured(triples)
    sizes = coloured.repartition("mark", "colour").groupBy("mark", "colour").agg(F.count("*").alias("n"), F.max("id").alias("node"))
    sizes = save(sizes, "coloured")
    single = sizes.where("n = 1").select("node", F.concat(F.lit("_:c14n"), F.hex("colour")).alias("name"))
    if sizes.where("n > 1").isEmpty():
        return single, seed
    same = coloured.join(sizes.where("n > 1").select("mark", "colour"), ["mark", "colour"], "left_semi").select("id", "colour")
    tied = save(_labels(triples, seed).join(same, "id").select("node", "id", "colour"), "tied")
    for end in ("s", "o"):
        triples = triples.withColumn("id", _id(end, seed)).join(tied.select("id", F.col("colour").alias(f"{end}_colour")), "id", "left").withColumn(f"{end}_id", F.col("id")).drop("id")
    near = triples.where("s_colour is not null or o_colour is not null")
    for end in ("s", "o"):
        near = near.join(single.select(F.col("node").alias(f"{end}_id"), F.col("name").alias(f"{end}_name")), f"{end}_id", "left").drop(f"{end}_id")
    tied = tied.drop("id")
    near = save(near, "near")
    label = _components(tied.select("node"), near.where("s_colour is not null and o_colour is not null and s <> o").select("s", "o"))
    owned = near.join(label.withColumnRenamed("node", "s"), "s", "left").join(label.select(F.col("node").alias("o"), F.col("component").alias("far")), "o", "left")
    owned = save(owned.withColumn("component", F.coalesce("component", "far")).drop("far"), "owned")
    # a component's orders are counted before its lines come together, so one that can't be searched fails early whatever its size
    tied_in = tied.join(label, "node").groupBy("component", "colour").agg(F.count("*").alias("n"))
    orders = tied_in.groupBy("component").agg(F.sum(F.log2(F.expr("factorial(least(n, 20))"))).alias("bits"), F.max("n").alias("most"))
    if not orders.where((F.col("most") > 20) | (F.col("bits") > math.log2(limit) + 1e-6)).isEmpty():
        raise ValueError("RDF_CANONICALIZATION_SEARCH_LIMIT")

    def ordered(component: str, rows: list[dict]) -> list[dict]:
        groups: dict[int, set] = {}
        for end in ("s", "o"):
            for r in rows:
                if r[f"{end}_colour"] is not None:
                    groups.setdefault(r[f"{end}_colour"], set()).add(r[end])
        if math.prod(math.factorial(len(g)) for g in groups.values()) > limit:
            raise ValueError("RDF_CANONICALIZATION_SEARCH_LIMIT")
        parts = [(r["s"], r["s_name"] or r["s"], r["p"], r["o"], r["o_name"] or r["o"]) for r in rows]

        def text(order):
            place = {node: f"_:{k}" for k, node in enumerate(order)}
            return sorted(" ".join((place.get(s, sn), p, place.get(o, on))) for s, sn, p, o, on in parts)

        orders = ([n for part in parts for n in part] for parts in product(*[permutations(sorted(groups[c])) for c in sorted(groups)]))
        least, order = min((text(o), o) for o in orders)
        form = hashlib.sha256("\n".join([*map(str, sorted(groups)), *least]).encode()).hexdigest()[:32]
        return [{"component": component, "node": node, "form": form, "place": k} for k, node in enumerate(order)]

    def all_ordered(batches):
        made: list[dict] = []
        rows = (r for batch in batches for r in batch.to_pylist())
        for component, group in groupby(rows, key=lambda r: r["component"]):
            made += ordered(component, list(group))
            if len(made) >= 10_000:
                yield pa.RecordBatch.from_pylist(made, schema=FORMS)
                made = []
        yield pa.RecordBatch.from_pylist(made, schema=FORMS)

    # components are many and small, so a task takes one after the other; their number and not their bytes is the work, so tasks aren't put together
    tasks = int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = owned.repartition(tasks, "component").sortWithinPartitions("component")
    made = save(owned.mapInArrow(all_ordered, "component string, node string, form string, place long"), "forms")
    copies = made.select("component", "form", F.substr("component", F.lit(3), F.lit(1)).alias("side")).distinct()
    copies = save(copies.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(PARTS))), "copies")
    before = F.sum("n").over(Window.partitionBy("side", "form").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = copies.groupBy("side", "form", "part").agg(F.count("*").alias("n")).select("side", "form", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("side", "form", "part").orderBy("component"))
    copies = copies.withColumn("rank", rank).join(sizes, ["side", "form", "part"]).select("component", (F.col("rank") + F.col("before")).alias("copy"))
    more = made.join(copies, "component").select(_id("node", seed).alias("node"), F.concat(F.lit("_:c14n"), "form", F.lit("."), F.col("copy").cast("string"), F.lit("."), F.col("place").cast("string")).alias("name"))
    return single.unionByName(save(more, "named")), seed


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node that is linked.

    Each round a node takes the least component next to it, tells its former component of that, and then takes its component's own, so rounds
    follow the logarithm of the longest way in a component.
    """
    both = save(edges.unionByName(edges.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct(), "both")
    now = save(nodes.select("node", F.col("node").alias("component")), "component")
    while True:
        near = both.join(now.withColumnRenamed("node", "o"), "o").groupBy(F.col("s").alias("node")).agg(F.min("component").alias("near"))
        least = now.join(near, "node", "left").select("node", "component", F.least("component", "near").alias("to"))
        told = least.groupBy("component").agg(F.min("to").alias("told")).select(F.col("component").alias("node"), "told")
        hooked = save(least.join(told, "node", "left").select("node", "component", F.least("to", "told").alias("to")), "component")
        up = hooked.select(F.col("node").alias("to"), F.col("to").alias("up"))
        new = save(hooked.join(up, "to").select("node", F.col("up").alias("component"), (F.col("up") < F.col("component")).alias("moved")), "component")
        moved = not new.where("moved").isEmpty()
        now = new.drop("moved")
        if not moved:
            return now


def canonical_text(lines: DataFrame) -> DataFrame:
    """line: the distinct lines of a graph in canonical form. Equal for isomorphic graphs and for no others."""
    return sided(lines.select("line"), lines.select("line").limit(0), ["line"]).select("line").distinct()
