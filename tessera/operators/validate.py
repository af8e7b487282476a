"""Nested JSON contracts as one Column: the paths at which a text breaks its contract.

A contract is a tree of the nodes below. `faults(text, contract)` compiles it to an expression over the parsed text, with no Python per row: an array of all failing
paths, in the contract's order. What lies below a part that isn't an object isn't looked at, as its own path fails already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is appended to the path of an object whose keys aren't exactly those of its contract.
KEYS = "unexpected-or-missing-field"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
VERSION = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-[0-9A-Za-z.-]+)?$"


class Value:
    """A part of the parsed text: its JSON type, its value as a string, and its keys if it is an object. Read from `parts`, which has them for every path."""

    def __init__(self, parts: Parts, path: str):
        held = parts.of(path)
        self.type, self.string, self.names = held["type"], held["string"], held["keys"]

    def keys(self) -> Column:
        return self.names


class Parts:
    """What a contract looks at in a text, computed once a row: a first walk notes the paths, and the second one reads them from the struct made of these."""

    def __init__(self, held: Column | None = None, paths: dict[str, str] | None = None):
        self.held, self.paths = held, {} if paths is None else paths

    def of(self, path: str) -> Column:
        name = self.paths.setdefault(path, f"p{len(self.paths)}")
        return F.lit(None) if self.held is None else self.held[name]

    def read(self, root: Column) -> Column:
        return F.struct(*[self._part(root, path).alias(name) for path, name in self.paths.items()])

    @staticmethod
    def _part(root: Column, path: str) -> Column:
        return _let(F.try_variant_get(root, path, "variant"), lambda at: F.struct(
            F.coalesce(F.regexp_extract(F.schema_of_variant(at), "^[A-Z]+", 0), F.lit("NONE")).alias("type"),
            F.try_variant_get(at, "$", "string").alias("string"),
            F.when(F.schema_of_variant(at).startswith("OBJECT"), F.json_object_keys(F.to_json(at))).alias("keys"),
        ))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_ok = lambda c: F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Text:
    """A string that matches a pattern, or is one of some."""

    pattern: str | None = None
    among: tuple[str, ...] = ()
    longest: int | None = None

    def holds(self, v: Value) -> Column:
        test = v.type == "STRING"
        if self.pattern is not None:
            test = test & v.string.rlike(self.pattern)
        if self.among:
            test = test & v.string.isin(*self.among)
        if self.longest is not None:
            test = test & F.length(v.string).between(1, self.longest)
        return test


@dataclass(frozen=True)
class Flag:
    """true or false, or just one of them."""

    only: bool | None = None

    def holds(self, v: Value) -> Column:
        return (v.type == "BOOLEAN") & (F.lit(True) if self.only is None else v.string == str(self.only).lower())


@dataclass(frozen=True)
class Count:
    """A whole number of 0 or more."""

    def holds(self, v: Value) -> Column:
        return v.type.isin("BIGINT", "DECIMAL", "DOUBLE") & v.string.rlike(r"^[0-9]+(?:\.0+)?$")


@dataclass(frozen=True)
class One:
    """The number of a first version."""

    def holds(self, v: Value) -> Column:
        return v.type.isin("BIGINT", "DECIMAL", "DOUBLE") & v.string.rlike(r"^1(?:\.0+)?$")


@dataclass(frozen=True)
class Moment:
    """A date, with or without a time of day, that exists."""

    def holds(self, v: Value) -> Column:
        return (v.type == "STRING") & v.string.rlike(r"^\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(v.string).isNotNull()


@dataclass(frozen=True)
class Url:
    """A URL of some schemes without a user, on any host or one that a pattern allows."""

    schemes: tuple[str, ...] = ("http", "https")
    host: str | None = None

    def holds(self, v: Value) -> Column:
        part = lambda name: F.try_parse_url(v.string, F.lit(name))
        test = (v.type == "STRING") & part("PROTOCOL").isin(*self.schemes) & (F.coalesce(part("HOST"), F.lit("")) != "") & part("USERINFO").isNull()
        return test if self.host is None else test & part("HOST").rlike(self.host)


@dataclass(frozen=True)
class Nullable:
    of: object

    def holds(self, v: Value) -> Column:
        return (v.type == "VOID") | _ok(self.of.holds(v))


@dataclass(frozen=True)
class Object:
    """An object with exactly these keys; rules are (name below the object's path, test of its values by key) that look at several. `exact` may be False: then
    more keys are allowed."""

    fields: dict[str, object] = field(default_factory=dict)
    rules: tuple[tuple[str, Callable[[dict[str, Value]], Column]], ...] = ()
    exact: bool = True


@dataclass(frozen=True)
class Either:
    """An object that follows `on` where its flag `key` is true, and has nothing but the flag where it is false."""

    key: str
    on: Object


def _is(v: Value, kind: str) -> Column:
    return _ok(v.type == kind)


def _of(node: object, root: Parts, path: str, name: str, when: Column) -> list[Column]:
    """An entry for each test: the failing path, or null."""
    v = Value(root, path)
    if isinstance(node, Either):
        flag = Value(root, f"{path}.{node.key}")
        known = _is(flag, "BOOLEAN")
        inside = when & _is(v, "OBJECT")
        off = inside & known & _ok(flag.string == "false")
        return [
            F.when(when & ~_is(v, "OBJECT"), name),
            F.when(inside & ~known, f"{name}.{node.key}"),
            F.when(off & (F.size(v.keys()) != 1), f"{name}.{KEYS}"),
            *_of(node.on, root, path, name, inside & known & _ok(flag.string == "true")),
        ]
    if isinstance(node, Object):
        out = [F.when(when & ~_is(v, "OBJECT"), name)]
        inside = when & _is(v, "OBJECT")
        wanted, keys = F.array(*[F.lit(k) for k in node.fields]), v.keys()
        lacking = F.size(F.array_except(wanted, keys)) > 0
        out.append(F.when(inside & _ok(lacking | (F.size(keys) != len(node.fields)) if node.exact else lacking), f"{name}.{KEYS}"))
        for key, child in node.fields.items():
            there = inside & _ok(F.array_contains(keys, key))
            out += _of(child, root, f"{path}.{key}", f"{name}.{key}" if name != "contract" else key, there)
        parts = {k: Value(root, f"{path}.{k}") for k in node.fields}
        return out + [F.when(inside & ~_ok(test(parts)), f"{name}.{rule}" if rule else name) for rule, test in node.rules]
    return [F.when(when & ~_ok(node.holds(v)), name)]


def faults(text: Column, contract: object) -> Column:
    """All failing paths of a JSON text, in order and each once; `contract` alone for what isn't an object or doesn't parse."""
    walk = lambda parts: _of(contract, parts, "$", "contract", F.lit(True))
    noted = Parts()
    walk(noted)
    found = lambda held: F.array_distinct(F.array_compact(F.array(*walk(Parts(held, noted.paths)))))
    return _let(_let(F.try_parse_json(text), noted.read), found)


def runtime(version: str, distribution: str, backends: tuple[str, ...]) -> Object:
    """The contract of a running instance. The states are fixed values."""
    seconds, moment = Count(), Nullable(Moment())
    freshness = Object(
        {"cursorTimestamp": moment, "sourceHeadTimestamp": moment, "lagSeconds": seconds, "syncLagSeconds": seconds, "sourceIdleSeconds": Nullable(seconds)},
        (("lagSeconds", lambda v: v["lagSeconds"].string == v["syncLagSeconds"].string),),
    )
    query = Object({
        "enabled": Flag(True), "backendType": Text(among=backends), "logicalEndpoint": Url(), "syncState": Text(among=("BOOTSTRAPPING", "CATCHING_UP", "CURRENT", "STALE", "GAP_DETECTED", "ERROR")),
        "freshness": freshness, "servingGeneration": Text("^gen-[a-z0-9][a-z0-9-]{0,58}$"),
    })
    return Object({
        "contractVersion": Text(among=(version,)), "distribution": Object({"type": Text(among=(distribution,)), "version": Text(VERSION)}), "instance": Object({"id": Text(UUID)}),
        "endpoints": Object({"mediawiki": Url(), "actionApi": Url()}), "health": Object({"state": Text(among=("healthy", "degraded", "unhealthy", "unknown"))}),
        "queryService": Either("enabled", query), "capabilities": Object({"queryOptional": Flag(True), "instanceStopPreservesData": Flag()}),
    })


def descriptor(partition_model: str, normalization_model: str, backends: tuple[str, ...], host: str) -> Object:
    """A generation's descriptor; its endpoints are local ones, by a pattern of hosts."""
    endpoint = lambda access: Object({"access": Text(among=(access,)), "url": Url(("http",), host)}, exact=False)
    return Object({
        "generationId": Text("^gen-[a-z0-9][a-z0-9-]{0,58}$"), "sourceIdentity": Text("^[a-z0-9][a-z0-9.-]{0,127}$"), "backendType": Text(among=backends), "partitionModel": Text(among=(partition_model,)),
        "normalizationModel": Text(among=(normalization_model,)), "queryEndpoint": endpoint("internal-read"), "internalUpdateEndpoint": endpoint("internal-write"),
    }, exact=False)


#: What a backend says that it can do.
CAPABILITIES = (
    "sparql11Query", "sparql11Update", "namedGraphs", "transactionalUpdate", "graphStoreProtocol", "serviceFederation", "fullTextSearch", "geoSparql", "wikibaseLabelService",
    "isolatedGenerations", "atomicServingCutover", "rollbackCutover", "generationDelete", "generationQuery",
)


def capabilities(names: tuple[str, ...] = CAPABILITIES) -> Object:
    return Object({n: Flag() for n in names})


#: Categories of a fixture's properties, and those whose values are told.
FIXTURE_PROPERTIES = ("string", "externalId", "item", "quantity", "time", "qualifier", "reference")
FIXTURE_VALUES = ("string", "externalId", "quantity", "time", "qualifier", "reference")


def fixture_manifest(kind: str, longest: int = 200) -> Object:
    """A semantic fixture's manifest: exactly these categories of properties, and what their values are, in bounded strings."""
    return Object({
        "version": One(), "fixtureType": Text(among=(kind,)), "subjectItem": Text("^Q[1-9][0-9]*$"), "targetItem": Text("^Q[1-9][0-9]*$"),
        "properties": Object({p: Text("^P[1-9][0-9]*$") for p in FIXTURE_PROPERTIES}), "expected": Object({e: Text(longest=longest) for e in FIXTURE_VALUES}),
    })
