"""Secret scans over an incremental blob ledger. Only DataFrame and SQL functions.

Every historical version of every path is content-addressed by the SHA-256 of
its text. The ledger has one row for each (blob, rule version) scanned before;
only blobs without such a row are read again, once each however many paths or
versions hold them. Findings are kept per blob and joined back to all paths.

A query scans in ingests: scan_history() passes the ledger of one to the next, so a blob of an earlier ingest isn't read again.

The text of a new blob is fetched by the id of the one version that stands for it, so copies
never gather in one task; a hot blob's findings join is split by AQE.

Defined cases: a null text is empty and has no spans; repeated rows get the
same spans each; a scan that finds nothing leaves a ledger row without spans;
with an empty or no ledger everything is new; a blob held only by rows without an id is read
from those; offsets count code points. The pem rule finds the header of a key, as the SQL of the query does;
redacted() takes the whole key away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

RULES_VERSION = "1"

# The patterns of each kind, and the kinds in the order in which ties of start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
PEM = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
PEM_END = "-----END [A-Z ]*PRIVATE KEY-----"
PEM_BODY = r"^(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info): [^\r\n]*+|[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9+/]*+={1,2}))*+"
FORGE = "gh[opsu]_[A-Za-z0-9]{36,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "forge")

SPAN = "struct<kind:string,start:long,end:long>"


def bound(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body names it, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements of an array that are appended one by one before a new array is begun.
APPENDED = 256


def _running(values: Column, op=lambda a, b: a + b) -> Column:
    """op (sum, or greatest of 0 and more) over all up to and with each element of an array that is a lambda's variable. Blocks first, so that appending copies little."""
    plus = lambda sums, x: F.concat(sums, F.array(op(F.element_at(sums, -1), x)))
    summed = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), plus)
    starts = F.sequence(F.lit(1), F.size(values), F.lit(APPENDED))
    blocks = F.transform(starts, lambda k: F.slice(summed(F.slice(values, k, F.lit(APPENDED))), 2, APPENDED))

    def shifted(parts):
        before = summed(F.transform(parts, lambda x: F.element_at(x, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda x, n: F.transform(x, lambda v: op(v, n))))

    return F.when(F.size(values) > 0, bound(blocks, shifted)).otherwise(F.array().cast("array<long>"))


def _placed(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of all matches, left to right. What stands between matches comes from split(), so the k-th match starts after
    k + 1 such pieces and k matches. keep: an array column of booleans, by match. The text is read once or twice, however many matches."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    kept = F.transform(sizes, lambda _: F.lit(True)) if keep is None else keep
    parts = F.struct(gaps.alias("gaps"), sizes.alias("sizes"), kept.alias("kept"))

    def spans(m):
        steps = F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["sizes"])), m["sizes"], lambda gap, size: (gap + size).cast("long"))
        span = lambda x: F.struct(F.lit(kind).alias("kind"), (x["end"] - x["size"]).cast("long").alias("start"), x["end"].alias("end"))
        placed = lambda v: F.arrays_zip(_running(v).alias("end"), m["sizes"].alias("size"), m["kept"].alias("keep"))
        return F.transform(F.filter(bound(steps, placed), lambda x: x["keep"]), span)

    return bound(parts, spans)


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans_of(text: Column) -> dict[str, Column]:
    """The condition that a kind occurs at all (cheap tests first), and its spans."""
    low = F.lower(text)
    maybe = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key"))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN_VALUE), F.lit(1)), lambda v: F.length(v) >= 6)
    return {
        "assign": F.when(maybe & text.rlike(ASSIGN), _placed(text, ASSIGN, "assign", long_enough)).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), _placed(text, ACCESS, "access")).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), _placed(text, HEX, "hex")).otherwise(_none()),
        "pem": F.when(F.contains(text, F.lit("PRIVATE KEY-----")) & text.rlike(PEM), _placed(text, PEM, "pem")).otherwise(_none()),
        "forge": F.when(F.contains(text, F.lit("gh")) & text.rlike(FORGE), _placed(text, FORGE, "forge")).otherwise(_none()),
    }


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed."""
    place = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def address(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def blobs(versions: DataFrame) -> DataFrame:
    """versions (doc_id, text) -> doc_id and blob of every version, written once."""
    return save(versions.select("doc_id", address().alias("blob")), "blobs")


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rules string, spans array<{SPAN}>")


def scan(versions: DataFrame, addressed: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """New ledger rows (blob, rules, spans): one for each blob of `addressed` that the ledger doesn't have for these rules.

    versions: doc_id, text. addressed: blobs(versions).
    """
    wanted = addressed.groupBy("blob").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("blob", "wanted")
    if ledger is not None:
        wanted = wanted.join(ledger.where(F.col("rules") == rules).select(F.col("blob").alias("wanted")).distinct(), "wanted", "left_anti")
    texts = versions.select("doc_id", address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("wanted")))
    found = texts.select("blob", *[c.alias(k) for k, c in spans_of(F.col("text")).items()])
    found = found.select("blob", F.lit(rules).alias("rules"), F.concat(*KINDS).alias("spans"))
    found = found.groupBy("blob", "rules").agg(F.first("spans").alias("spans"))
    return found.select("blob", "rules", _ordered(F.col("spans")).alias("spans"))


def findings(addressed: DataFrame, ledger: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """doc_id, blob, spans of every version, from the ledger; spans is empty where there are none."""
    hits = ledger.where(F.col("rules") == rules).where(F.size("spans") > 0).select("blob", "spans")
    return addressed.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", _none()).alias("spans"))


def scan_all(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every version, the ledger with the new rows)."""
    addressed = blobs(versions)
    new = save(scan(versions, addressed, ledger, rules), "ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    return findings(addressed, whole, rules), whole


def scan_history(ingests: list[DataFrame], rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """Versions as they came in, each ingest scanned against the ledger that those before it left -> (findings of all versions, the ledger)."""
    found, ledger = None, None
    for versions in ingests:
        rows, ledger = scan_all(versions, ledger, rules)
        found = rows if found is None else found.unionByName(rows)
    return found, ledger


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def whole_keys(text: Column, spans: Column) -> Column:
    """spans, where those of a key's header reach to its END line, or over the key's lines if there is none before the next key."""

    def widened(s):
        rest = F.substr(text, (s["end"] + 1).cast("int"))
        cut = F.split(rest, PEM_END, 2)
        ended = (F.size(cut) == 2) & ~F.contains(cut[0], F.lit("-----BEGIN "))
        more = F.when(ended, F.length(rest) - F.length(F.get(cut, F.lit(1)))).otherwise(F.length(F.regexp_extract(rest, PEM_BODY, 0)))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (s["end"] + F.when(s["kind"] == "pem", more).otherwise(0)).cast("long").alias("end"))

    return F.when(F.exists(spans, lambda s: s["kind"] == "pem"), F.transform(spans, widened)).otherwise(spans)


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """text with every span replaced by the mark; overlapping spans give one mark, and so does a private key as a whole.

    The pieces between spans are cut from parts of the text that hold APPENDED spans each, so many spans don't make as many scans of the text.
    """
    def cut(m):
        ends = lambda e: F.concat(F.array(F.lit(0).cast("long")), _running(e, F.greatest))
        reached = lambda e: F.struct(
            F.filter(F.zip_with(F.slice(ends(e), F.lit(1), F.size(m)), m, lambda at, s: F.struct(at.alias("from"), s["start"].alias("to"))), lambda c: c["to"] >= c["from"]).alias("cuts"),
            F.array_max(e).alias("at"),
        )
        return bound(F.transform(m, lambda s: s["end"]), reached)

    def written(m):
        part = lambda t, at, to: F.substr(t, (at + 1).cast("int"), F.greatest(to - at, F.lit(0)).cast("int"))

        def block(k):
            def joined_up(b):
                first = F.get(b, F.lit(0))["from"]
                inner = lambda t: F.array_join(F.transform(b, lambda c: part(t, c["from"] - first, c["to"] - first)), mark)
                return bound(part(text, first, F.element_at(b, -1)["to"]), inner)

            return bound(F.slice(m["cuts"], k, F.lit(APPENDED)), joined_up)

        starts = F.sequence(F.lit(1), F.size(m["cuts"]), F.lit(APPENDED))
        return F.array_join(F.concat(F.transform(starts, block), F.array(part(text, m["at"], F.length(text)))), mark)

    made = bound(whole_keys(text, spans), cut)
    return F.when(F.size(spans) > 0, bound(made, written)).otherwise(text)
