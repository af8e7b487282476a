"""URL filters by a sort-merge range join.

A host's labels, reversed and each ended by a dot, make a canonical key:
`news.example.com` becomes `com.example.news.`. All subdomains of a rule's host
then lie in one interval of keys, the keys with the rule's key as prefix, and
intervals of different rules are nested or apart. URLs and rules are
range-partitioned by key together (then host, path and id, so one hot host spans
many partitions), sorted, and swept once: a stack holds the rules whose
intervals are open. Rules that are open where a partition begins are added to it,
found by joining the prefixes of the partitions' first keys; being prefixes, they sort first.

Defined cases: a null url, or one without `://`, has empty host and path and
fits no rule; of rules that fit, the longest wins, then the later by code point;
of two verdicts for one rule the first by code point (allow) holds; rules with a
null host, path or verdict are ignored; repeated rows are judged alike; without rules all get the default.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class _Stack:
    """The rules whose intervals are open, outermost first: (key, {path: (rule, verdict)}, lengths of its paths)."""

    def __init__(self):
        self.open: list = []

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def push(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, set()))
        frame = self.open[-1]
        frame[1][path] = (rule, verdict)
        frame[2].add(len(path))

    def judge(self, path: str):
        best = None
        for _, rules, sizes in self.open:
            for n in sizes:
                hit = rules.get(path[:n]) if n <= len(path) else None
                if hit and (best is None or (len(hit[0]), hit[0]) >= (len(best[0]), best[0])):
                    best = hit
        return best


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) -> page_id, host, path, rule, verdict; one row for each row."""
    spark = pages.sparkSession
    id_type = dict(pages.select("page_id").dtypes)["page_id"]
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.select(key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", "path", "page_id", F.lit(None).cast("string").alias("verdict"))
    lines = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna().groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    lines = lines.where("host <> ''").select(key_of(F.col("host")).alias("key"), F.lit(0).alias("kind"), "host", "path", F.lit(None).cast(id_type).alias("page_id"), "verdict")
    order = ["key", "kind", "path", "page_id"]
    events = urls.unionByName(lines).repartitionByRange(shuffle_width(spark), *order)
    events = save(events.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "urls")

    firsts = events.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split("first", r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))
    heads = firsts.where("first <> ''").select("part", F.explode(prefixes).alias("key"))
    opened = events.where("kind = 0").withColumnRenamed("part", "of").join(heads, "key").where("of < part").select(*events.columns)
    wide = events.unionByName(opened).repartitionByRange(shuffle_width(spark), "part")

    def sweep(batches):
        stack, part = _Stack(), None
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("part", "kind", "key", "host", "path", "verdict")]
            at, rule, verdict = [], [], []
            for k, (p, kind, key, host, path, given) in enumerate(zip(*rows)):
                if p != part:
                    stack, part = _Stack(), p
                stack.close(key)
                if kind == 0:
                    stack.push(key, path, host + path, given)
                    continue
                hit = stack.judge(path)
                at.append(k)
                rule.append(hit and hit[0])
                verdict.append(hit[1] if hit else default)
            rest = batch.select(["page_id", "host", "path"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return wide.sortWithinPartitions("part", *order).mapInArrow(sweep, f"page_id {id_type}, host string, path string, rule string, verdict string")
