"""A corpus pipeline of five training-data operators; each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and looks at all rows of docs; all but the last return the columns of docs, whatever
other columns these have. Defined cases, by stage:
- language_id: null, empty and letterless texts go, as does a text whose language is unsure; repeated rows are judged alike.
- ngram_jaccard_join: of rows that agree in id and text one stays. A row without an id takes one from its text, after all
  given ids, so that its copies and near copies go too. Rows that share an id but not a text are one document in several
  versions: all of them stay, or go with it. Null and empty texts link with nothing.
- secret_scans: every row stays, a null text as null.
- source_mixing: a null source is a source; a row without words is taken by its source's rate too.
- best_fit_packing: a null or empty text is the end token alone; a row for each piece, with its token ids.
Empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language_id, mixing, packing, secret_scan
from tessera.llm.common import save, small_side, table
from tessera.llm.queries import tokenizer_path

#: A document whose language is less likely than this is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.5
#: Token ids are kept and shuffled in this compression.
IDS_CODEC = "zstd"
#: Ids that rows without one take begin here.
FIRST_OWN_ID = 1 << 62


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, made longer until no column of docs has them in any case."""
    there = {c.lower() for c in docs.columns}
    while any(x.lower() in there for x in names):
        names = tuple(x + "_" for x in names)
    return names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones teach; the rest go."""
    lang, score = unused(docs, "found_lang", "found_score")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, tuple(docs.columns), (lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component, and one row of those that share id and text."""
    key, digest, times, row = unused(docs, "own_id", "own_digest", "own_times", "own_row")
    own = F.coalesce(F.col("doc_id").cast("long"), FIRST_OWN_ID + F.shiftrightunsigned(F.xxhash64("text"), 2))
    keyed = docs.withColumns({key: own, digest: F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))})
    found = save(jaccard.join(keyed.select(F.col(key).alias("doc_id"), "text")), "joined")
    gone = save(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    kept = keyed.join(small_side(gone), key, "left_anti")
    repeated = save(kept.groupBy(key, digest).agg(F.count("*").alias(times)).where(F.col(times) > 1).select(key, digest), "repeated")
    repeated = small_side(repeated)
    whole = F.struct(*docs.columns)
    first = kept.join(repeated, [key, digest], "left_semi").groupBy(key, digest).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return kept.join(repeated, [key, digest], "left_anti").select(*docs.columns).unionByName(first.select(f"{row}.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every span that the scan finds is replaced by a mark."""
    blob, spans = unused(docs, "own_blob", "own_spans")
    _, ledger = secret_scan.scan_all(docs)
    hits = ledger.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    rows = docs.withColumn(blob, secret_scan.address()).join(hits, blob, "left")
    text = F.when(F.col(spans).isNotNull(), secret_scan.redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its token ids (little-endian, unsigned, 32 bits each), its sequence and its place there.

    Places are found for narrow rows, and the ids are joined to them by the number of the written row.
    """
    pieces = packing.tokenize(docs, tokenizer_path(), codec=IDS_CODEC).withColumn("row", F.monotonically_increasing_id())
    pieces = save(pieces, "tokens")
    placed = packing.pack(pieces.drop("ids"))
    return packing.plain_ids(placed.join(pieces.select("row", "ids"), "row").drop("row"), IDS_CODEC)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express language ID and packing; tests/llm/test_pipeline.py holds run() and the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
