"""Small helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import save, scratch, table  # noqa: F401

#: A word: a run of anything but space and the five ASCII control blanks.
WORD = "[^\\x20\\x09-\\x0D]+"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(name: str = "text"):
    """The text as UTF-8 bytes; null counts as empty. bytes.split() of it gives exactly the words of WORD."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


#: Bytes up to which a frame of ids, counts and digests is small enough to broadcast; what a row and a column of it take there.
BROADCAST_BYTES = 48 << 20
ROW_BYTES, LONG_BYTES, DIGEST_BYTES = 24, 8, 32


def small_side(df: DataFrame) -> DataFrame:
    """A saved frame of narrow rows, to be broadcast if its counted rows fit in BROADCAST_BYTES; else joined by shuffle."""
    width = ROW_BYTES + sum(LONG_BYTES if t in ("long", "bigint", "int", "double") else DIGEST_BYTES for _, t in df.dtypes)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches of 1,000 rows in this session unless another number than Spark's 10,000 is set: whole texts are long."""
    if spark.conf.get(ROWS_PER_BATCH, "10000") == "10000":
        spark.conf.set(ROWS_PER_BATCH, "1000")
