"""A feed of recent changes as a streaming source: pages by cursor, the oldest first.

    spark.dataSource.register(ChangeFeed)
    spark.readStream.format("change_feed").option("path", ...).option("pageSize", 50).load()

The feed is a Parquet file or folder with the columns of `SCHEMA`. The offset is the cursor (ts, rcid). A micro-batch is one
page, of 100 rows at most, which the reader of such a source fetches on the driver, as from an API: rows from the cursor's second on in the given namespaces, less
those at or before the cursor. A page with nothing new is followed by the next one, `MOST_PAGES` at most; a feed whose cursor's second is longer fails
with the code of `SCAN_LIMIT`. Row groups whose seconds are all before the cursor aren't read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

# Pages looked at for a poll, the error code beyond them, the rows of a page, and the namespaces of items and properties.
MOST_PAGES, SCAN_LIMIT, MOST_ROWS, NAMESPACES = 10, "RECENT_CHANGES_SAME_SECOND_SCAN_LIMIT", 100, "120|122"
SCHEMA = (
    "rcid long, ts timestamp_ntz, type string, ns int, title string, revid long, old_revid long, logtype string, logaction string, comment string, "
    "tags array<string>, redirect boolean"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def next_page(rows: list[dict], cursor: tuple | None, limit: int) -> list[dict]:
    """The first page with something new. rows: up to a row more than MOST_PAGES pages, in order, from the cursor's second on."""
    for page in range(MOST_PAGES):
        part = rows[page * limit : (page + 1) * limit]
        new = [r for r in part if cursor is None or (r["ts"], r["rcid"]) > cursor]
        if new or len(rows) <= (page + 1) * limit:
            return new
    raise ValueError(SCAN_LIMIT)


def normal(row: dict) -> tuple:
    """A row with the defaults of what an event may lack: an empty comment, no tags, no redirect."""
    row = row | {"comment": row.get("comment") or "", "tags": list(row.get("tags") or []), "redirect": bool(row.get("redirect"))}
    return tuple(row.get(c) for c in COLUMNS)


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("pageSize", "50"))
        if not 1 <= self.limit <= MOST_ROWS:
            raise ValueError("invalid limit of a page")
        self.namespaces = [int(x) for x in options.get("namespaces", NAMESPACES).split("|")]
        self.first = {"ts": options.get("startTs", ""), "rcid": int(options.get("startRcid", "0"))}

    def initialOffset(self) -> dict:
        return self.first

    def _from(self, offset: dict, upto: dict | None = None) -> list[dict]:
        """Rows from the offset's second on, in order: what MOST_PAGES pages can show and one more, or all up to another offset."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        fit = pc.field("ns").isin(self.namespaces)
        if offset["ts"]:
            fit = fit & (pc.field("ts") >= dt.datetime.fromisoformat(offset["ts"]))
        if upto:
            fit = fit & (pc.field("ts") <= dt.datetime.fromisoformat(upto["ts"]))
        kept = None
        for batch in ds.dataset(self.path).scanner(filter=fit).to_batches():  # a batch at a time: no more rows stay than a poll looks at
            part = batch.to_pylist() if kept is None else kept + batch.to_pylist()
            part.sort(key=lambda r: (r["ts"], r["rcid"]))
            kept = part if upto else part[: MOST_PAGES * self.limit + 1]
        return kept or []

    @staticmethod
    def _cursor(offset: dict) -> tuple | None:
        return (dt.datetime.fromisoformat(offset["ts"]), offset["rcid"]) if offset["ts"] else None

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = next_page(self._from(start), self._cursor(start), self.limit)
        end = {"ts": page[-1]["ts"].isoformat(), "rcid": page[-1]["rcid"]} if page else start
        return iter([normal(r) for r in page]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if start == end:
            return iter([])
        low, high = self._cursor(start), self._cursor(end)
        return iter([normal(r) for r in self._from(start, end) if (low is None or (r["ts"], r["rcid"]) > low) and (r["ts"], r["rcid"]) <= high])
