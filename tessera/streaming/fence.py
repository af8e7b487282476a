"""The revision fence on a stream: one revision of state per entity, no watermark (late events must reach the fence)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.changes import observe

SCHEMA = "entity_id string, rcid long, revid long, decision string, indexed long"


def _decide(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    indexed = state.get[0] if state.exists else 0
    rows = pd.concat(frames).sort_values(["ts", "rcid"])
    out = []
    for rcid, rev, old in zip(rows["rcid"], rows["revid"], rows["old_revid"]):
        decision, indexed = observe(indexed, rev, old)
        out.append((key[0], rcid, rev, decision, indexed))
    state.update((int(indexed),))
    yield pd.DataFrame(out, columns=["entity_id", "rcid", "revid", "decision", "indexed"])


def fence_stream(events: DataFrame) -> DataFrame:
    """A streaming frame of events -> decisions; the rows of a micro-batch are taken in cursor order."""
    return events.groupBy("entity_id").applyInPandasWithState(_decide, SCHEMA, "indexed long", "append", "NoTimeout")
