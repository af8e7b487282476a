"""Names that a deployment chooses: the prefix of its graphs' IRIs, its models and its sources. Every operator takes them as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of an instance's UUID.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


@dataclass(frozen=True)
class Names:
    graphs: str = "urn:kg"
    snapshot: str = "snapshot-v1"
    normalization: str = "normalization-v1"
    partition: str = "partition-v1"
    source: str = "standalone"
    query: str = "standalone-query"
    #: Sources and query services of an instance are these, then a point or hyphen, then its UUID.
    instance_source: str = "custom-source"
    instance_query: str = "custom-query"
    #: What an inventory calls a subject that is an entity.
    entity_type: str = "wikibase-entity"
    first_instance: str = "00000000-0000-4000-8000-000000000001"

    def graph(self, kind: str, entity: Column | None = None) -> Column:
        return F.lit(f"{self.graphs}:{kind}") if entity is None else F.concat(F.lit(f"{self.graphs}:{kind}:"), entity)

    @property
    def source_pattern(self) -> str:
        return f"^{self.instance_source}[.]{UUID}$"


NAMES = Names()


def checked_entity(entity: Column, pattern: str = "^[QP][1-9][0-9]*$") -> Column:
    """The id, or a failed job if it is none."""
    return F.when(entity.rlike(pattern), entity).otherwise(F.raise_error(F.concat(F.lit("invalid entity ID: "), F.coalesce(entity, F.lit("null")))))
