"""Plants kept as measurements and a family table, joined only after they are reduced.

Where measurements (a fact table) and families (a dimension with one row per key) are separate tables,
joining first sends every measurement through the shuffle of the join. Statistics per family do not need that: the
measurements are reduced by the family key where they lie, and only the reduced rows meet the families.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JoinedPlants:
    """Measurements and families, read like one table of plants by the operators.

    ``facts`` has the column ``key``; ``families`` has one row per ``key``, never null, and the columns
    that belong to a family, its name (``family``) among them. No two rows of ``families`` agree in the columns
    ``unique``. Measurements without a family are left out.
    """

    facts: DataFrame
    families: DataFrame
    key: str
    family: str = "Dam_ID"
    unique: tuple[str, ...] = ("Dam_ID",)

    @property
    def columns(self) -> list[str]:
        return [c for c in [*self.facts.columns, *self.families.columns] if c != self.key]

    def rows(self) -> DataFrame:
        """The plants themselves: every measurement beside its family."""
        return self.facts.join(self.families, self.key).drop(self.key)

    def select(self, *columns: str | Column) -> DataFrame:
        return self.rows().select(*columns)

    def where(self, condition: Column) -> JoinedPlants:
        """The plants for which a condition on measurements holds."""
        return replace(self, facts=self.facts.where(condition))

    def groupBy(self, *by: str | Column) -> _Grouped | object:
        """Groups within one key are reduced before the join, others after it."""
        if not set(self.unique) <= {c for c in by if isinstance(c, str)}:
            return self.rows().groupBy(*by)
        return _Grouped(self, by)

    def in_families(self, listed: DataFrame, null_safe: bool = True) -> DataFrame:
        """The plants whose family is in a list: measurements are picked by key before the join."""
        name = F.col(self.family)
        wanted = listed.select(F.col(self.family).alias("_listed"))
        same = name.eqNullSafe(F.col("_listed")) if null_safe else name == F.col("_listed")
        families = self.families.join(wanted, same, "left_semi")
        return self.facts.join(families, self.key).drop(self.key)


@dataclass(frozen=True)
class _Grouped:
    plants: JoinedPlants
    by: tuple

    def agg(self, *aggregates: Column) -> DataFrame:
        plants = self.plants
        own = [c for c in self.by if isinstance(c, str) and c in plants.families.columns]
        others = [c for c in self.by if not (isinstance(c, str) and c in plants.families.columns)]
        reduced = plants.facts.groupBy(plants.key, *others).agg(*aggregates)
        left = [c for c in reduced.columns if c != plants.key]
        names = left[: len(others)]
        return reduced.join(plants.families, plants.key).select(*own, *names, *left[len(others) :])
