"""The panel descriptor: which columns identify an entity-year row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec


@dataclass(frozen=True)
class PanelSpec:
    """One row per entity per year; an entity may skip years."""

    entity: str = "CO_ENTIDADE"
    year: str = "ANO"

    @property
    def keys(self) -> list[str]:
        return [self.year, self.entity]

    def history(self) -> WindowSpec:
        """Rows of one entity in year order. Its size is the number of years."""
        return Window.partitionBy(self.entity).orderBy(self.year)

    def years_away(self, k: int) -> WindowSpec:
        """The row of the same entity exactly ``k`` years away, if it exists."""
        return self.history().rangeBetween(k, k)
