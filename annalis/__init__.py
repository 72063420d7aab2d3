"""Entity-year panel analytics on Spark DataFrames."""

from annalis.spec import PanelSpec

__all__ = ["PanelSpec"]
