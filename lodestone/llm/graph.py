"""Connected components, as the near-duplicate operator uses them."""

from ..operators.graph import components

__all__ = ["components"]
