"""Connected components of links between ids, as the library has them."""

from gleanery.operators.components import components

__all__ = ["components"]
