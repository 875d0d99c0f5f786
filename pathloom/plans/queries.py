"""All registered queries; importing the modules fills the registry."""

from . import graph_queries, finding_queries, source_queries, stored_queries  # noqa: F401, I001
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
