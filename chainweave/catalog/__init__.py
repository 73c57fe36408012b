"""The registered queries over the given tables."""

from chainweave.catalog import (  # noqa: F401
    alignment_queries,
    call_queries,
    grid_queries,
    interval_queries,
    liftover_queries,
    search_queries,
    sequence_queries,
)
from chainweave.catalog._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
