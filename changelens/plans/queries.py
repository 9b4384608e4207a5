"""All queries of the change-record operators; importing the modules registers them."""

from . import contrast_queries, extra_queries, family_queries, integrity_queries, misc_queries, record_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
