"""The operators bound to tables, and the same results in SQL: all queries with those that register theirs beside them."""

from . import pages, sets, stores  # noqa: F401
from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
