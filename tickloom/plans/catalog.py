"""All registered queries, by importing the modules that register them."""

from . import columns, counts, growing, scans, series, variance  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
