"""Runnable queries over the given tables, one per operator."""

from tarnlake.plans import changes, decoding, definitions, scans, shaping, stores, totals  # noqa: F401
from tarnlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
