"""Registered queries over the driver tables, with their SQL oracles."""

from loomspan.plans import corpus, lexical, morph, tokens  # noqa: F401  each registers its queries
from loomspan.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
