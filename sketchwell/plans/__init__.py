"""Registered queries and their SQL twins."""

from sketchwell.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
