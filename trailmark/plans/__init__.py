"""Registered queries over the provided tables, each with its SQL counterpart where one exists."""

from trailmark.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
