"""Registered queries and their SQL counterparts."""

from tidelog.plans import allocating, failing, filtering, placing, processing, sizing, watching  # noqa: F401
from tidelog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
