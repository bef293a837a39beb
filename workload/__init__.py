"""Registered queries over the driver's tables and their SQL counterparts."""

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
