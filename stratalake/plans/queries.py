"""Registered queries of the engine's own operators, and their DuckDB SQL."""

from __future__ import annotations

from . import q_masks, q_pairs, q_solvers, q_sources, q_stats  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
