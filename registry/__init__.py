"""Registered queries over the given tables, one per operator."""

from registry import q_blocks, q_columns, q_encode, q_flows, q_importance, q_sampling, q_scores, q_trees  # noqa: F401
from registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
