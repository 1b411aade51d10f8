"""Every registered query of the engine and its DuckDB oracle."""

from __future__ import annotations

from corvane.plans import q_batches, q_ensembles, q_features, q_flow, q_geometry, q_graphs, q_hooks, q_metrics, q_molecules, q_pairs, q_shapes, q_sources, q_splits, q_transforms  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
