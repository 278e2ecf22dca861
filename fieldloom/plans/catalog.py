"""All registered queries of the reference's operators, and their SQL."""

from __future__ import annotations

from fieldloom.plans import q_graph, q_hist, q_learn, q_raster, q_sets, q_vectors  # noqa: F401
from fieldloom.plans.registry import ORACLES, QUERIES  # noqa: F401
