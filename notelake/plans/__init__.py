"""The registered queries; importing this module registers all of them."""

from notelake.plans import ingests, manifests, pieces, planning, schedules, scores, sequences, sources, streams, tempos  # noqa: F401
from notelake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
