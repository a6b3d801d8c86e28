"""Registered queries, grouped by area."""

from . import audit, binning, community, decisions, design, files, identity, panel, recovery, scalars, similarity, taxonomy, windows  # noqa: F401
from .registry import REGISTRY  # noqa: F401
