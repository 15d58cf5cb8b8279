"""The query catalog over the driver's tables."""

from __future__ import annotations

import importlib

_MODULES = ["feature_queries", "diagnosis_queries", "crosssection_queries", "macro_queries", "outcome_queries", "registry_queries", "model_queries", "stream_queries"]


def load_catalog():
    """Import every query module once and return the registry."""
    from .catalog import REGISTRY

    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return REGISTRY
