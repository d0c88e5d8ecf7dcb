"""Registered queries over the supplied tables."""

from __future__ import annotations

import importlib

from .catalogue import REGISTRY, Query

MODULES = ("matching", "reports", "discovery", "onboarding", "tagging", "dedupe", "delivery", "scalars", "bootstrap", "streams", "runs")


def load_all() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return REGISTRY
