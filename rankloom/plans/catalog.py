"""All registered queries, imported for their registration side effect."""

from __future__ import annotations

import importlib

from rankloom.plans.registry import REGISTRY

_MODULES = ("digest", "ingest", "scoring", "rerank", "mail", "feedback", "history", "proposals", "evals", "streaming")


def load():
    for m in _MODULES:
        importlib.import_module(f"rankloom.plans.{m}")
    return REGISTRY
