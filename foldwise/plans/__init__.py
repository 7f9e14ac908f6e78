"""Registered query plans over the driver tables (imported for their registrations)."""

from __future__ import annotations

import importlib

from foldwise.plans.registry import ORACLES, QUERIES

_MODULES = ["q_features", "q_profile", "q_scoring", "q_stability", "q_parity", "q_catalog", "q_sources", "q_streaming", "q_models"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"foldwise.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
