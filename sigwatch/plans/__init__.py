"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from sigwatch.plans.registry import CHECKS, QUERIES

_MODULES = ["detection", "cleaning", "sequences", "evaluation", "sip", "learning", "sliced", "streams"]


def load_all():
    for name in _MODULES:
        import_module(f"sigwatch.plans.{name}")
    return QUERIES, CHECKS
