"""Registered queries, by family."""

from __future__ import annotations

import importlib

FAMILIES = ("trade", "graph", "walks", "texts", "more", "pages", "scale", "derived")


def load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"lattica.plans.{name}")
