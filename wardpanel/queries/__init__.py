"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

AREAS = ("panel", "backtest", "stay", "jobs", "sources", "learning", "knowledge")


def load_all():
    for area in AREAS:
        importlib.import_module(f"wardpanel.queries.{area}")
    from wardpanel.queries.registry import QUERIES, SQL

    return QUERIES, SQL
