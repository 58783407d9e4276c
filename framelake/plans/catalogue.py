"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

from framelake.plans.registry import ORACLES, QUERIES, Query

MODULES = ("timeline_queries", "retime_queries", "plane_queries", "rule_queries", "storage_queries",
           "colour_queries", "stream_queries", "file_queries")

for _name in MODULES:
    importlib.import_module(f"framelake.plans.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
