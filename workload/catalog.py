"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("reads", "junctions", "matrices", "bulk", "cells", "roundtrips", "checks")


def collect(kind: str) -> dict:
    found: dict = {}
    for area in AREAS:
        found.update(getattr(import_module(f"workload.{area}"), kind))
    return found
