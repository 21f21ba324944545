"""Registered queries: ``QUERIES[name](spark, sf_dir)`` and ``ORACLES[name]`` (DuckDB SQL)."""

import importlib

from framepair.catalog.base import ORACLES, QUERIES

MODULES = ("values", "timing", "splits", "joins", "frames", "reports", "outputs", "jobs", "streams", "folders")

for _name in MODULES:
    importlib.import_module(f"framepair.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
