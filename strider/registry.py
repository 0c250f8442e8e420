"""Collects the query modules of strider.plans: each has QUERIES and ORACLES."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strider import plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda x: x.name):
        yield importlib.import_module(f"strider.plans.{info.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
