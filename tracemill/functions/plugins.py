"""Functions by dotted path, for filters, rewards and reducers that a caller supplies."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame


def load_function(path: str) -> Callable:
    """The function at package.module.name."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"no module in {path!r}")
    return getattr(importlib.import_module(module), name)


def apply_filter(rows: DataFrame, path: str, **options) -> DataFrame:
    """rows that satisfy the condition which the function at path returns (a Column)."""
    condition = load_function(path)(**options)
    if not isinstance(condition, Column):
        raise TypeError(f"{path} gives no condition")
    return rows.where(condition)


def apply_process(rows: DataFrame, path: str, **options) -> DataFrame:
    """What the function at path makes of the rows (a DataFrame)."""
    out = load_function(path)(rows, **options)
    if not isinstance(out, DataFrame):
        raise TypeError(f"{path} gives no rows")
    return out
