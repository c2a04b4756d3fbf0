"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed


def join_measured(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", max_bytes: int = 32 << 20) -> DataFrame:
    """left joined with right, which is fixed in the shared folder and broadcast if its rows take max_bytes of JSON at most.

    Beyond that both sides are dealt out by the keys straight from their exchange, so that adaptive
    execution can split a key which holds many rows of left.
    """
    fixed = checkpointed(right)
    size = fixed.agg(F.sum(F.octet_length(F.to_json(F.struct(*fixed.columns), {"ignoreNullFields": "false"}))).alias("n")).first()["n"] or 0
    return left.join(F.broadcast(fixed) if size <= max_bytes else fixed, keys, how)
