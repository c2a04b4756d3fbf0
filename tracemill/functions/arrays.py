"""Work on arrays that built-in functions only do in quadratic time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def running_ends(lengths: Column) -> Column:
    """array<long>: 0 and the running sums of an array of lengths, in one pass; null where the array is null. A null length counts as 0."""

    @F.pandas_udf("array<long>")
    def sums(lists: pd.Series) -> pd.Series:
        def one(x):
            return None if x is None else np.concatenate(([0], np.cumsum([0 if v is None or v != v else int(v) for v in x], dtype=np.int64)))

        return lists.map(one)

    return sums(lengths)


def spans_of(ends: Column, kind: str = "long") -> Column:
    """array<struct<start, end>>: the spans between the neighbours of running_ends()."""
    n = F.size(ends) - 1
    return F.zip_with(F.slice(ends, F.lit(1), n), F.slice(ends, F.lit(2), n), lambda a, b: F.struct(a.cast(kind).alias("start"), b.cast(kind).alias("end")))
