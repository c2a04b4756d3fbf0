"""Global row numbers without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpointed

_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id: the partition's number above, the row's below


def global_row_number(df: DataFrame, order: list[str], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """df with the row's place (from 1) in the order of `order`, whose columns may be of any kind; nulls come first.

    Rows are dealt out by ranges of `order` whose bounds Spark samples, so outliers and dense stretches of
    a key fill partitions of like size; each partition is sorted and numbered apart and gets the number of rows in
    those before it. The driver sees one count for each partition. Rows that are equal in all of `order` lie in one
    partition and follow in any order. The partitions are fixed in the shared folder, as sampled bounds may differ
    from one run to the next.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    fixed = checkpointed(ranged.withColumn("_part", F.shiftright("_at", 33).cast("int")))
    before, total = [], 0
    for r in sorted(fixed.groupBy("_part").count().collect()):
        before.append((r["_part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(before, "_part int, _before long")  # one row a partition
    return fixed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)) + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_before")
