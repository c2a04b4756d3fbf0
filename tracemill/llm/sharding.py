"""Contiguous shards of near-equal byte size, from global prefix sums.

Rows are dealt over partitions by range of their order, each partition reports its total, and the
running sums of those totals (one number a partition) are all that the driver sees. Each partition
then continues the prefix sum over its own rows; equal targets of the total cut the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, text_or_empty


def _prefix(totals: dict[int, tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], int, int]:
    weight = rows = 0
    before = {}
    for pid in sorted(totals):
        before[pid] = (weight, rows)
        weight, rows = weight + totals[pid][0], rows + totals[pid][1]
    return before, weight, rows


def ordered_prefix(df: DataFrame, order: list, weight: str, partitions: int | None = None) -> tuple[DataFrame, int, int]:
    """df in the order of `order`, with `before` (weight of all earlier rows) and `row_before` (their number).

    Also returns the whole weight and the number of rows. `weight` is a column of non-negative
    longs. Rows that are equal in all of `order` follow in any order. Only the range partitioning
    moves rows; the driver gets two numbers for each partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The range bounds come from a sample, so the partitions are fixed on disk before they are summed.
    pid = free_name(df, "_pid")
    fixed = checkpointed(ranged.withColumn(pid, F.spark_partition_id()))
    totals = {r[pid]: (int(r["w"] or 0), r["n"]) for r in fixed.groupBy(pid).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect()}
    before, whole, rows = _prefix(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = r = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if w is None:
                w, r = before[batch.column(pid)[0].as_py()]
            own = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(own)
            keep = [x for x in batch.schema.names if x != pid]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(w + sums - own), pa.array(r + np.arange(len(own), dtype=np.int64))], names=[*keep, "before", "row_before"])
            w, r = w + int(sums[-1]), r + len(own)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema if f.name != pid) + ", before long, row_before long"
    return fixed.mapInArrow(run, schema), whole, rows


def byte_shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and place of every row: key, size, text_crc32, shard (0 to n_shards - 1) and slot (from 0 in each shard).

    Size is the UTF-8 length plus 1. Rows go in the order of key, size and CRC; a row belongs to the
    shard in which the middle of its bytes falls, so a shard differs from the mean by one row at
    most on either side. Null texts count as empty, null keys come first, repeated rows are kept,
    an empty table gives no rows, other columns are ignored, and a row longer than a whole target
    leaves some shards empty.
    """
    body = text_or_empty(text)
    base = docs.select(F.col(key).cast("long").alias(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed, whole, _ = ordered_prefix(base, [key, "size", "text_crc32"], "size")
    # 2 * before + size is twice the middle; dividing by 2 * whole / n_shards cuts at equal targets.
    middle = F.col("before") * 2 + F.col("size")
    target = F.lit(max(1, 2 * whole)).cast("decimal(38,0)")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(20,0)") * n_shards / target).cast("int"))
    cut = placed.withColumn("shard", shard)
    # One row for each shard: where it begins.
    firsts = cut.groupBy("shard").agg(F.min("row_before").alias("first_row"))
    return cut.join(F.broadcast(firsts), "shard").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard"), (F.col("row_before") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The same in DuckDB for 16 shards; the CRC comes from its polynomial.
ORACLE = r"""
with steps as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::ubigint, [0::ubigint,0,0,0,0,0,0,0]), lambda c, z: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)) as t),
sized as (select doc_id, encode(coalesce(text, '')) as raw, octet_length(encode(coalesce(text, ''))) + 1 as size from documents),
bytes as (select doc_id, size, list_transform(range(size - 1), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as ubigint)) as b from (select doc_id, size, hex(raw) as h from sized)),
summed as (select doc_id, size, cast(xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, x: xor(t[cast(xor(c, x) & 255 as int) + 1], c >> 8)), 4294967295::ubigint) as bigint) as text_crc32 from bytes, steps),
placed as (select *, sum(size) over (order by doc_id, size, text_crc32 rows unbounded preceding) - size as before, sum(size) over () as whole from summed),
cut as (select *, cast(least(15, ((2 * before + size) * 16) // (2 * whole)) as int) as shard from placed)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard, cast(row_number() over (partition by shard order by before) - 1 as bigint) as slot, cast(null as int) as grown_shard from cut
"""
