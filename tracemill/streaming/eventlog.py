"""An append-only event log of runs, written from a stream: numbered without gaps, large payloads set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scoring import resumable

#: A batch whose number divides by this notes down the last numbers of all runs, any other those of its own runs.
WHOLE = 10


def numbered(batch: DataFrame, heads: DataFrame, run: str, order: str) -> DataFrame:
    """The rows of batch with seq, from 1 on in each run and without gaps after the run's largest `last` in heads.

    A batch's events of a run are numbered in the order of `order`, nulls at the end; nothing that arrives late is put in between what came
    before. One run's events of one batch are sorted in one task, where they stream by, so the source's limit of a trigger bounds its time.
    """
    own = batch.withColumn("_last_seq", F.lit(None).cast("long"))
    # A run's last numbers come before its events, so that both are dealt out and sorted once.
    both = own.unionByName(heads.select(run, F.col("last").alias("_last_seq")), allowMissingColumns=True)
    new = F.col("_last_seq").isNull()
    so_far = Window.partitionBy(run).orderBy(new, F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = F.coalesce(F.max("_last_seq").over(so_far), F.lit(0)) + F.count_if(new).over(so_far)
    return both.withColumn("seq", seq.cast("long")).where(new).select(*batch.columns, "seq")


def _heads(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The last numbers of runs before this batch; a run may stand there once a batch. A batch that is written again sees those before it only."""
    paths = [f"{path}/heads/batch={i}" for i in range(max(0, (batch_id - 1) // WHOLE * WHOLE), batch_id)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _append(path: str, run: str, order: str, payload: str, limit: int, after: Callable[[int], None] | None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[run].dataType.simpleString()
        body = F.col(payload)
        large = F.octet_length(body) > limit
        digest = F.when(large, F.sha2(body, 256))
        heads = _heads(spark, path, f"`{run}` {kind}, last long", batch_id)
        rows = numbered(batch.withColumns({"payload_ref": digest, payload: F.when(~large, body)}), heads, run, order)
        # A batch that is written again after a failure lies in the same folder as before.
        rows.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        batch.where(large).select(F.sha2(body, 256).alias("digest"), body.alias("payload")).distinct().write.mode("overwrite").parquet(f"{path}/payloads/batch={batch_id}")
        last = spark.read.schema(f"`{run}` {kind}, seq long").parquet(f"{path}/events/batch={batch_id}").withColumnRenamed("seq", "last")
        if batch_id % WHOLE == 0:
            last = last.unionByName(heads)
        last.groupBy(run).agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{path}/heads/batch={batch_id}")
        if after:
            after(batch_id)

    return write


def write_log(events: DataFrame, path: str, run: str = "run_id", order: str = "ts", payload: str = "payload", limit: int = 256, after: Callable[[int], None] | None = None) -> None:
    """Appends all that a stream of events has now to the log at path, from where its last start ended.

    The log holds events with seq, and payload_ref in place of a payload of more than `limit` bytes; such payloads lie beside it by their SHA-256, and
    so do the last numbers of the runs by batch, from which the next batch goes on. A start that failed between writing a batch and noting it down writes that batch again, in its place and with its numbers.
    `after` is called with the number of each batch that was written.
    """
    writer = events.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state")
    running = writer.foreachBatch(_append(path, run, order, payload, limit, after)).trigger(availableNow=True).start()
    running.awaitTermination()


def read_log(spark: SparkSession, path: str, schema: str, refs: bool = False) -> DataFrame:
    """The log's events, with the payloads that were set aside put back; schema is that of the events without seq and payload_ref, and names the payload. refs: payload_ref stays."""
    events = spark.read.schema(f"{schema}, seq long, payload_ref string").parquet(f"{path}/events").drop("batch")
    payloads = spark.read.schema("digest string, payload string").parquet(f"{path}/payloads").dropDuplicates(["digest"]).select(F.col("digest").alias("payload_ref"), F.col("payload").alias("_large"))
    return events.join(payloads, "payload_ref", "left").withColumn("payload", F.coalesce("payload", "_large")).drop("_large", *([] if refs else ["payload_ref"]))


def open_runs(manifests: DataFrame, asked: DataFrame, run: str, identity: list[str]) -> DataFrame:
    """The manifests after `asked` runs are opened: known ones stay, new ones join them, not finalised.

    A run whose identity differs from its manifest's, or that is finalised, raises.
    """
    allowed = resumable(manifests, asked.select(run, *identity), run, identity)
    new = allowed.join(manifests.select(run), run, "left_anti").select(run, *identity, F.lit(False).alias("finalized"))
    checked = allowed.join(manifests.select(run), run, "left_semi").select(run).distinct()
    # The known runs that were asked for are read, so that what raises does.
    kept = manifests.join(checked.withColumn("_asked", F.lit(True)), run, "left").select(run, *identity, F.coalesce(F.when(F.col("_asked"), F.col("finalized")), F.col("finalized")).alias("finalized"))
    return kept.unionByName(new)
