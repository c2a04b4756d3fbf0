"""Queries on streams, driven over the event files to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import fresh_path
from ..streaming.eventlog import read_log, write_log
from ..streaming.groups import full_groups
from .registry import query, table


def _finished(spark, stream, kind: str):
    """The rows of a stream after all its files."""
    path = fresh_path(spark, kind)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows")
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("""select cast(user_id as varchar) as instance_id, cast(count(*) as int) as n, cast(count(*) filter (event_type <> 'error') as int) as n_filled from events group by user_id having count(*) filter (event_type <> 'error') >= 8""")
def op_t01_stream(spark, sf_dir):
    """Users' events in groups of 8 or more of which as many have text, once they are full; errors have none."""
    events = _events(spark, sf_dir)
    rollouts = events.select(F.col("user_id").cast("string").alias("instance_id"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("content"))
    return _finished(spark, full_groups(rollouts, 8), "groups").select("instance_id", "n", "n_filled")


@query("select event_id, user_id, event_type from events")
def op_k08_eventlog(spark, sf_dir):
    """Events appended to a log of files as they arrive."""
    return _finished(spark, _events(spark, sf_dir).select("event_id", "user_id", "event_type"), "eventlog")


@query("""select event_id, user_id, row_number() over (partition by user_id order by event_id) as seq, case when event_id % 5 = 0 then repeat(event_type || ':' || user_id % 3 || ' ', 40) else props end as payload, event_id % 5 = 0 as aside from events""")
def op_k08_log(spark, sf_dir):
    """Events that come in four parts, one start and micro-batch each, in a log that numbers each user's and sets large payloads aside."""
    e = table(spark, sf_dir, "events")
    # Repeated payloads of few kinds, so that one that is set aside is kept once a batch.
    large = F.repeat(F.format_string("%s:%d ", "event_type", F.col("user_id") % 3), 40)
    rows = e.select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, large).otherwise(F.col("props")).alias("payload"))
    schema = "event_id long, user_id long, payload string"
    path = fresh_path(spark, "k08")
    low, high = e.agg(F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    at = F.coalesce("event_id", F.lit(high))  # events without an id come last
    for part in range(4):
        a, b = (low + (high + 1 - low) * k // 4 for k in (part, part + 1))
        rows.where((at >= a) & (at < b)).write.mode("append").parquet(f"{path}/in")
        write_log(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/log", "user_id", "event_id")
    return read_log(spark, f"{path}/log", schema, refs=True).select("event_id", "user_id", "seq", "payload", F.col("payload_ref").isNotNull().alias("aside"))


def _events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
