"""An event log over several micro-batches and starts, with a failure between them."""

import json
import os

import pytest

from pyspark.sql import functions as F

from tracemill.plans.streams import op_k08_log
from tracemill.streaming.eventlog import open_runs, read_log, write_log

SCHEMA = "run_id string, ts long, payload string"


def feed(root, name, rows):
    root.mkdir(exist_ok=True)
    with open(root / f"{name}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("run_id", "ts", "payload"), r, strict=True))) + "\n" for r in rows)
    os.utime(root / f"{name}.json", (1_700_000_000 + name, 1_700_000_000 + name))  # files are read in the order of their times


def test_a_start_after_a_failure_leaves_no_gap_and_no_repeat(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    long = "x" * 300
    parts = [[("a", 2, "p"), ("a", 1, long), ("b", 1, None)], [("a", 3, long), ("c", 9, "q")], [("b", 0, "late"), ("a", 4, "")], [("c", 10, "r" * 400)]]
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(parts[:3]):
        feed(source, i, rows)

    def fail(batch):
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        write_log(stream(), log, after=fail)
    feed(source, 3, parts[3])
    write_log(stream(), log)
    write_log(stream(), log)  # nothing new
    got = sorted((r.run_id, r.seq, r.ts, r.payload) for r in read_log(spark, log, SCHEMA).collect())
    assert got == [("a", 1, 1, long), ("a", 2, 2, "p"), ("a", 3, 3, long), ("a", 4, 4, ""), ("b", 1, 1, None), ("b", 2, 0, "late"), ("c", 1, 9, "q"), ("c", 2, 10, "r" * 400)]
    events = spark.read.parquet(f"{log}/events")
    assert events.select("batch").distinct().count() == 4 and events.where("payload_ref is not null").count() == 3 and events.where("length(payload) > 256").count() == 0
    assert spark.read.parquet(f"{log}/payloads").select("digest").distinct().count() == 2


def test_numbers_go_on_over_many_batches(spark, tmp_path):
    """Runs that rest for more batches than the last numbers are kept apart for, a run without a name, and numbers that a double can't hold."""
    source, log, big = tmp_path / "in", str(tmp_path / "log"), 2**53 + 1
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    feed(source, 0, [("early", big, "p"), ("early", None, "q"), (None, 5, "x"), (None, 4, "y")])
    for i in range(1, 21):
        feed(source, i, [("often", i, "z"), (f"run {i}", big, None)])

    for at in (10, 15):

        def fail(batch, at=at):
            if batch == at:
                raise RuntimeError("lost")

        with pytest.raises(Exception, match="lost"):
            write_log(stream(), log, after=fail)
    write_log(stream(), log)
    feed(source, 21, [("early", 0, "r"), (None, 6, "w"), ("often", 0, "z"), ("run 12", 1, "v")])
    write_log(stream(), log)
    got = {(r.run_id, r.seq): (r.ts, r.payload) for r in read_log(spark, log, SCHEMA).collect()}
    want = {("early", 1): (big, "p"), ("early", 2): (None, "q"), ("early", 3): (0, "r"), (None, 1): (4, "y"), (None, 2): (5, "x"), (None, 3): (6, "w"), ("often", 21): (0, "z"), ("run 12", 2): (1, "v")}
    want |= {("often", i): (i, "z") for i in range(1, 21)} | {(f"run {i}", 1): (big, None) for i in range(1, 21)}
    assert got == want and read_log(spark, log, SCHEMA).count() == len(want)
    assert "payload_ref" in read_log(spark, log, SCHEMA, refs=True).columns


def test_the_log_holds_events_of_one_id_and_of_none(spark, tmp_path):
    events = spark.createDataFrame([(1, 7, "view", "a"), (1, 7, "view", "a"), (5, 7, "click", "b"), (None, 7, "view", "c"), (9, None, "view", "d")], "event_id long, user_id long, event_type string, props string")
    events.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("value", F.lit(1.0)).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in op_k08_log(spark, str(tmp_path)).select("event_id", "user_id", "seq", "aside").collect()]
    assert sorted(got, key=str) == sorted([(1, 7, 1, False), (1, 7, 2, False), (5, 7, 3, True), (None, 7, 4, False), (9, None, 1, False)], key=str)


def test_a_batch_of_many_runs_is_written_without_python(spark, tmp_path):
    """Numbering took some milliseconds of Python a run, twice a batch."""
    spark.range(2000).select(F.col("id").cast("string").alias("run_id"), F.col("id").alias("ts"), F.lit("p").alias("payload")).write.json(str(tmp_path / "in"))
    seen = []
    write_log(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), str(tmp_path / "log"), after=seen.append)
    assert seen == [0] and not (tmp_path / "log" / "state" / "state").exists()
    assert read_log(spark, str(tmp_path / "log"), SCHEMA).where("seq = 1").count() == 2000


def test_runs_are_opened_under_their_identity(spark):
    schema = "run_id string, task string, profile string, finalized boolean"
    known = spark.createDataFrame([("a", "t", "p", False), ("b", "t", "p", True), ("c", None, "p", False)], schema)
    ask = lambda *rows: spark.createDataFrame(list(rows), "run_id string, task string, profile string")
    rows = open_runs(known, ask(("a", "t", "p"), ("c", None, "p"), ("d", "u", "p")), "run_id", ["task", "profile"]).collect()
    assert sorted((r.run_id, r.finalized) for r in rows) == [("a", False), ("b", True), ("c", False), ("d", False)]
    with pytest.raises(Exception, match="another identity: a"):
        open_runs(known, ask(("a", "other", "p")), "run_id", ["task", "profile"]).collect()
    with pytest.raises(Exception, match="finalized run: b"):
        open_runs(known, ask(("b", "t", "p")), "run_id", ["task", "profile"]).collect()
