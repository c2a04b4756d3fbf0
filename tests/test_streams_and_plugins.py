"""Full groups from a stream, plugged-in functions, scores and resumed runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.functions.numbering import global_row_number
from tracemill.functions.plugins import apply_filter, apply_process, load_function
from tracemill.operators import records as P
from tracemill.operators import scoring as C
from tracemill.streaming.groups import full_groups


def test_groups_leave_when_they_are_full(spark, tmp_path):
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    os.makedirs(source)

    def step(n, rows):
        with open(f"{source}/{n}.json", "w") as f:
            f.writelines(json.dumps({"instance_id": k, "content": c}) + "\n" for k, c in rows)
        stream = spark.readStream.schema("instance_id string, content string").json(source)
        q = full_groups(stream, 2).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.instance_id, r.n, r["items"]) for r in spark.read.parquet(out).collect()) if os.path.isdir(out) and any(f.endswith(".parquet") for f in os.listdir(out)) else []

    assert step(1, [("a", "x"), ("b", "")]) == []
    assert step(2, [("a", "y"), ("b", "z")]) == [("a", 2, ["x", "y"])]  # b has one text only
    assert step(3, [("b", "w"), ("a", "v")]) == [("a", 2, ["x", "y"]), ("b", 3, ["", "z", "w"])]
    assert len(step(4, [("a", "u")])) == 3  # a began anew with v


def positive(column):
    return F.col(column) > 0


def doubled(rows, column):
    return rows.withColumn(column, F.col(column) * 2)


def test_functions_by_path(spark):
    df = spark.createDataFrame([(1,), (-1,)], "v int")
    here = __name__
    assert [r.v for r in apply_filter(df, f"{here}.positive", column="v").collect()] == [1]
    assert sorted(r.v for r in apply_process(df, f"{here}.doubled", column="v").collect()) == [-2, 2]
    with pytest.raises(TypeError):
        apply_filter(df, f"{here}.doubled", rows=df, column="v")
    with pytest.raises(ValueError):
        load_function("name")


def test_global_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)] + [(10**12, 0)], "k long, i int")
    got = [(r.k, r.rn) for r in global_row_number(df, ["k"]).orderBy("rn").collect()]
    assert [rn for _, rn in got] == list(range(1, 102)) and [k for k, _ in got] == sorted(k for k, _ in got)
    assert global_row_number(df.where("false"), ["k"]).count() == 0


def test_resumed_runs(spark):
    old = spark.createDataFrame([(1, "t", False), (2, "t", True)], "run int, task string, finalized boolean")
    new = lambda *rows: spark.createDataFrame(list(rows), "run int, task string")
    assert C.resumable(old, new((1, "t"), (3, "x")), "run", ["task"]).count() == 2
    with pytest.raises(Exception, match="another identity"):
        C.resumable(old, new((1, "other")), "run", ["task"]).collect()
    with pytest.raises(Exception, match="finalized run"):
        C.resumable(old, new((2, "t")), "run", ["task"]).collect()


def test_record_projections(spark):
    df = spark.createDataFrame([("a", [0, 0, 1, 0], {"x": "1", "y": "2"}, {"y": "3"}), (None, [0], None, None)], "s string, m array<int>, l map<string,string>, r map<string,string>")
    assert [r[0] for r in df.select(P.merged_maps(F.col("l"), F.col("r"))).collect()] == [{"x": "1", "y": "3"}, {}]
    assert df.where("s = 'a'").select(P.response_window(F.col("m"), F.col("m"))).first()[0] == (2, [1, 0])
    with pytest.raises(Exception, match="no trainable token"):
        df.select(P.response_window(F.col("m"), F.col("m"))).collect()
    assert [r[0] for r in df.select(P.first_filled(F.lit(""), F.col("s"), F.lit("z"))).collect()] == ["a", "z"]
    with pytest.raises(Exception, match="marks and items differ"):
        df.select(P.placeholder_parts(F.lit("a<x>b"), "<x>", F.array())).collect()
    with pytest.raises(Exception, match="unknown reward"):
        df.select(P.dispatched(F.lit("q"), {"p": F.lit(1.0)})).collect()


def test_reordering_always_changes_something(spark):
    df = spark.createDataFrame([(g, n) for g in range(30) for n in ("a", "b")] + [(99, "only")], "g int, n string")
    out = P.stable_order(df, "g", "n", "s").collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.old, r.new))
    assert all(sorted(x[1] for x in v) == list(range(1, len(v) + 1)) for v in by.values())
    assert all(any(o != n for o, n in v) for g, v in by.items() if g != 99) and by[99] == [(1, 1)]
