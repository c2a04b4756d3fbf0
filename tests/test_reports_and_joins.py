"""Overlaps, contexts, samples and reports on odd rows, against plain Python or by hand."""

import pathlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions.joining import join_measured
from tracemill.functions.storage import shared_dir
from tracemill.operators import contexts as C
from tracemill.operators import joins as J
from tracemill.operators import reports as R
from tracemill.operators import samples as S


@pytest.mark.parametrize("least", [1, 2, 5, 40])
def test_overlaps_of_least_equal_brute_force(spark, least):
    rng = random.Random(least)
    side = lambda n: {i: [rng.choice(["the", "of", *(f"w{k}" for k in range(30))]) for _ in range(rng.randrange(25))] for i in range(n)}
    left, right = side(30), side(20)
    left[0] = ["the"] * 50
    right[0] = ["the"] * 45
    rows = lambda d, key: spark.createDataFrame([(k, t) for k, ts in d.items() for t in ts] + [(None, "the"), (1, None)], f"{key} int, token string")
    got = {(r.a, r.b): r.common for r in J.overlaps_of_least(rows(left, "a"), rows(right, "b"), "a", "b", "token", least).collect()}
    want = {(a, b): n for a, x in left.items() for b, y in right.items() if (n := sum((Counter(x) & Counter(y)).values())) >= least}
    assert got == want


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_measured_joins_give_the_same_rows(spark, max_bytes):
    left, right = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string"), spark.createDataFrame([(1, None)], "k int, w string")
    assert sorted((r.v, r.k, r.w) for r in join_measured(left, right, ["k"], "left", max_bytes).collect()) == [("a", 1, None), ("b", 2, None), ("c", None, None)]
    assert join_measured(left, right.where("false"), ["k"], "inner", max_bytes).count() == 0


def test_contexts_by_reference(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, None, None), (1, 3, "assistant", "é日"), (2, 0, "assistant", "first"), (2, 0, "assistant", "twin")]
    df = spark.createDataFrame(rows, "k int, at int, role string, text string").withColumn("context", F.lit("x"))
    ranges = C.context_ranges(df, "k", "at", F.col("role") == "assistant")
    got = sorted((r.k, r.at, r.n_context, r.context) for r in C.with_contexts(ranges, C.trace_texts(df, "k", "at"), "k", F.lit("none")).collect())
    assert got == [(1, 1, 1, "user: hi"), (1, 3, 3, "user: hi\nassistant: yo\n: "), (2, 0, 0, "none"), (2, 0, 0, "none")]
    assert C.context_ranges(df.where("false"), "k", "at", F.col("role") == "assistant").count() == 0
    with pytest.raises(ValueError, match="profiles"):
        C.rendered_calls(df, df, spark.range(3).withColumnRenamed("id", "profile_id"), max_profiles=2)


def test_raw_samples_on_odd_lines(spark):
    lines = spark.createDataFrame([(1, None), (2, "null"), (3, '"text"'), (4, "{}"), (5, '{"metadata":[],"tool_specs":{},"target_blocks":{}}'), (6, '{"sample_id":3,"metadata":{"transformation_mode":"m","source_trace_path":"a","source_request_id":"a","source_catalog_id":"a","base_profile_id":"a","target_profile_id":"a","tool_use_remap_report":{"unmapped_tool_uses":false}},"tool_specs":[{"name":"f"}],"target_blocks":[null,{"block_type":"tool_use","tool_call":{"name":"f"}}]}')], "line_no int, line string")
    issues = S.raw_sample_issues(lines)
    got = {}
    for r in sorted(issues.collect(), key=lambda r: (r.line_no, r["at"])):
        got.setdefault(r.line_no, []).append(r.reason)
    empty = ["missing_transformation_mode", "empty_visible_tool_specs", "missing_source_metadata", "missing_remap_report"]
    assert got == {2: ["invalid_sample_shape"], 3: ["invalid_sample_shape"], 4: empty, 5: empty}
    report = {(r.part, r.name): r.n for r in S.validation_report(lines, issues).collect()}
    assert report[("samples", "")] == 5 and report[("valid", "")] == 1 and report[("mode", "m")] == 1
    assert S.raw_sample_issues(lines.where("false")).count() == 0


def test_catalogs_raise_when_strict(spark):
    requests = spark.createDataFrame([(1, '{"tools":[{"name":"a","input_schema":{"type":"object"}},{"type":"custom","name":"b"}]}'), (2, None), (3, '{"tools":3}')], "id int, body string")
    catalog = S.request_catalog(requests, "id")
    profile = S.identity_profile(catalog, "id").orderBy("position").collect()
    assert [(r.profile_id, r.exposed_name, r.canonical_name, r.kind, r.input_schema) for r in profile] == [(1, "a", "a", "function", '{"type":"object"}'), (1, "b", "b", "freeform", "{}")]
    with pytest.raises(Exception, match="tool 4 0 no_name"):
        S.request_catalog(spark.createDataFrame([(4, '{"tools":[{}]}')], "id int, body string"), "id").collect()


def test_orphans_raise_when_strict(spark):
    rows = [("a", 1, "m", "req"), ("a", 2, "m", "chunk"), ("b", 3, "m", "chunk"), ("b", 4, "m", "req"), ("a", 5, "m", "odd"), ("a", 6, "x", "req"), (None, 7, "m", "chunk")]
    events = spark.createDataFrame(rows, "request string, at int, route string, kind string")
    found = S.anchored_events(events, "request", "at", "route", "kind", {"m": "req"}, {"m": ("chunk",)}, strict=False)
    assert sorted(r["at"] for r in found.where("orphan").collect()) == [3, 5, 6, 7]
    with pytest.raises(Exception, match="no request of chunk b"):
        S.anchored_events(events.where("request = 'b'"), "request", "at", "route", "kind", {"m": "req"}, {"m": ("chunk",)}).collect()


def test_reports_over_nothing(spark):
    plan = spark.createDataFrame([("a",), ("b",)], "run_id string")
    records = spark.createDataFrame([("a", "trajectory_recorded", "completed", None), ("z", "executor_error", None, None)], "run_id string, outcome string, trajectory_status string, failure_kind string")
    got = {(r.part, r.name): r.n for r in R.campaign_report(plan, records).collect()}
    assert got == {("runs", "planned"): 2, ("runs", "terminal"): 1, ("runs", "pending"): 1, ("runs", "executor_errors"): 0, ("runs", "failed_trajectories"): 0, ("runs", "contract_ok"): 0, ("outcome", "trajectory_recorded"): 1, ("trajectory_status", "completed"): 1}
    done = {(r.part, r.name): r.n for r in R.campaign_report(plan.where("run_id = 'a'"), records).collect()}
    assert done[("runs", "contract_ok")] == 1
    children = spark.createDataFrame([("x", True, 3), ("y", None, 4)], "source string, ok boolean, samples int")
    assert R.study_report(children, ["samples"]).first().asDict() == {"samples": 7, "n_children": 2, "n_failed": 1, "first_failed": "y", "issue": "study_child_verification_failed"}
    assert R.study_report(children.where("false"), ["samples"]).first().samples == 0
    cases = spark.createDataFrame([(True, True, False)], "parse_ok boolean, tool_name_ok boolean, arguments_exact_match boolean")
    assert tuple(R.tool_name_metrics(cases.where("false")).first()) == (0, 0.0, 0.0, 0.0) and tuple(R.tool_name_metrics(cases).first()) == (1, 1.0, 1.0, 0.0)
    steps = spark.createDataFrame([(1, 2.0, 4, 10, 12), (2, 1.0, 4, 12, 15)], "step int, loss double, examples int, started int, ended int")
    assert tuple(R.training_report(steps).first()) == (2, 1.0, 1.5, 8, 5)


def test_audit_over_no_runs(spark):
    kinds = "status string, passed boolean, " + ", ".join(f"{c} long" for c in S.SUMS) + ", " + ", ".join(f"saw_{c} boolean" for c in S.FLAGS) + ", mean_validation_attempts_per_issue double, mean_revision_attempts_per_issue double"
    row = S.behavior_audit(spark.createDataFrame([], kinds)).first()
    assert row.run_count == 0 and row.validation_issue_count == 0 and row.mean_revision_attempts_per_issue == 0 and len(row) == 3 + len(S.SUMS) + len(S.FLAGS) + 2


def test_running_ends_are_linear(spark):
    import time

    from tracemill.functions.arrays import running_ends, spans_of

    rows = [([1, 2, None, 3],), ([],), (None,)]
    got = spark.createDataFrame(rows, "n array<int>").withColumn("e", running_ends(F.col("n"))).select("e", spans_of(F.col("e")).alias("s")).collect()
    assert [r.e for r in got] == [[0, 1, 3, 3, 6], [0], None] and [(x.start, x.end) for x in got[0].s] == [(0, 1), (1, 3), (3, 3), (3, 6)] and got[1].s == [] and got[2].s is None
    took = []
    for n in (40_000, 160_000):
        wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 9).alias("n")).withColumn("e", running_ends(F.col("n")))
        began = time.time()
        assert wide.select(F.element_at("e", -1).alias("x")).first().x == sum(i % 9 for i in range(1, n + 1))
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5


@pytest.mark.parametrize("limits", [{}, {"max_keys": 0}])
def test_overlaps_store_no_tokens_that_one_side_lacks(spark, limits):
    i = F.col("i")
    left = spark.range(3000).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select("a", F.when(i < 2, F.concat(F.lit("w"), i)).otherwise(F.concat_ws("x", "a", i)).alias("token"))
    right = spark.createDataFrame([(1, "w0"), (1, "w1"), (2, "w1")], "b int, token string")
    shared_dir(spark)
    folder = pathlib.Path(re.sub("^file:/*", "/", spark.sparkContext.getCheckpointDir()))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = stored()
    found = J.overlaps_of_least(left, right, "a", "b", "token", 2, **limits)
    assert {(r.a, r.b, r.common) for r in found.collect()} == {(a, 1, 2) for a in range(3000)}
    assert stored() - before < 2_000_000


@pytest.mark.parametrize("limit", [0, 1000])
def test_multisets_meet_alike_by_broadcast_and_shuffle(spark, limit):
    left = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (2, ""), (3, "z"), (None, "x")], "a int, token string")
    right = spark.createDataFrame([(7, "x"), (7, "x"), (7, "x"), (7, ""), (8, "y"), (None, "x"), (9, None)], "b int, token string")
    got = sorted(map(str, map(tuple, J.multiset_overlap(left, right, "a", "b", "token", limit).collect())))
    assert got == sorted(map(str, [(1, 7, 2), (1, None, 1), (2, 7, 1), (2, 8, 1), (None, 7, 1), (None, None, 1)]))


def test_multisets_are_shuffled_once_as_numbers(spark):
    """Words of the left side that the right side lacks were shuffled too, as text, and the pairs after them."""
    i = F.col("i")
    left = spark.range(2000).select((F.col("id") % 2000).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).select("a", F.when(i < 2, F.concat(F.lit("w"), i)).otherwise(F.concat_ws("x", "a", i)).alias("token"))
    right = spark.createDataFrame([(b, f"w{b % 2}") for b in range(30)], "b int, token string")
    found = J.multiset_overlap(left, right, "a", "b", "token")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", found._jdf.queryExecution().executedPlan().toString())
    assert len(dealt) == 1 and re.fullmatch(r"a#\d+L, \d+", dealt[0])
    assert found.count() == 2000 * 30 and found.where("common <> 1").count() == 0
