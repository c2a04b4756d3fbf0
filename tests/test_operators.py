"""Edge cases of the operators on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions.numbering import global_row_number
from tracemill.operators import contracts, filters, joins, metrics, ordered, rl, rules, text, tokens
from tracemill.operators import messages as M
from tracemill.sources import records


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_next_fit_emits_oversized_rows_before_the_open_pack(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([4, 4, 20, 2, 10])], "shard string, id long, n long")
    got = rows(tokens.next_fit(df, "shard", "id", "n", 10), "id")
    assert got == [("s", 0, 4, False, 0, 0, 1), ("s", 1, 4, False, 0, 4, 1), ("s", 2, 10, True, None, 0, 0), ("s", 3, 2, False, 0, 8, 1), ("s", 4, 10, False, 1, 0, 2)]


def test_next_fit_of_nothing(spark):
    assert rows(tokens.next_fit(spark.createDataFrame([], "shard string, id long, n long"), "shard", "id", "n", 10)) == []


def test_differencing_is_balanced_and_complete(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([8, 7, 6, 5, 4])], "shard string, id long, n long")
    sums = dict(rows(tokens.differencing(df, "shard", "id", "n", 2).groupBy("bin").agg(F.sum("n"))))
    assert sorted(sums.values()) == [14, 16]
    with pytest.raises(Exception, match="2 rows for 3 bins"):
        tokens.differencing(df.limit(2), "shard", "id", "n", 3).collect()


def test_least_loaded_prefers_the_lowest_bin(spark):
    df = spark.createDataFrame([("s", i, 5) for i in range(4)], "shard string, id long, n long")
    assert [r[3] for r in rows(tokens.least_loaded(df, "shard", "id", "n", 2), "id")] == [0, 1, 0, 1]


def test_chunks_open_when_the_size_is_reached(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 3, 20, 1])], "shard string, id long, n long")
    assert [r[3] for r in rows(tokens.size_chunks(df, "shard", "id", "n", 10), "id")] == [0, 1, 1, 2, 3]


def test_token_that_straddles_a_span_is_trained(spark):
    t = tokens.chunk_tokens(spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, None)], "k long, text string"))
    spans = spark.createDataFrame([(1, 3, 5, True), (1, 5, 8, False)], "k long, start long, end long, trainable boolean")
    got = rows(tokens.token_mask(t, spans, "k").select("k", "start", "trained", (F.col("label") == -100)), "k", "start")
    assert got == [(1, 0, 1, False), (1, 4, 1, False)]


def test_labels_and_padding_and_unpacking(spark):
    df = spark.createDataFrame([(1, [5, 6], [0, 1]), (1, [7], [1])], "b int, ids array<int>, m array<int>")
    assert [r[0] for r in df.select(tokens.labels(F.col("ids"), F.col("m"))).collect()] == [[-100, 6], [7]]
    assert sorted(r[0] for r in tokens.right_pad(df, "b", {"ids": 0}).select("ids").collect()) == [[5, 6], [7, 0]]
    packs = spark.createDataFrame([([1, 2, 3], [(0, 2), (2, 3)])], "ids array<int>, spans array<struct<start:int,end:int>>")
    assert [r[0] for r in tokens.unpack(packs, "ids", "spans").orderBy("member").select("part").collect()] == [[1, 2], [3]]


def test_missing_verdict_counts_as_not_passed(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, passed boolean")
    assert {r.id for r in df.where(filters.RunFilter(verifier_passed=False).condition()).collect()} == {"b", "c"}
    assert {r.id for r in df.where(filters.RunFilter(verifier_passed=True).condition()).collect()} == {"a"}


def test_single_rows_have_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 1.0)], "g string, v double")
    assert [(r.g, r.kept) for r in filters.varied_groups(df, "g", "v").orderBy("g").collect()] == [("a", False), ("b", False), ("c", True)]


def test_head_and_tail_and_trim(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "rn")
    assert [r.rn for r in filters.head_and_tail(df, "rn", 10, 5).orderBy("rn").collect()] == [1, 2, 8, 9, 10]
    assert filters.head_and_tail(df, "rn", 10, 0).count() == 10
    assert filters.trim_to_multiple(df, "rn", 10, 4).count() == 8
    with pytest.raises(ValueError):
        filters.trim_to_multiple(df, "rn", 3, 4)


def test_summary_of_nothing_is_zero(spark):
    assert rows(metrics.summary(spark.createDataFrame([], "v double"), "v")) == [(0.0, 0.0, 0.0, 0.0, 0)]


def test_pass_at_k(spark):
    df = spark.createDataFrame([(4, 0), (4, 1), (4, 4)], "n int, c int")
    assert [r[0] for r in df.select(F.round(metrics.pass_at_k(df, "n", "c", 2), 9)).collect()] == [0.0, 0.5, 1.0]


def test_empty_mask_raises(spark):
    df = spark.createDataFrame([(1.0, 0)], "v double, m int")
    with pytest.raises(Exception, match="mask is empty"):
        metrics.whiten(df, "v", "m").collect()


def test_failure_does_not_precede_itself(spark):
    df = spark.createDataFrame([("r", 1, "fail"), ("r", 2, "revise"), ("r", 3, "pass")], "k string, t int, e string")
    flags = ordered.recovery_flags(df, "k", "t", F.col("e") == "fail", F.col("e").isin("revise", "fail"), F.col("e") == "pass")
    assert [(r.revised_after, r.passed_after) for r in flags.orderBy("t").collect()] == [(False, False), (True, False), (False, True)]


def test_intervals_that_touch_are_joined(spark):
    df = spark.createDataFrame([("k", 0, 2), ("k", 2, 3), ("k", 5, 9), ("k", 6, 7)], "k string, s long, e long")
    merged = ordered.merged_intervals(df, "k", "s", "e")
    assert rows(merged.select("start", "end", "n"), "start") == [(0, 3, 2), (5, 9, 2)]
    assert rows(ordered.gaps(merged, "k")) == [("k", 3, 5)]


def test_tail_window_passes_over_large_rows(spark):
    df = spark.createDataFrame([("c", 0, "system", 1), ("c", 1, "assistant", 2), ("c", 2, "assistant", 50), ("c", 3, "assistant", 3)], "c string, t int, role string, n int")
    assert [r.t for r in ordered.tail_window(df, "c", "t", "role", "n", 4, 10).orderBy("t").collect()] == [0, 1, 3]


def test_compaction_stops_when_the_budget_holds(spark):
    df = spark.createDataFrame([("c", 0, "user", 1)] + [("c", i, "assistant", 5) for i in range(1, 5)], "c string, t int, role string, n int")
    got = rows(ordered.compacted_turns(df, "c", "t", "role", "n", 10, 13, 2).select("t", "n", "is_summary"), "t")
    assert got == [(0, 1, False), (1, 2, True), (3, 5, False), (4, 5, False)]


def test_open_spans_end_at_the_next_start(spark):
    events = [("t", "a", "span_start", 0, None), ("t", "b", "span_start", 3, "a"), ("t", "b", "span_end", 5, "a"), ("t", "c", "span_end", 9, None)]
    df = spark.createDataFrame(events, "trace_id string, span_id string, type string, ts long, parent_span_id string")
    got = {r.span_id: (r.kind, r.start, r.end) for r in ordered.paired_spans(df).collect()}
    assert got == {"a": ("open", 0, 3), "b": ("closed", 3, 5), "c": ("orphan", None, 9)}


def test_unit_normalisation(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 7.0), ("b", 0.0), ("b", 0.0), ("c", 1.0), ("c", 1.0)], "g string, v double")
    got = sorted((r.g, round(r.normalized, 3)) for r in ordered.unit_normalized(df, "g", "v").collect())
    assert got == [("a", -1.0), ("a", 1.0), ("a", 7.0), ("b", 0.0), ("b", 0.0), ("c", 0.0), ("c", 0.0)]


def test_last_and_first_win(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k int, o int, v string")
    assert rows(joins.last_wins(left, right, ["k"], "o", ["v"]), "k") == [(1, "y"), (2, None)]
    assert rows(joins.first_match(left, right, ["k"], "o", ["v"]), "k") == [(1, "x"), (2, None)]


def test_null_equals_null(spark):
    df = spark.createDataFrame([(None, None, 1, 2)], "a int, b int, c int, d int")
    assert df.select(joins.equal_columns([("a", "b"), ("c", "d")])).first()[0] == 1


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": ["string", "null"]}}, "additionalProperties": False}
    assert text.schema_fault({"a": 1, "b": None}, schema) is None
    assert text.schema_fault({"a": True}, schema) == "$.a"
    assert text.schema_fault({}, schema) == "$.a"
    assert text.schema_fault({"a": 1, "c": 1}, schema) == "$.c"


def test_tool_call_block(spark):
    texts = ["none", "<|tool|>{", "<|tool|>{<|end|>", "<|tool|>[1]<|end|>", '<|tool|>{"arguments":{}}<|end|>', '<|tool|>{"name":"x"}<|end|>', '<|tool|>{"name":"x","arguments":[1]}<|end|>', '<|tool|>{"name":"x","arguments":{"a":1}}<|end|>', '<|tool|>{"name":"x","input_text":"p"}<|end|>']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0].error for r in df.orderBy("i").select(text.tool_call_block(F.col("t"))).collect()]
    assert got == ["no_block", "not_closed", "invalid_json", "not_an_object", "missing_name", "missing_payload", "arguments_not_an_object", None, None]


def test_answers(spark):
    df = spark.createDataFrame([(r"\boxed{a{b}c} \boxed{1{2}}", "x\nAnswer: 7 \n"), ("none", "none"), (None, None)], "b string, a string")
    assert [r[0] for r in df.select(text.boxed_answer("b")).collect()] == ["1{2}", None, None]
    assert [r[0] for r in df.select(text.final_answer(F.col("a"))).collect()] == ["7", "[INVALID]", "[INVALID]"]


def test_f1_guard(spark):
    df = spark.createDataFrame([("yes", "yes it is"), ("a b b", "b b c"), (None, "x")], "p string, t string")
    assert [round(r[0].f1, 6) for r in df.select(text.token_f1(F.col("p"), F.col("t"))).collect()] == [0.0, 0.666667, 0.0]


def test_returns_and_advantages(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [0.0, 0.0, 0.0])], "r array<double>, v array<double>")
    assert df.select(rl.discounted_returns(F.col("r"), 0.5)).first()[0] == [1.75, 1.5, 1.0]
    assert [x.advantage for x in df.select(rl.gae(F.col("r"), F.col("v"), 0.5, 1.0)).first()[0]] == [1.75, 1.5, 1.0]


def test_overlap_is_against_the_furthest_end(spark):
    df = spark.createDataFrame([("k", 0, 10), ("k", 2, 3), ("k", 5, 12)], "k string, s long, e long").withColumn("len", F.lit(11))
    assert rows(rules.checked_spans(df, "k", "s", "e", "len"), "s", "code") == [("k", 2, 3, "overlap"), ("k", 5, 12, "beyond_text"), ("k", 5, 12, "overlap")]


def test_segments_skip_empty_assistants(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", ""), (1, 2, "assistant", None), (1, 3, "tool", "out")], "conv_id long, turn int, role string, text string")
    assert [r.segment for r in M.segments(df).orderBy("turn").collect()] == ["<user>\nhi\n</user>\n", '<tool_result name="tool">\nout\n</tool_result>\n']


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\nbroken\n{"a": 3}\n')
    assert [r.a for r in records.read_records(spark, str(path), "a long").orderBy("a").collect()] == [1, 2, 3]
    assert [r.a for r in records.read_slice(spark, f"{path}@[1:2]", "a long", "a").collect()] == [2]
    with pytest.raises(ValueError):
        records.read_slice(spark, f"{path}@[-1:]", "a long", "a")
    with pytest.raises(ValueError):
        records.read_records(spark, "x.csv", "a long")
    with pytest.raises(Exception, match="malformed line 4"):
        records.read_strict(spark, str(path), "a long").collect()


def test_lines_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join('{"a": %d}\n' % i if i != 777 else "broken\n" for i in range(1, 1201)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        with pytest.raises(Exception, match="malformed line 777 "):
            records.read_strict(spark, str(path), "a long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_canonical_lines_and_bundles(spark, tmp_path):
    out = str(tmp_path / "out")
    records.write_canonical(spark.createDataFrame([(2, None)], "b int, a string"), out)
    assert [json.loads(r.value) for r in spark.read.text(out).collect()] == [{"a": None, "b": 2}]
    expected = spark.createDataFrame([("x", 1, "h"), ("y", 1, "h"), ("../z", 1, "h")], "name string, size long, digest string")
    found = spark.createDataFrame([("x", 1, "g"), ("w", 1, "h")], "name string, size long, digest string")
    assert dict(rows(records.bundle_faults(expected, found))) == {"x": "changed", "y": "missing", "../z": "unsafe_name", "w": "unexpected"}


def test_epochs_are_permutations(spark):
    prompts = spark.range(5).withColumnRenamed("id", "p")
    got = records.epoch_slice(prompts, "p", 3, 9, seed=1, copies=2)
    assert got.count() == 18 and sorted(r.group for r in got.where("copy = 0").collect()) == list(range(3, 12))
    whole = records.epoch_slice(prompts, "p", 0, 10, seed=1).orderBy("group").collect()
    assert sorted(r.p for r in whole[:5]) == sorted(r.p for r in whole[5:]) == list(range(5))
    assert [r.p for r in whole[3:]] == [r.p for r in got.where("copy = 0 and group < 10").orderBy("group").collect()]


def test_runs_and_artifacts(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "trajectory.json").write_text("{}")
    (tmp_path / "runs" / "r2").mkdir(parents=True)
    (tmp_path / "runs" / "r2" / "trajectory.json").write_text("{}")
    assert [r.run for r in records.discover_runs(spark, str(tmp_path)).collect()] == ["r1"]
    assert records.artifacts(spark, str(tmp_path)).count() == 2


# ---- contracts


SAMPLE = "sample_id string, sample_type string, source_type string, split string, task_id string, tool_profile_id string, text string, segments array<struct<kind:string,text:string,trainable:boolean>>, spans array<struct<start:long,end:long,trainable:boolean>>, character_mask array<int>, trainable_char_count long, reward double, status string, verifier_passed boolean, verifier_score double"


def test_sample_invariants(spark):
    good = {
        "sample_id": "s", "sample_type": "t", "source_type": "u", "split": "train", "task_id": "k", "tool_profile_id": "p", "text": "abcd", "segments": [("user", "ab", False), ("assistant_tool_call", "cd", True)],
        "spans": [(0, 2, False), (2, 4, True)], "character_mask": [0, 0, 1, 1], "trainable_char_count": 2, "reward": None, "status": None, "verifier_passed": None, "verifier_score": None,
    }
    changes = [({}, []), ({"character_mask": [1, 1, 0, 0]}, ["mask_segments"]), ({"split": None}, ["blank_split"]), ({"reward": 1.0}, ["outcome"]), ({"text": "abce"}, ["text_segments"]), ({"spans": [(0, 2, False)]}, ["span_count", "span_bounds"]), ({"segments": [("", "ab", False), ("assistant_tool_call", "cd", True)]}, ["segment_kind"])]
    df = spark.createDataFrame([tuple((good | c).values()) for c, _ in changes], SAMPLE)
    assert [r[0] for r in df.select(contracts.sample_faults()).collect()] == [f for _, f in changes]


def test_an_empty_bundle_is_an_issue(spark):
    none = spark.createDataFrame([], "index long, sample_id string, task_id string, tool_profile_id string, source_type string")
    packed = spark.createDataFrame([], "sequence long, source_spans array<int>, unpacked int")
    assert [r.code for r in contracts.bundle_issues(none, none, packed).collect()] == ["prepared_empty_bundle"]


def test_histories(spark):
    rows = [("r", 1, ["a"], ["a"], ["a"], False), ("r", 2, ["s"], ["a", "b"], ["b"], True), ("r", 3, ["s", "c"], ["s", "c"], ["c"], False), ("r", 4, ["x"], ["s"], ["d"], False)]
    df = spark.createDataFrame(rows, "run_id string, turn_index int, selected array<string>, before array<string>, new_sources array<string>, compacted boolean")
    got = [(r.kind, r.prefix_ok, r.suffix_ok) for r in contracts.history_transitions(df).orderBy("turn_index").collect()]
    assert got == [("initial_snapshot", True, True), ("replacement_compaction", True, True), ("append_only", True, True), ("append_only", False, False)]


def test_lengths_and_skips(spark):
    df = spark.createDataFrame([("abc", 3), ("abcdef", 6)], "p string, n int")
    assert contracts.within_length(df, "p", F.col("n"), 4).count() == 1 and contracts.within_length(df, "p", F.col("n"), None).count() == 2
    assert contracts.within_length(df.select(F.array("p").alias("p"), "n"), "p", F.col("n"), 4).count() == 2
    got = spark.range(1).select(contracts.skip_reason(F.lit(None).cast("boolean"), F.lit(1), F.lit(True), F.lit(True)).alias("a"), contracts.skip_reason(F.lit(True), F.lit(1), F.lit(True), F.lit(True)).alias("b")).first()
    assert tuple(got) == ("not_extracted", None)


def test_spans_in_a_ring_have_no_depth(spark):
    events = [("t", "a", "b", "span_start", 1), ("t", "b", "a", "span_start", 2), ("t", "c", None, "span_start", 3), ("t", "d", "c", "span_start", 4), ("t", "e", "d", "span_start", 5), ("t", "c", None, "span_end", 9), ("t", "f", "e", "span_end", 30)]
    df = spark.createDataFrame(events, "trace_id string, span_id string, parent_span_id string, type string, ts long")
    got = {r.span_id: (r.kind, r.depth, r.end, r.clipped_by) for r in ordered.span_tree(df).collect()}
    assert got == {"a": ("open", 0, 30, "row_end"), "b": ("open", 0, 30, "row_end"), "c": ("closed", 0, 9, None), "d": ("open", 1, 9, "ancestor_end"), "e": ("open", 2, 9, "ancestor_end"), "f": ("orphan", 2, 30, None)}


def test_terminal_runs_and_trajectories_raise(spark, tmp_path):
    files = spark.createDataFrame([("runs/1/t.json",)], "path string")
    ended = lambda path: spark.createDataFrame([(1, "trajectory_recorded", path), (2, "aborted", "../x")], "run int, outcome string, path string")
    assert rows(records.terminal_runs(ended("runs/1/t.json"), files)) == [(1, "runs/1/t.json")]
    for path, fault in (("../t.json", "leaves the root"), ("runs/2/t.json", "no such file"), (None, "no path")):
        with pytest.raises(Exception, match=fault):
            records.terminal_runs(ended(path), files).collect()
    (tmp_path / "a.json").write_text('{"x":\n 1}')
    assert [r.x for r in records.load_trajectories(spark, str(tmp_path), "x long").collect()] == [1]
    (tmp_path / "b.json").write_text('{"x": ')
    with pytest.raises(Exception):  # noqa: B017
        records.load_trajectories(spark, str(tmp_path), "x long").collect()


def test_calls_are_escaped(spark):
    df = spark.range(1).select(M.call_text(F.lit('a"b'), F.lit("é\n"), F.create_map(F.lit("z"), F.lit("1"), F.lit("b"), F.lit('"x"'))).alias("c"), M.call_text(F.lit("i"), F.lit("n"), F.lit(None).cast("map<string,string>")).alias("d"))
    assert tuple(df.first()) == ('<|tool|>\n{"arguments": {"b": "x", "z": 1}, "id": "a\\"b", "name": "é\\n"}\n<|end|>\n', '<|tool|>\n{"arguments": {}, "id": "i", "name": "n"}\n<|end|>\n')


def test_numbers_follow_any_order(spark):
    df = spark.createDataFrame([("b", 2), (None, 1), ("a", 5), ("b", 1)] + [("z", i) for i in range(50)], "k string, v int")
    got = [(r.k, r.v) for r in global_row_number(df, ["k", "v"], partitions=3).orderBy("rn").collect()]
    assert got == [(None, 1), ("a", 5), ("b", 1), ("b", 2)] + [("z", i) for i in range(50)]
    assert global_row_number(df.where("false"), ["k"]).count() == 0


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 7.0), ("b", None)], "g string, v double")
    got = metrics.quantiles(df, "v", {"p50": 0.5, "p95": 0.95}, "g").withColumn("p95", F.round("p95", 9))
    assert rows(got, "g") == [("a", 10, 5.5, 9.55), ("b", 1, 7.0, 7.0)]
    assert rows(metrics.quantiles(df, "v", {"p50": 0.5})) == [(11, 6.0)]


def test_overlapping_marks_cover_tokens(spark):
    cut = spark.createDataFrame([("k", 4 * i, 4 * i + 4, i) for i in range(6)], "key string, start int, end int, token_id long")
    spans = spark.createDataFrame([("k", 1, 14, True), ("k", 2, 3, True), ("k", 15, 17, False), ("k", 23, 24, True)], "key string, start long, end long, trainable boolean")
    assert [r.trained for r in tokens.token_mask(cut, spans, "key").orderBy("start").collect()] == [1, 1, 1, 1, 0, 1]


def test_span_rounds_grow_with_the_largest_trace(spark, monkeypatch):
    rounds, kept = [], ordered.checkpointed
    monkeypatch.setattr(ordered, "checkpointed", lambda df: rounds.append(1) or kept(df))
    rows = [(t, s, 3 - s, "span_start", s) for t in range(300) for s in (1, 2)] + [(t, s, 0 if s == 3 else 3, "span_start", s) for t in range(300) for s in (3, 4)]
    df = spark.createDataFrame(rows, "trace_id int, span_id int, parent_span_id int, type string, ts long")
    assert {(r.span_id, r.depth) for r in ordered.span_tree(df).collect()} == {(1, 0), (2, 0), (3, 0), (4, 1)}
    assert len(rounds) <= 6  # 300 rings of two: by the number of all spans there would be thirteen


def test_trees_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 20 as run", "id", "case when id > 20 then 'é' end as note")
    records.write_tree(rows, f"file://{tmp_path}", ["run"])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"run={i}" for i in range(20))
    assert sorted((tmp_path / "run=1" / "part-00000.json").read_text(encoding="utf-8").splitlines()) == ['{"id":1}', '{"id":21,"note":"é"}']
    assert len({r.run for r in spark.read.json(str(tmp_path)).collect()}) == 20
