"""Argument paths, schemas of a row's own, and scores of predictions against plain Python and by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import toolcalls as T


def one(spark, column, schema, *rows):
    return [r.x for r in spark.createDataFrame(list(rows), schema).select(column.alias("x")).collect()]


def test_leaves_and_values(spark):
    got = one(spark, T.leaf_paths(F.col("t")), "t string", ('{"a":{"b":1,"c":{}},"l":[{"x":1}],"n":null}',), ("[1]",), ("{",), (None,), ("{}",))
    assert [None if g is None else [(r.path, r.value) for r in g] for g in got] == [[("a.b", "1"), ("l", '[{"x":1}]'), ("n", "null")], None, None, None, []]
    rows = [('{"a":{"b":[1]}}', "a.b"), ('{"a":{"b":1}}', "a.b.c"), ('{"a":null}', "a"), ("[1]", "a"), (None, "a"), ("x", "a")]
    assert one(spark, T.path_value(F.col("t"), F.col("p")), "t string, p string", *rows) == ["[1]", None, None, None, None, None]


def test_leaves_of_random_objects_make_them_again(spark):
    rng = random.Random(3)

    def made(depth):
        return {f"k{rng.randrange(6)}": made(depth - 1) if depth and rng.random() < 0.5 else rng.choice([1, "ü", [1, {"q": None}], None, True, 2.5]) for _ in range(rng.randint(1, 4))}

    objects = {i: made(3) for i in range(60)}
    df = spark.createDataFrame([(i, json.dumps(o)) for i, o in objects.items()], "id int, o string")
    leaves = df.select("id", F.explode(T.leaf_paths(F.col("o"))).alias("x")).select("id", "x.path", "x.value")
    assert {r.id: json.loads(r.object) for r in T.assembled(leaves, ["id"]).collect()} == objects


def call(spark, arguments, mapping=None, defaults=None, before=None, after=None, expected=None):
    texts = [json.dumps({"arguments": arguments}), *(None if x is None else json.dumps(x) for x in (mapping, defaults, before, after, expected))]
    return one(spark, T.canonical_arguments(*(F.col(c) for c in "abcdef")), ", ".join(f"{c} string" for c in "abcdef"), tuple(texts))[0]


def test_mapping_by_hand(spark):
    assert tuple(call(spark, {"r": {"b": 1, "e": None}}, {"r.b": "start", "r.e": "stop"}, {"n.x": 2}, expected={"start": 1, "n": {"x": 2}})) == ('{"n":{"x":2},"start":1}', None, True)
    assert call(spark, {"r": 1, "z": 2, "y": 3}, {"r": "a"}).fault == "unmapped: y,z"
    assert call(spark, {"r": 1}, {"r": "a"}, {"a": 5}).arguments == '{"a":1}'
    assert call(spark, {"r": 1, "s": 2}, {"r": "a", "s": "a.b"}).fault == "path through a value: a.b"
    assert call(spark, {"r": 1}, None, None, {"type": "object", "properties": {"r": {"type": "string"}}}).fault == "exposed $.r"
    assert call(spark, {"r": 1}, {"r": "a"}, None, None, {"type": "object", "required": ["b"]}).fault == "canonical $.b"
    assert call(spark, [1]).fault == "no object"
    assert call(spark, {"r": 1}, expected={"r": 2}).equal is False
    back = one(spark, T.exposed_arguments(F.col("a"), F.col("m"), F.lit(None).cast("string"), F.lit(None).cast("string")), "a string, m string", ('{"a":1}', '{"x":"a","y":"a"}'), ('{"a":{"b":1}}', '{"p.q":"a.b"}'), ('{"c":1}', '{"p":"a"}'), (None, None))
    assert [(b.arguments, b.fault) for b in back] == [(None, "ambiguous: a"), ('{"p":{"q":1}}', None), (None, "unmapped: c"), ("{}", None)]


@pytest.mark.parametrize(
    ("schema", "value", "fault"),
    [
        ({"type": ["integer", "null"]}, None, None), ({"type": ["integer", "null"]}, "x", "$"), ({"type": "number"}, True, "$"), ({"type": "integer"}, 1.0, "$"), ({"enum": [1]}, 2, None), ({"type": "string", "enum": ["a"]}, "b", "$"),
        ({"type": "array", "items": {"type": "object", "required": ["k"]}}, [{"k": 1}, {}], "$[1].k"), ({"type": "object", "additionalProperties": False, "properties": {"a": {}}}, {"a": 1, "b": 2}, "$.b"), ({"type": "date"}, 3, None), ({"type": "array"}, {}, "$"),
    ],
)
def test_schemas(schema, value, fault):
    assert T._compiled(json.dumps(schema))(value, "$") == fault


def test_calls_that_cannot_be_read(spark):
    texts = [None, "", "x", "<|tool|>", "<|tool|>{<|end|>", "<|tool|>3<|end|>", '<|tool|>{"name":3}<|end|>', '<|tool|>{"name":" "}<|end|>', '<|tool|>{"name":"a"}<|end|>', '<|tool|>{"name":"a","arguments":[1]}<|end|>', '<|tool|>{"name":"a","arguments":[1],"input_text":"t"}<|end|>', 'so <|tool|>\n{"name":"a","arguments":{}}\n<|end|> and <|tool|>{<|end|>']
    got = one(spark, T.parsed_call(F.col("t")), "t string", *((t,) for t in texts))
    assert [g.error for g in got] == ["missing_tool_call_block"] * 3 + ["missing_end_marker", "invalid_json", "invalid_payload_type", "invalid_payload_name", "invalid_payload_name", "invalid_payload_arguments", "invalid_payload_arguments", None, None]
    assert [g.has_object for g in got[-2:]] == [False, True] and got[-1].name == "a"


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_scores_of_odd_rows(spark, monkeypatch, max_bytes):
    """Nulls, a profile without tools, repeated tools and columns of result names; broadcast or not."""
    from tracemill.functions import joining

    monkeypatch.setattr(T, "join_measured", lambda left, right, keys, how: joining.join_measured(left, right, keys, how, max_bytes))
    tools = spark.createDataFrame([(1, 1, "f", "other", "function", None, None, None, None), (1, 0, "f", "c", "function", None, None, None, None)], "profile_id long, position int, exposed_name string, canonical_name string, kind string, input_schema string, canonical_schema string, mapping string, defaults string")
    good = '<|tool|>{"name":"f","arguments":{"a":1}}<|end|>'
    rows = [(1, good, good, "f", "c", '{"a":1}', False, "k"), (2, good, good, "f", "c", '{"a":1}', False, "k"), (None, good, None, None, None, None, None, None), (1, None, None, None, None, None, None, None), (1, good, None, None, None, None, None, None)]
    samples = spark.createDataFrame(rows, "profile_id long, predicted_text string, target_text string, expected_name string, expected_canonical_name string, expected_arguments string, expected_freeform boolean, error_code string")
    got = T.score_predictions(samples, tools)
    assert sorted((r.error_code or "", r.parse_ok, r.exact_match) for r in got.collect()) == [("", True, True), ("canonical_intent_mismatch", True, False), ("missing_tool_call_block", False, False), ("unknown_tool_name", True, False), ("unknown_tool_name", True, False)]
    assert T.score_predictions(samples.where("false"), tools).count() == 0
    metrics = {r.split: r for r in T.prediction_metrics(got.withColumn("s", F.lit("a")), "s").collect()}
    assert metrics.keys() == {"a", "overall"} and metrics["overall"].error_counts == {"canonical_intent_mismatch": 1, "missing_tool_call_block": 1, "unknown_tool_name": 2} and metrics["a"].parse_rate == 0.8
    assert T.completion_rewards(samples.withColumn("tool_specs", F.lit(None).cast("string"))).where("reward < 0.2").count() == 3
