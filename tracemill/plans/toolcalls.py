"""Nested argument paths, tool-call predictions and their scores, over whole tables with planted forms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import contexts as C
from ..operators import toolcalls as T
from .registry import query, table


def _props(spark, sf_dir) -> DataFrame:
    """Events with their properties wrapped one to three levels deep, with a list, a null and an empty object beside them."""
    depth = F.col("event_id") % 3
    wrapped = F.when(depth == 0, F.col("props")).when(depth == 1, F.format_string('{"a":%s,"l":[1,{"z":2}]}', "props")).otherwise(F.format_string('{"a":{"b":%s,"e":{}},"n":null}', "props"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", depth.alias("depth"), wrapped.alias("object"))


@query("""select event_id, path, value from (select event_id, unnest(case event_id % 3 when 0 then [{'path': 'k', 'value': k}] when 1 then [{'path': 'a.k', 'value': k}, {'path': 'l', 'value': '[1,{"z":2}]'}] else [{'path': 'a.b.k', 'value': k}, {'path': 'n', 'value': 'null'}] end, recursive := true) from (select event_id, json_extract_string(props, '$.k') as k from events))""")
def op_x06_leaves(spark, sf_dir):
    rows = _props(spark, sf_dir).select("event_id", F.explode(T.leaf_paths(F.col("object"))).alias("x"))
    return rows.select("event_id", "x.path", "x.value")


@query("""select event_id, json_extract_string(props, '$.k') as deep, case event_id % 3 when 1 then '[1,{"z":2}]' end as list, case event_id % 3 when 0 then null when 1 then '{"k":' || json_extract_string(props, '$.k') || '}' else '{"b":{"k":' || json_extract_string(props, '$.k') || '},"e":{}}' end as inner_object from events""")
def op_x06_get(spark, sf_dir):
    rows = _props(spark, sf_dir)
    path = F.when(F.col("depth") == 0, "k").when(F.col("depth") == 1, "a.k").otherwise("a.b.k")
    at = lambda p: T.path_value(F.col("object"), p)
    return rows.select("event_id", at(path).alias("deep"), at(F.lit("l")).alias("list"), at(F.lit("a")).alias("inner_object"))


@query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || ',"made":{"by":{"user":' || user_id || '},"kind":"' || event_type || '"}}' as object, cast(null as varchar) as fault from events where event_id % 7 <> 0 union all select event_id, null, 'path through a value: k.x' from events where event_id % 7 = 0""")
def op_x06_assembled(spark, sf_dir):
    """Objects put together again from rows of paths; every seventh event also sets a path through a number."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "user_id", "event_type")
    leaf = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    leaves = F.array(leaf("k", F.col("k")), leaf("made.by.user", F.col("user_id").cast("string")), leaf("made.kind", F.concat(F.lit('"'), "event_type", F.lit('"'))), F.when(F.col("event_id") % 7 == 0, leaf("k.x", F.lit("1"))))
    rows = e.select("event_id", F.explode(F.array_compact(leaves)).alias("x")).select("event_id", "x.path", "x.value")
    return T.assembled(rows, ["event_id"])


_MAPPINGS = {"plain": None, "moved": {"a.k": "key", "l": "deep.list"}, "lost": {"a.k": "key"}, "twice": {"a.k": "key", "l": "key"}}


@query("""with e as (select event_id, event_type, json_extract_string(props, '$.k') as k, event_id % 4 as m from events)
select event_id, case m when 0 then '{"a":{"k":' || k || '},"l":[2,"' || event_type || '"],"more":1}' when 1 then '{"deep":{"list":[2,"' || event_type || '"]},"key":' || k || ',"more":1}' when 3 then '{"key":[2,"' || event_type || '"],"more":1}' end as canonical, case m when 2 then 'unmapped: l' end as fault, case m when 0 then '{"a":{"k":' || k || '},"l":[2,"' || event_type || '"],"more":1}' when 1 then '{"a":{"k":' || k || '},"l":[2,"' || event_type || '"]}' end as back, case m when 2 then null when 3 then 'ambiguous: key' end as back_fault from e""")
def op_x06_mapped(spark, sf_dir):
    """Arguments moved to canonical paths, with a default, and back; each row has its own mapping. One mapping lacks a leaf, one leads two paths to one."""
    name = F.element_at(F.array(*(F.lit(n) for n in _MAPPINGS)), (F.col("event_id") % 4 + 1).cast("int"))
    texts = F.create_map(*(F.lit(x) for n, m in _MAPPINGS.items() if m for x in (n, json.dumps(m))))
    e = table(spark, sf_dir, "events").select("event_id", F.format_string('{"arguments":{"a":{"k":%s},"l":[2,"%s"]}}', F.get_json_object("props", "$.k"), "event_type").alias("payload"), texts[name].alias("mapping"))
    none = F.lit(None).cast("string")
    there = e.withColumn("c", T.canonical_arguments(F.col("payload"), F.col("mapping"), F.lit('{"more":1}'), none, none, none))
    # The default has no exposed path, so it is left out before the way back.
    kept = F.when(F.col("mapping").isNull(), F.col("c.arguments")).otherwise(F.regexp_replace("c.arguments", ',"more":1', ""))
    back = there.withColumn("b", F.when(F.col("c.arguments").isNotNull(), T.exposed_arguments(kept, F.col("mapping"), none, none)))
    return back.select("event_id", F.col("c.arguments").alias("canonical"), F.col("c.fault").alias("fault"), F.col("b.arguments").alias("back"), F.col("b.fault").alias("back_fault"))


# ---- predictions


def _tools(spark, sf_dir) -> DataFrame:
    """A profile for each supplier: a search tool with its own name, schema and paths, a second view of it under a taken name, and a tool that takes text."""
    s = table(spark, sf_dir, "supplier")
    exposed = F.format_string('{"type":"object","required":["range","unit"],"additionalProperties":false,"properties":{"range":{"type":"object","required":["from"],"properties":{"from":{"type":"integer"},"to":{"type":["integer","null"]}}},"unit":{"type":"integer","enum":[%d,%d]},"who":{"type":"string"},"extra":{}}}', "s_nationkey", F.col("s_nationkey") + 1)
    canonical = '{"type":"object","required":["start","unit","limit"],"properties":{"start":{"type":"number"},"limit":{"type":"integer"}}}'
    mapping = '{"range.from":"start","range.to":"stop","unit":"unit","who":"query.author"}'
    tool = lambda position, name, kind, schema, paths: F.struct(F.lit(position).alias("position"), name.alias("exposed_name"), F.lit("search" if kind == "function" else "note").alias("canonical_name"), F.lit(kind).alias("kind"), schema.alias("input_schema"), F.lit(canonical).alias("canonical_schema"), F.lit(paths).alias("mapping"), F.format_string('{"limit":%d}', F.col("s_suppkey") % 7).alias("defaults"))
    name = F.format_string("find_%d", "s_suppkey")
    rows = F.array(tool(0, name, "function", exposed, mapping), tool(1, name, "freeform", F.lit("{}"), None), tool(2, F.lit("write"), "freeform", F.lit("{}"), None), tool(3, F.lit("scan"), "function", F.lit('{"type":"object"}'), None))
    return s.select(F.col("s_suppkey").alias("profile_id"), F.explode(rows).alias("t")).select("profile_id", "t.*")


def _samples(spark, sf_dir) -> DataFrame:
    """A prediction for every message of conversations; 18 forms of it are dealt out over messages."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "conversations").crossJoin(F.broadcast(n)).withColumn("profile_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("n"))
    c = c.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("profile_id"), "s_nationkey"), "profile_id").withColumn("form", (F.col("conv_id") * 5 + F.col("turn")) % 18)
    form = F.col("form")
    name = F.format_string("find_%d", "profile_id")
    call = lambda name, args: F.concat(F.lit('{"name":"'), name, F.lit('","arguments":'), args, F.lit("}"))
    wrapped = lambda body: F.concat(F.lit("<|tool|>\n"), body, F.lit("\n<|end|>"))
    args = lambda begin, unit, more="": F.format_string('{"range":{"from":%d,"to":null},"unit":%d,"who":"%s"' + more + "}", begin, unit, "role")
    right = args(F.col("turn"), F.col("s_nationkey"))
    good = call(name, right)
    predicted = (
        F.when(form == 1, F.col("role")).when(form == 2, F.concat(F.lit("<|tool|>"), good)).when(form == 3, wrapped(F.lit("{broken"))).when(form == 4, wrapped(F.lit("[1]"))).when(form == 5, wrapped(call(F.lit("  "), right))).when(form == 6, wrapped(call(name, F.lit("7"))))
        .when(form == 7, wrapped(call(F.lit("search"), right))).when(form == 8, wrapped(call(name, args(F.col("turn"), F.col("s_nationkey") + F.col("conv_id") % 4)))).when(form == 9, wrapped(call(name, args(F.col("turn") + 1, F.col("s_nationkey"))))).when(form == 10, F.concat(F.lit("so: "), wrapped(F.replace(good, F.lit(","), F.lit(" ,")))))
        .when(form == 11, wrapped(F.format_string('{"name":"%s","input_text":"x"}', name))).when(form == 12, wrapped(call(name, args(F.col("turn"), F.col("s_nationkey"), ',"extra":1')))).when(form == 13, wrapped(call(F.lit("scan"), F.format_string('{"start":%d,"unit":%d}', "turn", "s_nationkey")))).when(form == 15, wrapped(call(F.lit("write"), F.lit("{}"))))
        .when(form == 16, wrapped(call(name, args(F.col("turn") + 0, F.lit(-1))))).when(form == 17, wrapped(call(name, F.lit('{"range":{"from":"1"},"unit":1}')))).otherwise(wrapped(good))
    )
    expected = F.format_string('{"start":%d,"unit":%d,"query":{"author":"%s"},"limit":%d}', "turn", "s_nationkey", "role", F.col("profile_id") % 7)
    return c.select("conv_id", "turn", "role", "profile_id", "form", predicted.alias("predicted_text"), wrapped(good).alias("target_text"), name.alias("expected_name"), F.lit("search").alias("expected_canonical_name"), expected.alias("expected_arguments"), (form == 14).alias("expected_freeform"), right.alias("given"))


_FORMS = """c as (select conv_id, turn, role, (conv_id * 7 + turn) % (select count(*) from supplier) as profile_id, (conv_id * 5 + turn) % 18 as form from conversations),
s as (select c.*, s_nationkey as nation, 'find_' || profile_id as name from c join supplier on s_suppkey = profile_id),
scored as (select conv_id, turn, role, form, profile_id,
  case form when 1 then 'missing_tool_call_block' when 2 then 'missing_end_marker' when 3 then 'invalid_json' when 4 then 'invalid_payload_type' when 5 then 'invalid_payload_name' when 6 then 'invalid_payload_arguments' when 7 then 'unknown_tool_name'
    when 8 then case when conv_id % 4 = 0 then null when conv_id % 4 = 1 then 'canonical_intent_mismatch' else 'schema_validation_error' end when 9 then 'canonical_intent_mismatch' when 10 then 'exact_text_mismatch' when 11 then 'freeform_not_supported_in_schema_following_eval'
    when 12 then 'schema_validation_error' when 13 then 'canonical_intent_mismatch' when 14 then 'freeform_not_supported_in_schema_following_eval' when 15 then 'schema_validation_error' when 16 then 'schema_validation_error' when 17 then 'schema_validation_error' end as error_code,
  form not in (1, 2, 3, 4, 5, 6, 14) as parse_ok, form not in (1, 2, 3, 4, 5, 6, 7, 13, 14, 15) as tool_name_ok, form = 7 as stale_canonical_name,
  case when form in (1, 2, 3, 4, 5, 6, 14) then null when form = 7 then 'search' when form = 13 then 'scan' when form = 15 then 'write' else name end as predicted_name,
  case when form in (0, 10) or (form = 8 and conv_id % 4 < 2) or form = 9 then '{"limit":' || (profile_id % 7) || ',"query":{"author":"' || role || '"},"start":' || (turn + case when form = 9 then 1 else 0 end) || ',"unit":' || (nation + case when form = 8 then conv_id % 4 else 0 end) || '}' when form = 13 then '{"limit":' || (profile_id % 7) || ',"start":' || turn || ',"unit":' || nation || '}' end as predicted_arguments from s)"""


@query(f"with {_FORMS} select conv_id, turn, predicted_name, predicted_arguments, parse_ok, tool_name_ok, predicted_arguments is not null as schema_valid, predicted_arguments is not null and coalesce(error_code, '') not like 'canonical%' as canonical_intent_ok, error_code is null as exact_match, stale_canonical_name, error_code from scored")
def op_x02_predictions(spark, sf_dir):
    """Every message as a predicted call: parsed, resolved in its profile, mapped and checked under that profile's own schemas."""
    scored = T.score_predictions(_samples(spark, sf_dir), _tools(spark, sf_dir))
    return scored.select("conv_id", "turn", "predicted_name", "predicted_arguments", "parse_ok", "tool_name_ok", "schema_valid", "canonical_intent_ok", "exact_match", "stale_canonical_name", "error_code")


@query(f"""with {_FORMS}, twice as (select role as split, * from scored union all select 'overall', * from scored),
n as (select split, error_code, count(*) as n from twice where error_code is not null group by all),
m as (select split, string_agg(error_code || '=' || n, ',' order by error_code) as errors from n group by split)
select split, count(*) as sample_count, count(*) filter (parse_ok) / count(*) as parse_rate, count(*) filter (tool_name_ok) / count(*) as tool_name_accuracy, count(predicted_arguments) / count(*) as schema_valid_rate, count(*) filter (predicted_arguments is not null and coalesce(error_code, '') not like 'canonical%') / count(*) as canonical_intent_accuracy, count(*) filter (error_code is null) / count(*) as exact_match_rate, count(*) filter (stale_canonical_name) / count(*) as stale_canonical_name_rate, any_value(errors) as errors from twice left join m using (split) group by split""")
def op_g06_predictions(spark, sf_dir):
    """The scores of all predictions by role, and overall, with the number of each outcome code."""
    found = T.prediction_metrics(T.score_predictions(_samples(spark, sf_dir), _tools(spark, sf_dir)), "role")
    errors = F.array_join(F.transform(F.map_entries("error_counts"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return found.withColumn("errors", errors).drop("error_counts")


@query(f"""with {_FORMS} select conv_id, turn, case when form in (1, 2, 3, 4, 5, 6, 7, 11) then 'not_applicable' when form in (15) then 'not_applicable' when form in (13) then 'valid' when form = 17 then 'invalid' when form = 18 then null else 'valid' end as schema_status,
round(case when form in (1, 2, 3, 4, 5, 6) then 0.0 when form = 7 then 5 / 9.0 when form = 11 then 5 / 9.0 when form = 15 then 1 / 9.0 when form = 13 then 0.2 when form = 17 then 0.5 when form in (9, 12, 16) or (form = 8 and conv_id % 4 > 0) then 0.6 else 1.0 end, 9) as reward,
case when form <= 6 and form > 0 then error_code when form in (7, 13, 15) then 'tool_name_mismatch' when form = 17 then 'schema_invalid' when form in (9, 11, 12, 16) or (form = 8 and conv_id % 4 > 0) then 'arguments_mismatch' end as error_code from scored""")
def op_j14_rewards(spark, sf_dir):
    """Every message as a completion: its call against the expected one, and lightly against the specs that come with its row."""
    specs = F.format_string('[{"name":"%s","input_schema":{"type":"object","required":["range"],"properties":{"range":{"type":"object"},"unit":{"type":"integer"},"who":{"type":"string"},"odd":{"type":"date"}}}},{"name":"scan","input_schema":{"required":["start"]}},{"name":"write","input_schema":{"type":"string"}}]', "expected_name")
    samples = _samples(spark, sf_dir).withColumn("unit_is_text", F.col("form") == 17).withColumn("predicted_text", F.when(F.col("form") == 17, F.replace("predicted_text", F.lit('"unit":1'), F.lit('"unit":"1"'))).otherwise(F.col("predicted_text")))
    found = T.completion_rewards(samples.withColumn("tool_specs", specs).withColumn("expected_arguments", F.col("given")))
    return found.select("conv_id", "turn", "schema_status", F.round("reward", 9).alias("reward"), "error_code")


@query("""select event_id, case event_id % 8 when 0 then 'valid' when 1 then 'invalid' when 2 then 'invalid' when 3 then 'not_applicable' when 4 then 'not_applicable' when 5 then 'invalid' when 6 then 'valid' else 'not_applicable' end as status, case event_id % 8 when 1 then 'no integer: k' when 2 then 'missing: k' when 5 then 'required is no list' end as fault from events""")
def op_x04_toolspec(spark, sf_dir):
    """Events' properties lightly checked against the spec of their own row."""
    k = F.col("event_id") % 8
    spec = F.when(k == 3, "[]").when(k == 5, '[{"name":"e","input_schema":{"required":"k"}}]').when(k == 6, '[{"name":"e","input_schema":{"properties":{"k":{"type":"odd"}}}}]').when(k == 7, '[{"name":"e","input_schema":{"type":"array"}}]').otherwise('[{"name":"e","input_schema":{"type":"object","required":["k"],"properties":{"k":{"type":"integer"}}}},{"name":"e","input_schema":{}}]')
    given: Column = F.when(k == 1, '{"k":true}').when(k == 2, "{}").when(k == 4, None).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", T.light_check(spec, F.lit("e"), given).alias("c"))
    return e.select("event_id", "c.status", "c.fault")


_LINES = "l as (select conv_id, turn, role, string_agg(role || ': ' || text, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as context, count(*) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as n from conversations)"


@query(f"with {_LINES} select conv_id, turn, n as n_context, cast(coalesce(length(context), 0) as bigint) as context_chars, md5(coalesce(context, 'user: Complete task ' || conv_id || '.')) as context from l where role = 'assistant'")
def op_w02_ranges(spark, sf_dir):
    """What comes before each answer, as a range of its conversation's text; the digests are of the contexts that the ranges restore."""
    rows = table(spark, sf_dir, "conversations")
    ranges = C.context_ranges(rows, "conv_id", "turn", F.col("role") == "assistant")
    default = F.concat(F.lit("user: Complete task "), F.col("conv_id").cast("string"), F.lit("."))
    return C.with_contexts(ranges, C.trace_texts(rows, "conv_id", "turn"), "conv_id", default).withColumn("context", F.md5("context"))


@query(f"""with {_LINES}, p as (select n_nationkey as profile_id, n_nationkey % 6 as form from nation)
select conv_id, turn, profile_id, case when form in (0, 4) then 'say_' || profile_id end as exposed_name, case form when 0 then '{{"name":"say_' || profile_id || '","arguments":{{"at":{{"from":' || turn || '}},"who":"' || role || '"}}}}' when 4 then '{{"name":"say_' || profile_id || '","arguments":{{"start":' || turn || ',"text":"' || role || '"}}}}' end as call,
case form when 1 then 'unknown_tool' when 2 then 'ambiguous_tool' when 3 then 'unmapped: text' when 5 then 'exposed $.start' end as fault, n as n_context, cast(coalesce(length(context), 0) as bigint) as context_chars from l, p where role = 'assistant'""")
def op_p19_rendered(spark, sf_dir):
    """Every answer as a canonical action under the profile of every nation: its call in the profile's own names, with its context by reference."""
    rows = table(spark, sf_dir, "conversations")
    actions = rows.where("role = 'assistant'").select("conv_id", "turn", F.lit("Say").alias("canonical_name"), F.format_string('{"start":%d,"text":"%s"}', "turn", "role").alias("arguments"))
    form, null = F.col("n_nationkey") % 6, F.lit(None).cast("string")
    nation = table(spark, sf_dir, "nation")
    mapping = F.when(form == 0, '{"at.from":"start","who":"text"}').when(form == 3, '{"at.from":"start"}')
    views = nation.where("n_nationkey % 6 <> 1").select(F.col("n_nationkey").alias("profile_id"), F.format_string("say_%d", "n_nationkey").alias("exposed_name"), F.lit("say").alias("canonical_name"), F.lit("function").alias("kind"), F.when(form == 5, '{"type":"object","properties":{"start":{"type":"string"}}}').otherwise(null).alias("input_schema"), F.lit('{"type":"object","required":["start"]}').alias("canonical_schema"), mapping.alias("mapping"), F.explode(F.sequence(F.lit(0), F.when(form == 2, 1).otherwise(0))).alias("copy")).drop("copy")
    calls = C.rendered_calls(actions, views, nation.select(F.col("n_nationkey").alias("profile_id")))
    ranges = C.context_ranges(rows, "conv_id", "turn", F.col("role") == "assistant")
    return calls.join(ranges, ["conv_id", "turn"]).select("conv_id", "turn", "profile_id", "exposed_name", "call", "fault", "n_context", "context_chars")
