"""Raw samples, prompts, catalogs, classes of files and audits, over whole tables with planted forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import samples as S
from .registry import query, table


def _lines(spark, sf_dir) -> DataFrame:
    """A raw sample for each document; doc_id modulo 16 tells what is wrong with it."""
    form = F.col("doc_id") % 16
    mode = F.when(form == 3, "7").when(form % 2 == 0, '"remap"').otherwise('"copy"')
    specs = F.when(form == 4, "[]").when(form == 5, '[{"name":""},3]').otherwise('[{"name":"f"},{"name":null}]')
    keys = F.when(form == 6, '"source_trace_path":"a","source_request_id":"","source_catalog_id":"c"').otherwise('"source_trace_path":"a","source_request_id":"b","source_catalog_id":"c","base_profile_id":"d"')
    report = F.when(form == 7, "[]").when(form == 8, '{"unmapped_tool_uses":2,"dropped_tool_uses":0}').when(form == 9, '{"dropped_tool_uses":"0"}').when(form == 15, '{"unmapped_tool_uses":null,"dropped_tool_uses":0.0}').otherwise('{"unmapped_tool_uses":0}')
    call = lambda name: f'{{"block_type":"tool_use","tool_call":{{"name":"{name}"}}}}'
    blocks = F.when(form.isin(4, 5), "null").when(form == 10, '[{"block_type":"text"},{"block_type":"thinking"}]').when(form == 11, f'["x",{call("g")}]').when(form == 12, '[{"block_type":"tool_use"}]').when(form == 14, f'[{{"block_type":"tool_result"}},{call("g")},{call("f")}]').otherwise(f'[{{"block_type":"text"}},{call("f")}]')
    whole = F.format_string('{"sample_id":"s%d","metadata":{"transformation_mode":%s,%s,"target_profile_id":"e","tool_use_remap_report":%s},"tool_specs":%s,"target_blocks":%s}', "doc_id", mode, keys, report, specs, blocks)
    line = F.when(form == 1, "{x").when(form == 2, " [1] ").when(form == 13, " \t").otherwise(whole)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line"))


_ISSUES = """(values (1, 0, 'invalid_json', null), (2, 0, 'invalid_sample_shape', null), (3, 0, 'missing_transformation_mode', null), (4, 0, 'empty_visible_tool_specs', null), (5, 0, 'empty_visible_tool_specs', null), (6, 0, 'missing_source_metadata', 'source_request_id,base_profile_id'), (7, 0, 'missing_remap_report', null), (8, 0, 'remap_report_has_unmapped_tool_uses', '2'),
(9, 0, 'remap_report_has_dropped_tool_uses', '0'), (10, 0, 'forbidden_target_block_type', '1:thinking'), (11, 0, 'tool_call_name_not_in_visible_specs', '1:g'), (12, 0, 'tool_call_name_not_in_visible_specs', '0'), (14, 0, 'forbidden_target_block_type', '0:tool_result'), (14, 1, 'tool_call_name_not_in_visible_specs', '1:g'), (15, 0, 'remap_report_has_unmapped_tool_uses', null)) i(form, place, reason, detail)"""


@query(f"""select doc_id as line_no, case when form > 2 then 's' || doc_id end as sample_id, cast(place as int) as "at", reason, detail from documents join {_ISSUES} on form = doc_id % 16""")
def op_v10_samples(spark, sf_dir):
    """Raw samples with each of the faults that their shape can have."""
    return S.raw_sample_issues(_lines(spark, sf_dir))


@query(f"""with i as (select doc_id, reason from documents join {_ISSUES} on form = doc_id % 16), d as (select doc_id, doc_id % 16 as form from documents where doc_id % 16 <> 13)
select 'samples' as part, '' as name, count(*) as n from d union all select 'valid', '', count(*) from d where form = 0 union all select 'invalid', '', count(*) from d where form <> 0
union all select 'reason', reason, count(*) from i group by reason union all select 'mode', case when form % 2 = 0 then 'remap' else 'copy' end, count(*) from d where form not in (1, 2, 3) group by form % 2""")
def op_g40_samples(spark, sf_dir):
    """The report of raw samples: valid and invalid ones, issues by reason, samples by mode."""
    lines = _lines(spark, sf_dir)
    return S.validation_report(lines, S.raw_sample_issues(lines))


@query("""select conv_id, turn, case when turn % 3 = 2 then 'tool' else role end as role, case when turn % 3 = 2 then concat_ws(',', case when conv_id % 2 = 0 then 'tool_name=' || role end, 'tool_call_id=' || turn) else '' end as metadata from conversations""")
def op_p16_toolrows(spark, sf_dir):
    """Messages as context rows; those of tools keep the name and call that they have."""
    c = table(spark, sf_dir, "conversations")
    named = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("conv_id") % 2 == 0, F.col("role")).alias("tool_name"), F.col("turn").alias("tool_call_id"), F.lit(None).cast("string").alias("canonical_name"))
    entries = F.transform(F.map_entries("metadata"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return S.context_rows(named).select("conv_id", "turn", "role", F.array_join(entries, ",").alias("metadata"))


@query("""select conv_id, string_agg(turn || ':' || role, ',' order by turn) filter (turn % 4 = 1 and conv_id % 3 > 0) as calls, cast(count(*) as int) as blocks, cast(count(*) filter (turn % 4 <> 1) as int) as texts from conversations group by conv_id having count(*) filter (turn % 4 = 1 and conv_id % 3 > 0) > 0""")
def op_p17_references(spark, sf_dir):
    """Conversations as prompt samples: the calls of their targets in order as the reward's reference; those without a call go."""
    c = table(spark, sf_dir, "conversations")
    call = F.when(F.col("conv_id") % 3 > 0, F.col("role"))
    block = F.struct("turn", F.struct(F.when(F.col("turn") % 4 == 1, "tool_use").otherwise("text").alias("block_type"), F.col("turn").cast("string").alias("call_id"), call.alias("name"), F.lit("{}").alias("arguments")).alias("block"))
    made = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["block"]).alias("target_blocks"))
    r = F.col("reward_reference")
    calls = F.transform(r["expected_tool_calls"], lambda x: F.concat_ws(":", x["call_id"], x["name"]))
    return S.prompt_samples(made).select("conv_id", F.array_join(calls, ",").alias("calls"), r["target_block_count"].alias("blocks"), r["target_text_block_count"].alias("texts"))


@query("""with r as (select distinct conv_id, conv_id % 7 as form from conversations)
select conv_id, cast(0 as int) as "at", 'look_' || conv_id as name, 'finds things' as description, 'function' as kind, '{"type":"object"}' as input_schema, cast(null as varchar) as fault from r where form <> 6
union all select conv_id, 1, 'note', '', 'freeform', '{}', null from r where form <> 6
union all select conv_id, 2, case when form in (3, 4) then 'odd' when form = 2 then '' end, case form when 4 then 'd' else '' end, 'function', '{}', case form when 1 then 'no_mapping' when 2 then 'no_name' when 3 then 'description_no_text' when 4 then 'schema_no_mapping' end from r where form between 1 and 4""")
def op_p20_tools(spark, sf_dir):
    """The tools of requests as catalog entries; each way to be malformed is planted and named."""
    form = F.col("conv_id") % 7
    odd = F.when(form == 1, ',"text"').when(form == 2, ',{"name":""}').when(form == 3, ',{"name":"odd","description":3}').when(form == 4, ',{"name":"odd","description":"d","input_schema":[1]}').otherwise("")
    tools = F.format_string('{"model":"m","tools":[{"name":"look_%d","description":"finds things","input_schema":{"type":"object"}},{"type":"custom","name":"note","description":null}%s]}', "conv_id", odd)
    requests = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("body", F.when(form == 6, '{"model":"m","tools":"none"}').otherwise(tools))
    return S.request_catalog(requests, "conv_id", strict=False)


@query("""select event_id, event_type = 'signup' or coalesce(min(case when event_type = 'view' then event_id end) over (partition by user_id) > event_id, true) as orphan from events""")
def op_j13_anchored(spark, sf_dir):
    """Events as parts of requests that views open: those before it, of no request, or of a kind that no request has, are orphans."""
    e = table(spark, sf_dir, "events").withColumn("route", F.lit("messages"))
    found = S.anchored_events(e, "user_id", "event_id", "route", "event_type", {"messages": "view"}, {"messages": ("click", "purchase", "error", "refund", "login", "logout", "search")}, strict=False)
    return found.select("event_id", "orphan")


_PATHS = {
    "runs/1/Run_Manifest.json": "manifest", "a/payloads/x.json": "raw_provider_payload", "a/w/notes.md": "workspace_snapshot", "a/__pycache__/m.txt": "compiled_artifact", "a/m.PYC": "compiled_artifact", "fix.patch": "patch", "a/change.diff": "patch", "run.log": "log", "a/runtime_trace.jsonl": "trace", "trajectory.json": "trace",
    "train_samples.jsonl": "dataset", "samples.json": "structured_artifact", "a/summary.md": "report", "metrics": "report", "x.yaml": "config", "config": "config", "a/b.json": "structured_artifact", "a/events.jsonl": "event_log", "a/run.py": "source_or_text_snapshot", ".py": "other", "a/picture.png": "other", "manifest.yaml": "config", "a.workspace/b.sh": "source_or_text_snapshot",
}
_CLASS = " ".join(f"when {i} then '{c}'" for i, c in enumerate(_PATHS.values()))


@query(f"select event_id, case when event_id % 11 = 0 then 'symlink' else case event_id % {len(_PATHS)} {_CLASS} end end as class from events")
def op_x18_paths(spark, sf_dir):
    """Files of a run tree by the rules of their paths."""
    e = table(spark, sf_dir, "events")
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % len(_PATHS) + 1).cast("int"))
    kind = F.when(F.col("event_id") % 11 == 0, "symlink").otherwise("file")
    return e.select("event_id", S.artifact_class(path, kind).alias("class"))


def _runs(spark, sf_dir) -> DataFrame:
    """A summary of each user's events with every measure that an audit adds up."""
    e = table(spark, sf_dir, "events")
    sums = [F.count_if(F.col("event_id") % (i + 2) == 0).alias(c) for i, c in enumerate(S.SUMS)]
    flags = [(F.count_if(F.col("event_id") % 17 == i % 17) > i % 5).alias(f"saw_{c}") for i, c in enumerate(S.FLAGS)]
    status = F.when(F.max_by("event_type", "event_id") == "error", "failed").otherwise("completed")
    means = [F.count_if(F.col("event_type") == t).cast("double").alias(f"mean_{c}_attempts_per_issue") for c, t in (("validation", "view"), ("revision", "click"))]
    return e.groupBy("user_id").agg(status.alias("status"), (F.max("value") > 150).alias("passed"), *sums, *flags, *means).withColumn("task_id", F.col("user_id") % 10)


_RUNS = "r as (select user_id, user_id % 10 as task_id, case when arg_max(event_type, event_id) = 'error' then 'failed' else 'completed' end as status, max(value) > 150 as passed, count(*) filter (event_type = 'view') as mv, count(*) filter (event_type = 'click') as mr, {sums}, {flags} from events group by user_id)".format(
    sums=", ".join(f"count(*) filter (event_id % {i + 2} = 0) as {c}" for i, c in enumerate(S.SUMS)), flags=", ".join(f"count(*) filter (event_id % 17 = {i % 17}) > {i % 5} as saw_{c}" for i, c in enumerate(S.FLAGS))
)


@query(f"""with {_RUNS} select count(*) as run_count, count(*) filter (status = 'completed') as completed_run_count, count(*) filter (passed) as passed_run_count, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in S.SUMS)}, {', '.join(f'count(*) filter (saw_{c}) as runs_with_{c}' for c in S.FLAGS)},
round(cast(sum(mv * validation_issue_count) as double) / greatest(sum(validation_issue_count), 1), 4) as mean_validation_attempts_per_issue, round(cast(sum(mr * validation_issue_count) as double) / greatest(sum(validation_issue_count), 1), 4) as mean_revision_attempts_per_issue from r""")
def op_g11_behavior(spark, sf_dir):
    """All measures of the behaviour audit over the users' events as runs."""
    return S.behavior_audit(_runs(spark, sf_dir))


@query(f"with {_RUNS} select task_id, count(*) as run_count, count(*) filter (status = 'completed') as completed_run_count, count(*) filter (passed) as passed_run_count, {', '.join(f'count(*) filter (saw_{c}) as runs_with_{c}' for c in S.TASK_FLAGS)} from r group by task_id")
def op_g13_baseline(spark, sf_dir):
    """The counters of each task over its runs."""
    return S.task_baseline(_runs(spark, sf_dir))
