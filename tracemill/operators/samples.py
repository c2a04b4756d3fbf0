"""Raw samples and requests: their shape, prompts with a reward reference, tool catalogs, classes of files, and audits over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metadata that every raw sample names, block types that no target may have.
SOURCE_KEYS = ("source_trace_path", "source_request_id", "source_catalog_id", "base_profile_id", "target_profile_id")
FORBIDDEN_BLOCKS = ("thinking", "tool_result")

# What is summed over runs, and what is counted by runs.
SUMS = (
    "validation_turn_count revalidation_turn_count revision_turn_count finish_deferred_count finish_attempt_count finish_blocked_count compaction_turn_count premature_finish_count finish_without_progress_count finish_after_recent_failure_count "
    "finish_blocked_recent_failure_count finish_blocked_post_edit_validation_missing_count finish_attempt_before_revalidation_count failure_then_no_corrective_progress_count failure_then_successful_revalidation_count finish_after_tool_execution_failure_count "
    "finish_after_validation_failure_without_revision_count no_progress_after_validation_failure_count tool_progress_stall_count empty_turn_no_tool_no_content_count schema_malformed_turn_count recovered_format_drift_count compat_leak_count truncated_tool_block_count "
    "unrecovered_validation_failure_count tool_execution_failure_unrecovered_count validation_issue_count validation_retry_count revision_after_validation_failure_count token_budget_compaction_turn_count"
).split()
FLAGS = (
    "validation_failure revision_after_failure finish_deferred compaction validation_budget_exhausted revision_budget_exhausted finish_blocked_by_validation token_overflow premature_finish finish_without_progress finish_after_recent_failure finish_blocked_recent_failure "
    "finish_blocked_post_edit_validation_missing finish_attempt_before_revalidation failure_then_no_corrective_progress failure_then_successful_revalidation finish_after_tool_execution_failure finish_after_validation_failure_without_revision no_progress_after_validation_failure "
    "tool_progress_stall empty_turn_no_tool_no_content schema_malformed recovered_format_drift compat_leak truncated_tool_block unrecovered_validation_failure tool_execution_failure_unrecovered parse_error llm_error no_tool_progress"
).split()
TASK_FLAGS = (
    "validation_failure revision_after_failure finish_blocked_by_validation premature_finish finish_without_progress finish_after_recent_failure parse_error llm_error no_tool_progress empty_turn_no_tool_no_content recovered_format_drift compat_leak truncated_tool_block "
    "unrecovered_validation_failure tool_execution_failure_unrecovered"
).split()


def _part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str) -> Column:
    """The string at a path; null where something else stands there, or nothing."""
    return F.when(F.schema_of_variant(_part(value, path)) == "STRING", F.try_variant_get(value, path, "string"))


def _is(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_part(value, path)).startswith(kind), F.lit(False))


def raw_sample_issues(lines: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(line_no, sample_id, at, reason, detail) of every fault of raw samples, one JSON text a row, in the order in which they are found; blank lines are passed over.

    invalid_json and invalid_sample_shape stand alone. Otherwise: missing_transformation_mode, empty_visible_tool_specs, missing_source_metadata (the
    keys), missing_remap_report or what it has unmapped or dropped, and for each target block forbidden_target_block_type or
    tool_call_name_not_in_visible_specs.
    """
    v = F.col("_v")
    specs = F.when(_is(v, "$.tool_specs", "ARRAY"), F.try_variant_get(v, "$.tool_specs", "array<variant>"))
    names = F.filter(F.transform(F.coalesce(specs, F.array().cast("array<variant>")), lambda x: _text(x, "$.name")), lambda n: n.isNotNull() & (n != ""))
    missing = F.array_compact(F.array(*(F.when(F.coalesce(_text(v, f"$.metadata.{k}"), F.lit("")) == "", F.lit(k)) for k in SOURCE_KEYS)))
    issue = lambda reason, detail=None: F.struct(F.lit(reason).alias("reason"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    report = "$.metadata.tool_use_remap_report"

    def left(name: str) -> Column:
        """A number that is there and is not 0; what is no number is not 0 either."""
        part = _part(v, f"{report}.{name}")
        plain = ~F.schema_of_variant(part).isin("STRING", "VOID") & ~F.schema_of_variant(part).rlike("^(ARRAY|OBJECT)")
        return part.isNotNull() & ~(plain & F.coalesce(F.try_variant_get(v, f"{report}.{name}", "double") == 0, F.lit(False)))

    has_report = _is(v, report, "OBJECT")
    blocks = F.coalesce(F.when(_is(v, "$.target_blocks", "ARRAY"), F.try_variant_get(v, "$.target_blocks", "array<variant>")), F.array().cast("array<variant>"))

    def of_block(block: Column, i: Column) -> Column:
        kind, name = _text(block, "$.block_type"), _text(block, "$.tool_call.name")
        where = lambda x: F.concat_ws(":", i.cast("string"), x)
        seen = F.coalesce(F.array_contains(F.col("_names"), name), F.lit(False))
        return F.when(kind.isin(*FORBIDDEN_BLOCKS), issue("forbidden_target_block_type", where(kind))).when((kind == "tool_use") & ~seen, issue("tool_call_name_not_in_visible_specs", where(name)))

    shape = F.array(
        F.when(F.coalesce(_text(v, "$.metadata.transformation_mode"), F.lit("")) == "", issue("missing_transformation_mode")),
        F.when(F.size("_names") == 0, issue("empty_visible_tool_specs")),
        F.when(F.size(missing) > 0, issue("missing_source_metadata", F.array_join(missing, ","))),
        F.when(~has_report, issue("missing_remap_report")),
        *(F.when(has_report & left(n), issue(f"remap_report_has_{n}", F.try_variant_get(v, f"{report}.{n}", "string"))) for n in ("unmapped_tool_uses", "dropped_tool_uses")),
    )
    text = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"^\s+|\s+$", ""))
    rows = lines.withColumn("_t", text).where("_t <> ''").withColumn("_v", F.try_parse_json("_t")).withColumn("_names", names)
    whole = F.when(v.isNull(), F.array(issue("invalid_json"))).when(~F.schema_of_variant(v).startswith("OBJECT"), F.array(issue("invalid_sample_shape"))).otherwise(F.concat(shape, F.transform(blocks, of_block)))
    found = rows.select(line_no, _text(v, "$.sample_id").alias("sample_id"), F.posexplode(F.array_compact(whole)).alias("at", "x"))
    return found.select(line_no, "sample_id", "at", "x.reason", "x.detail")


def validation_report(lines: DataFrame, issues: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(part, name, n): samples, valid and invalid ones, issues by reason and samples by transformation mode."""
    mode = _text(F.try_parse_json(F.col(line)), "$.metadata.transformation_mode")
    samples = lines.where(F.coalesce(F.regexp_replace(line, r"\s+", ""), F.lit("")) != "")
    bad = issues.select(line_no).distinct().agg(F.count("*").alias("bad"))
    totals = samples.agg(F.count("*").alias("n")).crossJoin(bad).select(F.explode(F.array(*(F.struct(F.lit(p).alias("part"), n.cast("long").alias("n")) for p, n in (("samples", F.col("n")), ("valid", F.col("n") - F.col("bad")), ("invalid", F.col("bad")))))).alias("x")).select("x.part", F.lit("").alias("name"), "x.n")
    reasons = issues.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("reason").alias("part"), "name", "n")
    modes = samples.select(mode.alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("mode").alias("part"), "name", "n")
    return totals.union(reasons).union(modes)


def context_rows(messages: DataFrame, role: str = "role", fields: tuple[str, ...] = ("tool_name", "tool_call_id", "canonical_name")) -> DataFrame:
    """messages with `metadata`, a map of those of `fields` that a tool's message has; it is empty for all other roles. The fields themselves go."""
    entries = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value"))) for f in fields)))
    made = F.map_from_entries(F.when(F.col(role) == "tool", entries).otherwise(F.slice(entries, 1, 0)))
    return messages.withColumn("metadata", made).drop(*fields)


def prompt_samples(samples: DataFrame, blocks: str = "target_blocks") -> DataFrame:
    """Samples that call a tool, with reward_reference in place of their target blocks (array of block_type, call_id, name, arguments): the expected calls in order, and how many blocks and text blocks the target has."""
    calls = F.filter(blocks, lambda b: (b["block_type"] == "tool_use") & b["name"].isNotNull())
    kept = samples.withColumn("_calls", F.transform(calls, lambda b: F.struct(b["call_id"].alias("call_id"), b["name"].alias("name"), b["arguments"].alias("arguments")))).where(F.size("_calls") > 0)
    reference = F.struct(F.col("_calls").alias("expected_tool_calls"), F.size(blocks).alias("target_block_count"), F.size(F.filter(blocks, lambda b: b["block_type"] == "text")).alias("target_text_block_count"))
    return kept.withColumn("reward_reference", reference).drop("_calls", blocks)


def request_catalog(requests: DataFrame, key: str, body: str = "body", strict: bool = True) -> DataFrame:
    """(key, at, name, description, kind, input_schema, fault) of the tools of each request's body, in their order.

    kind is freeform for tools of type custom, else function. fault is no_mapping, no_name, description_no_text or schema_no_mapping; with strict
    it raises. Requests without tools give no rows.
    """
    v = F.try_parse_json(body)
    tools = F.when(_is(v, "$.tools", "ARRAY"), F.try_variant_get(v, "$.tools", "array<variant>"))
    t = F.col("_t")
    there = lambda path: _part(t, path).isNotNull() & (F.schema_of_variant(_part(t, path)) != "VOID")
    kind = F.when(_text(t, "$.type") == "custom", "freeform").otherwise("function")
    fault = (
        F.when(~F.schema_of_variant(t).startswith("OBJECT"), "no_mapping").when(F.coalesce(_text(t, "$.name"), F.lit("")) == "", "no_name").when(there("$.description") & ~_is(t, "$.description", "STRING"), "description_no_text")
        .when((kind == "function") & there("$.input_schema") & ~_is(t, "$.input_schema", "OBJECT"), "schema_no_mapping")
    )
    rows = requests.select(key, F.posexplode(tools).alias("at", "_t")).withColumn("fault", fault)
    if strict:
        rows = rows.withColumn("at", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("tool"), F.col(key).cast("string"), F.col("at").cast("string"), "fault")).cast("int")).otherwise(F.col("at")))
    schema = F.coalesce(F.when(_is(t, "$.input_schema", "OBJECT"), F.to_json(_part(t, "$.input_schema"))), F.lit("{}"))
    return rows.select(key, "at", _text(t, "$.name").alias("name"), F.coalesce(_text(t, "$.description"), F.lit("")).alias("description"), kind.alias("kind"), schema.alias("input_schema"), "fault")


def identity_profile(catalog: DataFrame, key: str) -> DataFrame:
    """A catalog as the profile that shows every tool as it is: the table of tools that score_predictions() and rendered_calls() take."""
    none = F.lit(None).cast("string")
    fine = catalog.where("fault is null")
    return fine.select(F.col(key).alias("profile_id"), F.col("at").alias("position"), F.col("name").alias("exposed_name"), F.col("name").alias("canonical_name"), "kind", "input_schema", F.col("input_schema").alias("canonical_schema"), none.alias("mapping"), none.alias("defaults"))


def anchored_events(events: DataFrame, request: str, order: str, route: str, kind: str, anchors: dict[str, str], parts: dict[str, tuple[str, ...]], strict: bool = True) -> DataFrame:
    """events with orphan: whether no request of its route and id comes before it, or its kind is none of the route's.

    anchors names each route's kind of a request, parts its other kinds. With strict an orphan raises. One
    minimum a request is fixed and joined, so a request of very many events stays spread over tasks.
    """
    from ..functions.joining import join_measured

    opens = F.lit(False)
    known = F.lit(False)
    for name, first in anchors.items():
        opens |= (F.col(route) == name) & (F.col(kind) == first)
        known |= (F.col(route) == name) & F.col(kind).isin(first, *parts.get(name, ()))
    first = events.where(opens).groupBy(request, route).agg(F.min(order).alias("_first"))
    met = join_measured(events, first, [request, route], "left")
    orphan = ~F.coalesce(known, F.lit(False)) | ~F.coalesce(F.col("_first") <= F.col(order), F.lit(False))
    if strict:
        orphan = F.when(orphan, F.raise_error(F.concat_ws(" ", F.lit("no request of"), F.col(kind), F.col(request).cast("string"))).cast("boolean")).otherwise(False)
    return met.withColumn("orphan", orphan).drop("_first")


# Classes of files by their path, the first that holds.
def artifact_class(path: Column, file_kind: Column | None = None) -> Column:
    """The class of a file of a run tree by its path, letter case aside; symlinks and special files are classes of their own."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/", -1), -1)
    parts = F.split(low, "/", -1)
    suffix = F.regexp_extract(name, r".(\.[^.]+)$", 1)
    within = lambda *words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    has = lambda *words: F.greatest(*(name.contains(w) for w in words), F.lit(False))
    rules = [
        ("manifest", name.contains("manifest") & (suffix == ".json")), ("raw_provider_payload", within("payloads", "claude_gateway_traces")), ("workspace_snapshot", within("workspace", "w")), ("compiled_artifact", suffix.isin(".pyc", ".pyo") | within("__pycache__")),
        ("patch", suffix.isin(".patch", ".diff")), ("log", suffix == ".log"), ("trace", has("runtime_trace", "request_context", "retained_history", "trajectory")), ("dataset", (suffix == ".jsonl") & has("samples", "tokenized", "train")),
        ("report", has("report", "summary", "metrics", "acceptance")), ("config", suffix.isin(".yaml", ".yml", ".toml") | name.contains("config")), ("structured_artifact", suffix == ".json"), ("event_log", suffix == ".jsonl"), ("source_or_text_snapshot", suffix.isin(".py", ".sh", ".md", ".txt")),
    ]
    out = F.when(F.lit(False), "")
    if file_kind is not None:
        out = F.when(file_kind.isin("symlink", "special"), file_kind)
    for found, rule in rules:
        out = out.when(rule, found)
    return out.otherwise("other")


def behavior_audit(runs: DataFrame) -> DataFrame:
    """One row over all runs: run_count, completed_run_count, passed_run_count, every one of SUMS, runs_with_ every one of FLAGS, and two means weighed by issues.

    runs: status, passed, the columns of SUMS, saw_ and each of FLAGS, mean_validation_attempts_per_issue and mean_revision_attempts_per_issue.
    """
    n = F.greatest(F.coalesce(F.sum("validation_issue_count"), F.lit(0)), F.lit(1))
    mean = lambda c: F.round(F.coalesce(F.sum(F.col(c) * F.col("validation_issue_count")), F.lit(0.0)) / n, 4).alias(c)
    return runs.agg(
        F.count("*").alias("run_count"), F.count_if(F.col("status") == "completed").alias("completed_run_count"), F.count_if("passed").alias("passed_run_count"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS), *(F.count_if(f"saw_{c}").alias(f"runs_with_{c}") for c in FLAGS),
        mean("mean_validation_attempts_per_issue"), mean("mean_revision_attempts_per_issue"),
    )


def task_baseline(runs: DataFrame, task: str = "task_id") -> DataFrame:
    """A row for each task: its runs, those completed and passed, and runs_with_ every one of TASK_FLAGS."""
    return runs.groupBy(task).agg(F.count("*").alias("run_count"), F.count_if(F.col("status") == "completed").alias("completed_run_count"), F.count_if("passed").alias("passed_run_count"), *(F.count_if(f"saw_{c}").alias(f"runs_with_{c}") for c in TASK_FLAGS))
