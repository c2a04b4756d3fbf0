"""Contracts of prepared bundles, dataset folders, request contexts and histories.

A prepared sample has sample_id, sample_type, source_type, split, task_id, tool_profile_id, text,
segments (kind, text, trainable), spans (start, end, trainable), character_mask, trainable_char_count
and the outcome fields reward, status, verifier_passed, verifier_score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import running_ends

#: Fields that no prepared sample leaves blank, and those that tokenized metadata has to keep.
IDENTITY = ("sample_id", "sample_type", "source_type", "split", "task_id", "tool_profile_id")
PRESERVED = ("task_id", "tool_profile_id", "sample_id", "source_type")
OUTCOME = ("reward", "status", "verifier_passed", "verifier_score")


def named_faults(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that are broken, in order; a rule that is null is not broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)))


def sample_faults() -> Column:
    """The broken invariants of a prepared sample, in the order in which they are checked."""
    segments, spans, mask = F.col("segments"), F.col("spans"), F.col("character_mask")
    lengths = F.transform(segments, lambda s: F.length(F.coalesce(s["text"], F.lit(""))))
    ends = running_ends(lengths)
    pairs = F.arrays_zip(segments.alias("g"), spans.alias("p"), F.slice(ends, F.lit(1), F.size(lengths)).alias("a"), F.slice(ends, F.lit(2), F.size(lengths)).alias("b"))
    misplaced = F.exists(pairs, lambda x: ~(x["p"]["start"].eqNullSafe(x["a"].cast("long")) & x["p"]["end"].eqNullSafe(x["b"].cast("long")) & x["p"]["trainable"].eqNullSafe(x["g"]["trainable"])))
    expected = F.flatten(F.transform(segments, lambda s: F.array_repeat(F.coalesce(s["trainable"], F.lit(False)).cast("int"), F.length(F.coalesce(s["text"], F.lit(""))))))
    given = [F.col(c).isNotNull() for c in OUTCOME]
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return named_faults(
        [(f"blank_{c}", blank(c)) for c in IDENTITY]
        + [
            ("mask_length", F.length("text") != F.size(mask)),
            ("mask_values", F.exists(mask, lambda m: ~m.isin(0, 1))),
            ("trainable_count", F.aggregate(mask, F.lit(0).cast("long"), lambda acc, m: acc + m) != F.col("trainable_char_count")),
            ("span_count", F.size(segments) != F.size(spans)),
            ("segment_kind", F.exists(segments, lambda s: F.coalesce(s["kind"], F.lit("")) == "")),
            ("segment_text", F.exists(segments, lambda s: s["text"].isNull())),
            ("segment_flag", F.exists(segments, lambda s: s["trainable"].isNull())),
            ("trainable_kind", F.exists(segments, lambda s: s["trainable"] & (s["kind"] != "assistant_tool_call"))),
            ("span_bounds", misplaced),
            ("text_segments", F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), "") != F.col("text")),
            ("mask_segments", ~expected.eqNullSafe(mask)),
            ("outcome", reduce(lambda a, b: a | b, given) & ~reduce(lambda a, b: a & b, given)),
        ]
    )


def _counted(faults: DataFrame, code: str | Column, key: Column) -> DataFrame:
    return faults.groupBy((F.lit(code) if isinstance(code, str) else code).alias("code")).agg(F.count("*").alias("n"), F.min(key.cast("string")).alias("first"))


def count_issue(spark, code: str, expected: Column, actual: Column, rows: DataFrame) -> DataFrame:
    """One issue (code, n = 1, first = both counts) of a one-row table whose counts differ."""
    return rows.where(~expected.eqNullSafe(actual)).select(F.lit(code).alias("code"), F.lit(1).cast("long").alias("n"), F.concat_ws(" / ", expected.cast("string"), actual.cast("string")).alias("first"))


def bundle_issues(samples: DataFrame, tokenized: DataFrame, packed: DataFrame, total_examples: int | None = None) -> DataFrame:
    """(code, n, first) of a training bundle: what prepared samples, tokenized examples and packed sequences disagree on.

    samples has index and PRESERVED; tokenized has index and the same fields as it kept them; packed
    has sequence, source_spans and unpacked (the number of examples that unpacking gives).
    total_examples is what the pack states, by default the number of its spans.
    """
    spark = samples.sparkSession
    n_samples, n_tokenized = samples.agg(F.count("*").alias("n_samples")), tokenized.agg(F.count("*").alias("n_tokenized"))
    packs = packed.agg(F.coalesce(F.sum("unpacked"), F.lit(0)).cast("long").alias("n_unpacked"), F.coalesce(F.sum(F.size("source_spans")), F.lit(0)).cast("long").alias("n_spans"))
    totals = n_samples.crossJoin(n_tokenized).crossJoin(packs)
    stated = F.col("n_spans") if total_examples is None else F.lit(total_examples).cast("long")
    repeated = samples.groupBy("sample_id").agg(F.count("*").alias("_n")).where("_n > 1")
    kept = tokenized.select("index", *(F.col(c).alias(f"_{c}") for c in PRESERVED))
    lost = samples.join(kept, "index").select("index", F.explode(named_faults([(f"prepared_{c}_not_preserved", ~F.col(c).eqNullSafe(F.col(f"_{c}"))) for c in PRESERVED])).alias("code"))
    parts = [
        totals.where("n_samples = 0").select(F.lit("prepared_empty_bundle").alias("code"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("first")),
        _counted(repeated, "prepared_duplicate_sample_id", F.col("sample_id")).where("n > 0"),
        count_issue(spark, "prepared_tokenized_count_mismatch", F.col("n_samples"), F.col("n_tokenized"), totals),
        _counted(lost, F.col("code"), F.format_string("%012d", F.col("index"))),
        count_issue(spark, "prepared_packed_example_count_mismatch", F.col("n_tokenized"), stated, totals),
        _counted(packed.where(F.col("unpacked") != F.size("source_spans")), "prepared_packed_source_count_mismatch", F.format_string("%012d", F.col("sequence"))),
        count_issue(spark, "prepared_unpack_count_mismatch", F.col("n_tokenized"), F.col("n_unpacked"), totals),
    ]
    return reduce(DataFrame.union, parts)


def manifest_issues(manifest: DataFrame, samples: DataFrame, rollouts: DataFrame) -> DataFrame:
    """(code, n, first) where a one-row manifest (rollout_count, sample_count) and the records' counts differ."""
    spark = manifest.sparkSession
    totals = manifest.select("rollout_count", "sample_count").crossJoin(samples.agg(F.count("*").alias("_s"))).crossJoin(rollouts.agg(F.count("*").alias("_r")))
    rules = [("manifest_rollout_count_mismatch", "rollout_count", "_r"), ("manifest_sample_count_mismatch", "sample_count", "_s"), ("sample_rollout_count_mismatch", "_s", "_r")]
    return reduce(DataFrame.union, [count_issue(spark, code, F.col(a), F.col(b), totals) for code, a, b in rules])


def split_issues(split_counts: DataFrame, samples: DataFrame, policy: str | None, required: str = "assistant_tool_call_only") -> DataFrame:
    """(code, n, first) of a schema-following source: splits whose stated count (split, expected) differs from their samples', and a manifest with another policy of the loss mask."""
    actual = samples.groupBy("split").agg(F.count("*").alias("_n"))
    both = split_counts.join(actual, "split", "full").where(~F.col("expected").eqNullSafe(F.coalesce("_n", F.lit(0).cast("long"))))
    wrong = samples.sparkSession.createDataFrame([(policy,)], "policy string").where(~F.col("policy").eqNullSafe(F.lit(required)))
    return _counted(both, "schema_following_split_count_mismatch", F.col("split")).union(_counted(wrong, "schema_following_loss_mask_policy_mismatch", F.coalesce("policy", F.lit("none"))))


def roundtrip_issues(written: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """(code, n, first) where records that were written and read again differ: in number, or a key in its content."""
    content = sorted(c for c in written.columns if c != key)
    digest = lambda df, name: df.select(key, F.xxhash64(*content).alias(name))
    counts = written.agg(F.count("*").alias("_w")).crossJoin(read.agg(F.count("*").alias("_r")))
    changed = digest(written, "_a").join(digest(read, "_b"), key).where("_a <> _b")
    return count_issue(written.sparkSession, "roundtrip_count_mismatch", F.col("_w"), F.col("_r"), counts).union(_counted(changed, "roundtrip_content_mismatch", F.format_string("%012d", F.col(key))))


def context_faults(entries: DataFrame, retained: DataFrame) -> DataFrame:
    """(run_id, turn_index, faults) of every request context against its run's retained history.

    entries has run_id, turn_index, selected and omitted (arrays of ids), request_message_count,
    replacement_active, summary_id, carried_id and record_id; retained has run_id, entry_id, source_kind, record_id,
    sources (of a summary: the ids that it stands for). A retained id is looked up by a join; no run is
    gathered in one place.
    """
    named = entries.select("run_id", "turn_index", F.explode(F.array_distinct(F.concat(F.transform("selected", lambda x: F.struct(x.alias("id"), F.lit("selected").alias("part"))), F.transform("omitted", lambda x: F.struct(x.alias("id"), F.lit("omitted").alias("part")))))).alias("r"))
    known = retained.select("run_id", "entry_id").distinct().withColumn("_known", F.lit(True))
    absent = named.select("run_id", "turn_index", F.col("r.id").alias("entry_id"), F.col("r.part").alias("part")).join(known, ["run_id", "entry_id"], "left").where("_known is null")
    missing = absent.groupBy("run_id", "turn_index").agg(F.max(F.col("part") == "selected").alias("_no_selected"), F.max(F.col("part") == "omitted").alias("_no_omitted"))
    of = lambda name: retained.select("run_id", F.col("entry_id").alias(f"{name}_id"), F.lit(True).alias(f"_{name}"), F.col("source_kind").alias(f"_{name}_kind"), F.col("record_id").alias(f"_{name}_record"), F.col("sources").alias(f"_{name}_sources"))
    joined = entries.join(missing, ["run_id", "turn_index"], "left").join(of("summary"), ["run_id", "summary_id"], "left").join(of("carried"), ["run_id", "carried_id"], "left")
    on, off = F.col("replacement_active"), ~F.col("replacement_active")
    has = lambda c: F.col(c).isNotNull()
    rules = [
        ("missing_selected", F.col("_no_selected")),
        ("missing_omitted", F.col("_no_omitted")),
        ("message_count", F.col("_no_selected").isNull() & F.col("_no_omitted").isNull() & (F.size("selected") > 0) & (F.size("selected") != F.col("request_message_count"))),
        ("no_summary_id", on & ~has("summary_id")),
        ("no_carried_id", on & ~has("carried_id")),
        ("no_record_id", on & ~has("record_id")),
        ("summary_missing", on & has("summary_id") & F.col("_summary").isNull()),
        ("summary_kind", on & (F.col("_summary_kind") != "replacement_summary")),
        ("summary_sources", on & F.col("_summary") & ~F.coalesce(F.col("_summary_sources"), F.array().cast("array<string>")).eqNullSafe(F.col("omitted"))),
        ("summary_record", on & F.col("_summary") & ~F.col("_summary_record").eqNullSafe(F.col("record_id"))),
        ("carried_missing", on & has("carried_id") & F.col("_carried").isNull()),
        ("carried_kind", on & (F.col("_carried_kind") != "carry_forward_state")),
        ("carried_record", on & F.col("_carried") & ~F.col("_carried_record").eqNullSafe(F.col("record_id"))),
        ("summary_not_selected", on & has("summary_id") & ~F.array_contains("selected", F.col("summary_id"))),
        ("carried_selected", on & has("carried_id") & F.array_contains("selected", F.col("carried_id"))),
        ("stray_summary_id", off & has("summary_id")),
        ("stray_carried_id", off & has("carried_id")),
        ("stray_record_id", off & has("record_id")),
    ]
    return joined.select("run_id", "turn_index", named_faults(rules).alias("faults"))


def history_transitions(snapshots: DataFrame) -> DataFrame:
    """(run_id, turn_index, previous_turn, kind, prefix_ok, suffix_ok, n_appended) of each snapshot against the one before it.

    snapshots has run_id, turn_index, selected (messages after compaction), before (messages before
    it), new_sources (source messages since the snapshot before, or all for a first one) and compacted. What the
    previous snapshot selected has to be the prefix of `before`, and the rest of it the new source messages.
    """
    w = Window.partitionBy("run_id").orderBy("turn_index")
    last, first = F.lag("selected").over(w), F.lag("turn_index").over(w).isNull()
    rows = snapshots.withColumns({"_last": F.when(first, F.array().cast(snapshots.schema["selected"].dataType)).otherwise(last), "_first": first, "previous_turn": F.lag("turn_index").over(w)})
    n = F.size("_last")
    kind = F.concat(F.when(F.col("_first"), F.lit("initial_")).otherwise(F.lit("")), F.when(F.col("compacted"), F.when(F.col("_first"), "compaction_snapshot").otherwise("replacement_compaction")).otherwise(F.when(F.col("_first"), "snapshot").otherwise("append_only")))
    prefix = (F.size("before") >= n) & F.slice("before", F.lit(1), n).eqNullSafe(F.col("_last"))
    # A history that is shorter than what was selected before it has nothing appended.
    rest = F.when(F.size("before") >= n, F.slice("before", n + 1, F.size("before"))).otherwise(F.slice("before", F.lit(1), F.lit(0)))
    return rows.select("run_id", "turn_index", "previous_turn", kind.alias("kind"), prefix.alias("prefix_ok"), rest.eqNullSafe(F.col("new_sources")).alias("suffix_ok"), F.size("new_sources").cast("long").alias("n_appended"))


def skip_reason(extracted: Column, tools: Column, has_call: Column, in_catalog: Column) -> Column:
    """Why a request gives no sample, by the first rule that it breaks; null if it gives one."""
    return F.when(~F.coalesce(extracted, F.lit(False)), "not_extracted").when(F.coalesce(tools, F.lit(0)) <= 0, "no_tools").when(~F.coalesce(has_call, F.lit(False)), "no_tool_use").when(~F.coalesce(in_catalog, F.lit(False)), "no_catalog")


def within_length(rows: DataFrame, prompt: str, n_tokens: Column, max_length: int | None) -> DataFrame:
    """Rows whose prompt has max_length tokens or fewer; without a limit, or for prompts that are lists of messages, all rows."""
    if max_length is None or rows.schema[prompt].dataType.typeName() != "string":
        return rows
    return rows.where(n_tokens <= max_length)
