"""Histories that were compacted: their lineage, and the messages that stood before.

A request context names the retained entries that it shows. Once a history is compacted, one of them is a
summary, which keeps the ids of its sources and their places in the trajectory.

contexts: run_id, context_id, turn_index, active, record_id, summary_id, carried_id, selected (array of entry ids).
retained: run_id, entry_id, turn_index, source_kind, control_kind, record_id, source_ids and source_indices (arrays),
source_index, role, text. Of entries that repeat an id the one with the greatest turn_index counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joining import join_measured

KEY = ["run_id", "context_id"]


def _unique(retained: DataFrame) -> DataFrame:
    columns = [c for c in retained.columns if c not in ("run_id", "entry_id")]
    return retained.groupBy("run_id", "entry_id").agg(F.max_by(F.struct(*columns), F.coalesce("turn_index", F.lit(-1))).alias("_e")).select("run_id", "entry_id", "_e.*")


def _entry(rows: DataFrame, retained: DataFrame, id_column: str, name: str) -> DataFrame:
    """rows with the retained entry that id_column names, as a struct called name; null where there is none."""
    side = retained.select("run_id", F.col("entry_id").alias(id_column), F.struct("source_kind", "record_id", "source_ids", "source_indices").alias(name))
    return join_measured(rows, side, ["run_id", id_column], "left")


def lineage(contexts: DataFrame, retained: DataFrame) -> DataFrame:
    """(run_id, context_id, turn_index, record_id, artifact_id, source_ids, errors, ok) of every context with an active replacement record.

    errors, in order: summary_missing, summary_kind, summary_record, carried_missing, carried_kind, carried_record,
    artifact_missing, artifact_ambiguous (exactly one compaction artifact belongs to the context's turn),
    source_missing:id and source_kind:id for each source, summary_not_selected, carried_selected.
    """
    entries = _unique(retained)
    own = contexts.where(F.coalesce("active", F.lit(False)) & F.col("record_id").isNotNull())
    own = _entry(_entry(own, entries, "summary_id", "_s"), entries, "carried_id", "_c")
    artifacts = retained.where("source_kind = 'history_control' and control_kind = 'compaction_artifact'").groupBy("run_id", "turn_index").agg(F.count("*").alias("_n"), F.min("entry_id").alias("_a"))
    own = join_measured(own, artifacts, ["run_id", "turn_index"], "left")
    # Sources are checked as rows, so that a summary of many sources is spread.
    sources = own.select("run_id", "context_id", F.posexplode(F.coalesce("_s.source_ids", F.array().cast("array<string>"))).alias("at", "entry_id"))
    kinds = entries.select("run_id", "entry_id", F.lit(True).alias("_there"), F.col("source_kind").alias("_kind"))
    met = join_measured(sources, kinds, ["run_id", "entry_id"], "left")
    fault = F.when(F.col("_there").isNull(), F.concat(F.lit("source_missing:"), F.coalesce("entry_id", F.lit("")))).when(~F.col("_kind").eqNullSafe("source_message"), F.concat(F.lit("source_kind:"), "entry_id"))
    bad = met.withColumn("_f", fault).where("_f is not null").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_f"))), lambda x: x["_f"]).alias("_sources"))
    own = join_measured(own, bad, KEY, "left")

    def sided(entry: str, word: str, kind: str) -> list[Column]:
        there = F.col(entry).isNotNull()
        return [F.when(~there, f"{word}_missing"), F.when(there & ~F.col(f"{entry}.source_kind").eqNullSafe(kind), f"{word}_kind"), F.when(there & ~F.col(f"{entry}.record_id").eqNullSafe(F.col("record_id")), f"{word}_record")]

    n = F.coalesce("_n", F.lit(0))
    holds = lambda c: F.coalesce(F.exists("selected", lambda x: x.eqNullSafe(F.col(c))), F.lit(False))
    early = F.array(*sided("_s", "summary", "replacement_summary"), *sided("_c", "carried", "carry_forward_state"), F.when(n == 0, "artifact_missing").when(n > 1, "artifact_ambiguous"))
    late = F.array(F.when(~holds("summary_id"), "summary_not_selected"), F.when(F.col("carried_id").isNotNull() & holds("carried_id"), "carried_selected"))
    errors = F.array_compact(F.concat(early, F.coalesce("_sources", F.array().cast("array<string>")), late))
    out = own.select(*KEY, "turn_index", "record_id", F.when(n == 1, F.col("_a")).alias("artifact_id"), F.coalesce("_s.source_ids", F.array().cast("array<string>")).alias("source_ids"), errors.alias("errors"))
    return out.withColumn("ok", F.size("errors") == 0)


def _messages(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (KEY, at, entry_id, index, needs_index) with the entries' messages, in order, and a fault where there is none."""
    side = entries.select("run_id", "entry_id", F.lit(True).alias("_there"), "source_index", "role", "text")
    met = join_measured(wanted, side, ["run_id", "entry_id"], "left")
    fault = F.when(F.col("_there").isNull(), "entry_missing").when(F.col("needs_index") & F.col("source_index").isNull(), "no_source_index").when(F.col("role").isNull(), "no_message")
    return met.select(*KEY, "at", F.when(F.col("needs_index"), F.col("source_index")).otherwise(F.coalesce("index", "at")).alias("index"), "entry_id", "role", "text", fault.alias("fault"))


def _placed(rows: DataFrame) -> DataFrame:
    """One context's messages in the order of their places; entries of one place stay in the order in which they came."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("index").asc_nulls_last(), "at")) - 1).drop("index", "at")


def selected_messages(contexts: DataFrame, retained: DataFrame) -> DataFrame:
    """(run_id, context_id, place, entry_id, role, text, fault): what each context shows, in its own order."""
    wanted = contexts.select(*KEY, F.posexplode("selected").alias("at", "entry_id")).withColumns({"index": F.lit(None).cast("int"), "needs_index": F.lit(False)})
    return _placed(_messages(wanted, _unique(retained)))


def replayed(contexts: DataFrame, retained: DataFrame, strict: bool = False) -> DataFrame:
    """(run_id, context_id, place, entry_id, role, text, fault): the messages of each context as they stood before compaction.

    The summary is replaced by its sources, and all are ordered by their places in the trajectory; a context
    without an active replacement shows what it selects. fault is no_summary, summary_missing or summary_uneven (as many
    sources as places are needed), each a row of its own, or entry_missing, no_source_index or no_message of an entry.
    With strict the first fault that is met raises.
    """
    entries = _unique(retained)
    active = F.coalesce("active", F.lit(False))
    own = _entry(contexts.where(active), entries, "summary_id", "_s")
    uneven = F.size(F.coalesce("_s.source_ids", F.array().cast("array<string>"))) != F.size(F.coalesce("_s.source_indices", F.array().cast("array<int>")))
    own = own.withColumn("fault", F.when(F.col("summary_id").isNull(), "no_summary").when(F.col("_s").isNull(), "summary_missing").when(uneven, "summary_uneven"))
    none = F.lit(None)
    faulty = own.where("fault is not null").select(*KEY, F.lit(0).alias("place"), F.col("summary_id").alias("entry_id"), none.cast("string").alias("role"), none.cast("string").alias("text"), "fault")
    fine = own.where("fault is null")
    stay = fine.select(*KEY, "summary_id", F.posexplode("selected").alias("at", "entry_id")).where(~F.col("entry_id").eqNullSafe(F.col("summary_id"))).select(*KEY, "at", "entry_id", none.cast("int").alias("index"), F.lit(True).alias("needs_index"))
    back = fine.select(*KEY, F.size("selected").alias("_n"), F.posexplode(F.arrays_zip(F.col("_s.source_ids").alias("id"), F.col("_s.source_indices").alias("index"))).alias("at", "x")).select(*KEY, (F.col("at") + F.col("_n")).alias("at"), F.col("x.id").alias("entry_id"), F.col("x.index").alias("index"), F.lit(False).alias("needs_index"))
    plain = contexts.where(~active).select(*KEY, F.posexplode("selected").alias("at", "entry_id")).select(*KEY, "at", "entry_id", none.cast("int").alias("index"), F.lit(False).alias("needs_index"))
    rows = _placed(_messages(stay.union(back).union(plain), entries)).select(*KEY, "place", "entry_id", "role", "text", "fault").union(faulty)
    if strict:
        rows = rows.withColumn("place", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(" ", "fault", F.col("run_id").cast("string"), F.col("context_id").cast("string"), "entry_id")).cast("int")).otherwise(F.col("place")))
    return rows


def reconciliation(contexts: DataFrame, retained: DataFrame) -> DataFrame:
    """lineage() with the roles of selected and of replayed messages, both empty where a message is missing, and the replay's faults among the errors."""

    def told(rows: DataFrame, name: str) -> DataFrame:
        faults = F.transform(F.array_sort(F.collect_list(F.when(F.col("fault").isNotNull(), F.struct("place", F.concat_ws(":", "fault", "entry_id").alias("f"))))), lambda x: x["f"])
        roles = F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: x["role"])
        found = rows.groupBy(*KEY).agg(roles.alias(name), faults.alias(f"_{name}"))
        return found.withColumn(name, F.when(F.size(f"_{name}") > 0, F.array().cast("array<string>")).otherwise(F.col(name)))

    empty = F.array().cast("array<string>")
    both = join_measured(join_measured(lineage(contexts, retained), told(selected_messages(contexts, retained), "selected_roles"), KEY), told(replayed(contexts, retained), "replayed_roles"), KEY)
    errors = F.concat("errors", F.slice(F.coalesce("_selected_roles", empty), 1, 1), F.slice(F.coalesce("_replayed_roles", empty), 1, 1))
    full = both.withColumn("errors", errors).withColumns({c: F.coalesce(c, empty) for c in ("selected_roles", "replayed_roles")})
    return full.drop("_selected_roles", "_replayed_roles").withColumn("ok", F.size("errors") == 0)
