"""Compacted histories made of whole conversations, with every fault planted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H
from .registry import query, table


def _tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each conversation as a run whose first half (rounded up) a summary replaces; conv_id modulo 16 tells what is wrong with it."""
    c = table(spark, sf_dir, "conversations")
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("half", F.floor((F.col("n") + 1) / 2).cast("int")).withColumn("form", F.col("conv_id") % 16)
    form, null = F.col("form"), F.lit(None)
    name = lambda t: F.concat(F.lit("m"), t)
    strings, numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    said = c.join(sizes, "conv_id").where("not (form = 9 and turn = 0) and not (form = 13 and turn = n - 1)")
    messages = said.select(F.col("conv_id").alias("run_id"), name(F.col("turn")).alias("entry_id"), F.col("turn").cast("int").alias("turn_index"), F.when((form == 10) & (F.col("turn") == 0), "tool_output").otherwise("source_message").alias("source_kind"), null.cast("string").alias("control_kind"), null.cast("string").alias("record_id"), strings.alias("source_ids"), numbers.alias("source_indices"), F.when(~((form == 14) & (F.col("turn") == F.col("n") - 1)), F.col("turn").cast("int")).alias("source_index"), F.when(~((form == 15) & (F.col("turn") == 0)), F.col("role")).alias("role"), "text")
    turn = F.col("n").cast("int").alias("turn_index")
    places = F.sequence(F.lit(0), F.col("half") - 1)
    # Sources are listed backwards, so that only their places give the order.
    backwards = F.reverse(places)
    record = lambda k: F.when(form == k, F.lit("other")).otherwise(F.concat(F.lit("r"), F.col("conv_id").cast("string"))).alias("record_id")
    control = lambda entry, kind, what, rec, ids, at: sizes.select(F.col("conv_id").alias("run_id"), F.lit(entry).alias("entry_id"), turn, kind.alias("source_kind"), F.lit(what).cast("string").alias("control_kind"), rec, ids.alias("source_ids"), at.alias("source_indices"), null.cast("int").alias("source_index"), F.lit("user").alias("role"), F.lit("short").alias("text"), "form")
    summary = control("sum", F.when(form == 2, "source_message").otherwise("replacement_summary"), None, record(3), F.transform(backwards, lambda t: F.concat(F.lit("m"), t)), F.when(form == 12, F.slice(backwards, F.lit(1), F.col("half") - 1)).otherwise(backwards)).where("form <> 1")
    carried = control("car", F.when(form == 5, "x").otherwise("carry_forward_state"), None, record(6), strings, numbers).where("form <> 4")
    artifact = control("art", F.lit("history_control"), "compaction_artifact", null.cast("string").alias("record_id"), strings, numbers).where("form <> 7")
    second = artifact.where("form = 8").withColumn("entry_id", F.lit("art2"))
    retained = messages.unionByName(summary.unionByName(carried).unionByName(artifact).unionByName(second).drop("form"))
    rest = F.transform(F.filter(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda t: t >= F.col("half")), lambda t: F.concat(F.lit("m"), t))
    shown = F.concat(F.when(form == 11, F.array(F.lit("car"))).otherwise(F.array(F.lit("sum"))), rest)
    contexts = sizes.select(F.col("conv_id").alias("run_id"), F.lit("c").alias("context_id"), turn, (form != 0).alias("active"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("record_id"), F.lit("sum").alias("summary_id"), F.lit("car").alias("carried_id"), shown.alias("selected"))
    return contexts, retained


_SIZES = "s as (select conv_id, count(*) as n, cast((count(*) + 1) // 2 as bigint) as half, conv_id % 16 as form from conversations group by conv_id)"
_LINEAGE = "case form when 1 then ['summary_missing'] when 2 then ['summary_kind'] when 3 then ['summary_record'] when 4 then ['carried_missing'] when 5 then ['carried_kind'] when 6 then ['carried_record'] when 7 then ['artifact_missing'] when 8 then ['artifact_ambiguous'] when 9 then ['source_missing:m0'] when 10 then ['source_kind:m0'] when 11 then ['summary_not_selected', 'carried_selected'] when 13 then case when n - 1 < half then ['source_missing:m' || (n - 1)] else [] end else [] end"


@query(f"with {_SIZES} select conv_id as run_id, n as turn_index, case when form not in (7, 8) then 'art' end as artifact_id, case form when 1 then 0 else half end as n_sources, array_to_string({_LINEAGE}, ',') as errors, len({_LINEAGE}) = 0 as ok from s where form <> 0")
def op_j09_lineagereport(spark, sf_dir):
    """Summary, carried state, artifact and sources of each compacted conversation, with every rule's error planted."""
    found = H.lineage(*_tables(spark, sf_dir))
    return found.select("run_id", F.col("turn_index").cast("long").alias("turn_index"), "artifact_id", F.size("source_ids").cast("long").alias("n_sources"), F.array_join("errors", ",").alias("errors"), "ok")


@query(f"""with {_SIZES},
m as (select conv_id, turn, 'm' || turn as entry_id, role, text, form, half, n, case when form = 13 and turn = n - 1 then 'entry_missing' when form = 9 and turn = 0 then 'entry_missing' when form = 14 and turn = n - 1 and turn >= half then 'no_source_index' when form = 15 and turn = 0 then 'no_message' end as fault from conversations join s using (conv_id) where form not in (0, 1, 12) or (form = 0 and turn >= half)),
r as (select conv_id, case form when 0 then turn - half + 1 else turn end as place, entry_id, case when fault in ('entry_missing', 'no_message') then null else role end as role, case when fault = 'entry_missing' then null else text end as text, fault from m
union all select conv_id, 0, 'sum', 'user', 'short', null from s where form = 0
union all select conv_id, 0, 'sum', null, null, 'summary_missing' from s where form = 1
union all select conv_id, 0, 'sum', null, null, 'summary_uneven' from s where form = 12
union all select conv_id, n, 'car', 'user', 'short', 'no_source_index' from s where form = 11)
select conv_id as run_id, cast(place as int) as place, entry_id, role, text, fault from r""")
def op_j10_replay(spark, sf_dir):
    """The messages of each conversation before its first half became a summary, by the places that the summary keeps."""
    return H.replayed(*_tables(spark, sf_dir)).select("run_id", "place", "entry_id", "role", "text", "fault")


@query(f"""with {_SIZES},
e as (select *, {_LINEAGE} as lineage, case form when 1 then 'summary_missing:sum' when 12 then 'summary_uneven:sum' when 9 then 'entry_missing:m0' when 11 then 'no_source_index:car' when 13 then 'entry_missing:m' || (n - 1) when 14 then case when n - 1 >= half then 'no_source_index:m' || (n - 1) end when 15 then 'no_message:m0' end as replay_fault from s where form <> 0),
f as (select *, case when form = 1 then 'entry_missing:sum' when form = 13 and n - 1 >= half then 'entry_missing:m' || (n - 1) end as select_fault from e),
r as (select conv_id, string_agg(role, ',' order by turn) as roles, string_agg(case when turn >= half then role end, ',' order by turn) as late from conversations join s using (conv_id) group by conv_id)
select conv_id as run_id, case when select_fault is null then concat_ws(',', 'user', late) else '' end as selected_roles, case when replay_fault is null then roles else '' end as replayed_roles, concat_ws(',', nullif(array_to_string(lineage, ','), ''), select_fault, replay_fault) as errors, len(lineage) = 0 and select_fault is null and replay_fault is null as ok from f join r using (conv_id)""")
def op_j10_reconciliation(spark, sf_dir):
    """Lineage, shown and restored messages of each compacted conversation in one record."""
    found = H.reconciliation(*_tables(spark, sf_dir))
    return found.select("run_id", F.array_join("selected_roles", ",").alias("selected_roles"), F.array_join("replayed_roles", ",").alias("replayed_roles"), F.array_join("errors", ",").alias("errors"), "ok")
