"""Computation along an order: states, normalisation, intervals, spans and trimmed histories."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import global_row_number
from ..functions.storage import checkpointed


def recovery_flags(rows: DataFrame, key: str, order: str, failed: Column, revised: Column, passed: Column) -> DataFrame:
    """rows with revised_after and passed_after: whether the event follows a failure; a row's own failure is not before it.

    A row follows a failure if it comes after its key's first, so one minimum a key is joined. The minima are fixed
    first, so that the join deals out both sides anew and can split a key with many rows.
    """
    first = checkpointed(rows.groupBy(F.col(key).alias("_k")).agg(F.min(F.when(failed, F.col(order))).alias("_first")))
    joined = rows.join(first, rows[key].eqNullSafe(first["_k"]), "left")
    seen = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return joined.withColumns({"revised_after": revised & seen, "passed_after": passed & seen}).drop("_k", "_first")


def unrecovered(rows: DataFrame, key: str, order: str, failed: Column, ok: Column) -> DataFrame:
    """Failures that no success follows: those after their key's last success, or of a key without one."""
    last = checkpointed(rows.groupBy(F.col(key).alias("_k")).agg(F.max(F.when(ok, F.col(order))).alias("_last")))
    failures = rows.where(failed)
    return failures.join(last, failures[key].eqNullSafe(last["_k"]), "left").where(F.col("_last").isNull() | (F.col(order) >= F.col("_last"))).drop("_k", "_last")


def unit_normalized(rows: DataFrame, group: str, value: str, eps: float = 1e-8) -> DataFrame:
    """rows with `normalized`: only values in [0, 1] take part, by the population deviation; groups of zeros stay, groups without variance become 0."""
    w = Window.partitionBy(group)
    v = F.col(value)
    valid = F.when((v >= 0) & (v <= 1), v)
    mean, std = F.avg(valid).over(w), F.stddev_pop(valid).over(w)
    lowest, highest = F.min(valid).over(w), F.max(valid).over(w)
    out = F.when(valid.isNull() | ((lowest == 0) & (highest == 0)), v).when(std < eps, F.lit(0.0)).otherwise((v - mean) / (std + eps))
    return rows.withColumn("normalized", out)


def newest_groups(rows: DataFrame, group: str, time: str, n: int) -> DataFrame:
    """The n groups with the latest time, latest first; a missing time counts as the earliest."""
    newest = rows.groupBy(group).agg(F.max(time).alias("newest"))
    return newest.orderBy(F.desc_nulls_last("newest"), group).limit(n)


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals of each key joined where they overlap or touch: key, start, end, n."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def gaps(merged: DataFrame, key: str) -> DataFrame:
    """The free time between merged intervals, where there is any."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return merged.select(key, F.col("end").alias("gap_start"), following.alias("gap_end")).where("gap_end > gap_start")


def full_steps(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with `step`, for each `size` in order; an incomplete last step is left out."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("step", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.withColumn("_n", F.count("*").over(Window.partitionBy(key, "step"))).where(F.col("_n") == size).drop("_n")


def paired_spans(events: DataFrame) -> DataFrame:
    """Start and end events joined by span_id, with a kind: closed, open (no end) or orphan (no start).

    events has trace_id, span_id, type (span_start, span_end) and ts. An open span ends at the next start of
    its trace, or else at the trace's last event.
    """
    t = lambda kind: F.when(F.col("type") == kind, F.col("ts"))
    spans = events.where(F.col("span_id").isNotNull()).groupBy("trace_id", "span_id").agg(F.min(t("span_start")).alias("start"), F.max(t("span_end")).alias("end"), F.first("parent_span_id", ignorenulls=True).alias("parent_span_id"))
    kind = F.when(F.col("start").isNull(), "orphan").when(F.col("end").isNull(), "open").otherwise("closed")
    last = events.groupBy("trace_id").agg(F.max("ts").alias("_last"))
    following = F.min("start").over(Window.partitionBy("trace_id").orderBy("start").rangeBetween(1, Window.unboundedFollowing))
    return spans.withColumn("kind", kind).withColumn("_next", F.when(F.col("start").isNotNull(), following)).join(last, "trace_id").withColumn("end", F.coalesce("end", "_next", "_last")).drop("_next", "_last")


def tail_window(rows: DataFrame, key: str, order: str, role: str, tokens: str, max_messages: int, max_tokens: int) -> DataFrame:
    """System and user rows, then the newest others while both budgets hold; a row that is too large is passed over."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        pinned = pdf[role].isin(["system", "user"])
        count, used = int(pinned.sum()), int(pdf.loc[pinned, tokens].sum())
        chosen = pinned.copy()
        for i in reversed(range(len(pdf))):
            size = int(pdf[tokens].iloc[i])
            if not pinned.iloc[i] and count + 1 <= max_messages and used + size <= max_tokens:
                chosen.iloc[i] = True
                count, used = count + 1, used + size
        return pdf[chosen]

    return rows.groupBy(key).applyInPandas(keep, rows.schema)


def compacted_turns(rows: DataFrame, key: str, order: str, role: str, tokens: str, max_messages: int, max_tokens: int, summary_tokens: int, keep_from_end: int = 1) -> DataFrame:
    """Oldest turns replaced by one summary row until both budgets hold: key, order, role, tokens, is_summary.

    A turn is an assistant row and what follows it up to the next one; rows before the first turn stay, and so do
    the last keep_from_end turns. The summary stands where the first removed row was.
    """

    def compact(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True).assign(is_summary=False)
        turn = (pdf[role] == "assistant").cumsum()
        last = int(turn.max()) if len(pdf) else 0
        count, used = len(pdf), int(pdf[tokens].sum())
        by_turn = pdf.groupby(turn)[tokens].agg(["size", "sum"])
        removed = 0
        while removed < last - keep_from_end:
            extra = 1 if removed else 0
            if count + extra <= max_messages and used + extra * summary_tokens <= max_tokens:
                break
            removed += 1
            count, used = count - int(by_turn["size"][removed]), used - int(by_turn["sum"][removed])
        if not removed:
            return pdf
        gone = (turn > 0) & (turn <= removed)
        note = pdf[gone].iloc[[0]].assign(is_summary=True, **{role: "user", tokens: summary_tokens})
        return pd.concat([pdf[~gone], note]).sort_values(order, kind="stable")

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(key).applyInPandas(compact, f"{kinds}, is_summary boolean")


def duplicate_groups(rows: DataFrame, path: str, size: str, digest: str) -> DataFrame:
    """Groups of more than one row of equal size and digest: duplicate_id (dup-00001 on, by the group's first path), n, redundant bytes, first path.

    `path` is an integer key, so that groups are numbered by ranges of it.
    """
    groups = rows.groupBy(size, digest).agg(F.count("*").alias("n"), F.min(path).alias("first_path")).where("n > 1")
    numbered = global_row_number(groups, ["first_path"], "number")
    return numbered.select(size, digest, "n", "first_path", F.format_string("dup-%05d", "number").alias("duplicate_id"), (F.col(size) * (F.col("n") - 1)).alias("redundant_bytes"))


def span_tree(events: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(trace_id, span_id, parent_span_id, kind, start, end, clipped_by, depth) of nested spans.

    events has trace_id, span_id, parent_span_id, type (span_start, span_end) and ts, an integer. An open span ends at the least of
    the trace's last event, the next start of a span with the same parent, and the end of its nearest closed
    ancestor, as far as these lie after its start; clipped_by says which. An end without a start is an orphan. depth
    counts the ancestors that the trace knows; spans on or below a ring of parents have depth 0. Ancestors are
    found by doubling: each round joins the spans whose pointer has not come to an end with their pointer's pointer, so a trace
    stays spread over tasks and the rounds grow with the logarithm of the depth, or, with rings, of the largest trace.
    """
    t = lambda kind: F.when(F.col("type") == kind, F.col("ts"))
    parent = F.min_by("parent_span_id", F.when(F.col("type") == "span_start", 0).otherwise(1))
    spans = events.where(F.col("span_id").isNotNull()).groupBy("trace_id", "span_id").agg(F.min(t("span_start")).alias("start"), F.max(t("span_end")).alias("closed"), parent.alias("parent_span_id"))
    last = events.groupBy("trace_id").agg(F.max("ts").alias("_last"))
    started = checkpointed(spans.where("start is not null"))
    # hop: the ancestor that the pointer stands at; up: how many levels that is; near: the end of the nearest closed ancestor so far.
    known = started.select("trace_id", F.col("span_id").alias("_p"), F.col("closed").alias("_closed"), F.lit(True).alias("_is"))
    at = started.select("trace_id", "span_id", F.col("parent_span_id").alias("_p")).join(known, ["trace_id", "_p"], "left")
    here = checkpointed(at.select("trace_id", "span_id", F.when(F.col("_is"), F.col("_p")).alias("hop"), F.when(F.col("_is"), 1).otherwise(0).cast("long").alias("up"), F.col("_closed").alias("near")))
    most = started.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    settled, moving = [here.where("hop is null")], here.where("hop is not null")
    for _ in range(max_rounds):
        levels = moving.agg(F.min("up")).first()[0]
        if levels is None or levels > most:
            break  # more levels than a trace has spans: what is left runs in rings
        ahead = reduce(DataFrame.unionAll, settled, moving).select("trace_id", F.col("span_id").alias("hop"), F.col("hop").alias("_hop"), F.col("up").alias("_up"), F.col("near").alias("_near"))
        joined = moving.join(ahead, ["trace_id", "hop"], "left")
        moved = checkpointed(joined.select("trace_id", "span_id", F.col("_hop").alias("hop"), (F.col("up") + F.coalesce("_up", F.lit(0))).alias("up"), F.coalesce("near", "_near").alias("near")))
        settled, moving = [*settled, moved.where("hop is null")], moved.where("hop is not null")
    here = reduce(DataFrame.unionAll, settled, moving)
    ends = here.select("trace_id", "span_id", F.when(F.col("hop").isNull(), F.col("up")).otherwise(0).alias("depth"), "near")
    group = Window.partitionBy("trace_id", "parent_span_id").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    shown = started.withColumn("_next", F.min("start").over(group)).join(last, "trace_id").join(ends, ["trace_id", "span_id"])
    after = lambda c: F.when(F.col(c) > F.col("start"), F.col(c))
    options = F.array_compact(F.array(*(F.when(after(c).isNotNull(), F.struct(after(c).alias("at"), F.lit(i).alias("rank"), F.lit(name).alias("by"))) for i, (c, name) in enumerate((("_last", "row_end"), ("_next", "next_sibling_start"), ("near", "ancestor_end"))))))
    best = F.array_min(options)
    clip = F.when(F.col("closed").isNull(), F.coalesce(best["by"], F.lit("self")))
    whole = shown.select("trace_id", "span_id", "parent_span_id", F.when(F.col("closed").isNull(), "open").otherwise("closed").alias("kind"), "start", F.coalesce("closed", best["at"], "start").alias("end"), clip.alias("clipped_by"), "depth")
    orphans = spans.where("start is null").select("trace_id", "span_id", "parent_span_id", F.lit("orphan").alias("kind"), "start", F.col("closed").alias("end"), F.lit(None).cast("string").alias("clipped_by"))
    over = ends.select("trace_id", F.col("span_id").alias("parent_span_id"), "depth")
    return whole.unionByName(orphans.join(over, ["trace_id", "parent_span_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))))
