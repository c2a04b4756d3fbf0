"""Roll-ups that put several counts together: campaigns, studies, evaluations, rollouts, trainings and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joining import join_measured
from .metrics import pass_at_k, quantiles
from .text import repetition


def counters(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """(part, name, n): how often each part has each of its values; nulls are not counted. One pass, and no more rows than a task has values are shuffled."""
    entries = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(p).alias("part"), c.cast("string").alias("name"))) for p, c in parts.items())))
    return rows.select(F.explode(entries).alias("x")).groupBy("x.part", "x.name").agg(F.count("*").alias("n"))


def campaign_report(plan: DataFrame, records: DataFrame, run: str = "run_id") -> DataFrame:
    """(part, name, n) of a campaign: planned, terminal and pending runs, executor errors, failed trajectories, outcomes, trajectory statuses and kinds of failure, and contract_ok (1 or 0).

    records: run, outcome, trajectory_status, failure_kind. A run failed if its executor did or its trajectory did not complete; a failure without a
    kind is unknown. The contract holds if nothing is pending and no executor failed. Records of runs that the plan lacks do not count.
    """
    known = join_measured(plan.select(run).distinct(), records.select(run, "outcome", "trajectory_status", "failure_kind", F.lit(True).alias("_there")), [run], "left")
    there = F.coalesce("_there", F.lit(False))
    broke, incomplete = F.coalesce(F.col("outcome") == "executor_error", F.lit(False)), F.coalesce(F.col("trajectory_status") != "completed", F.lit(False))
    sums = known.agg(F.count("*").alias("planned"), F.count_if(there).alias("terminal"), F.count_if(~there).alias("pending"), F.count_if(broke).alias("executor_errors"), F.count_if(incomplete).alias("failed_trajectories"))
    sums = sums.withColumn("contract_ok", ((F.col("pending") == 0) & (F.col("executor_errors") == 0)).cast("long"))
    totals = sums.select(F.explode(F.array(*(F.struct(F.lit("runs").alias("part"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in sums.columns))).alias("x")).select("x.*")
    return totals.union(counters(known, {"outcome": F.col("outcome"), "trajectory_status": F.col("trajectory_status"), "failure_kind": F.when(broke | incomplete, F.coalesce("failure_kind", F.lit("unknown")))}))


def study_report(children: DataFrame, counts: list[str]) -> DataFrame:
    """One row over the verified experiments of a study: the sums of `counts`, n_children, n_failed, first_failed, and issue, which is null if all are ok.

    children: source, ok, and the counts.
    """
    bad = ~F.coalesce(F.col("ok"), F.lit(False))
    out = children.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts), F.count("*").alias("n_children"), F.count_if(bad).alias("n_failed"), F.min(F.when(bad, F.col("source"))).alias("first_failed"))
    return out.withColumn("issue", F.when(F.col("n_failed") > 0, "study_child_verification_failed"))


def tool_name_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """sample_count, parse_rate, tool_name_accuracy and argument_exact_match_rate of cases (parse_ok, tool_name_ok, arguments_exact_match); rates over no cases are 0."""
    n = F.greatest(F.count("*"), F.lit(1))
    rate = lambda c: (F.count_if(c) / n)
    return cases.groupBy(*by).agg(F.count("*").alias("sample_count"), rate("parse_ok").alias("parse_rate"), rate("tool_name_ok").alias("tool_name_accuracy"), rate("arguments_exact_match").alias("argument_exact_match_rate"))


def evaluation_metrics(rows: DataFrame, dataset: str, group: str, reward: str, truncated: str, ks: tuple[int, ...]) -> DataFrame:
    """A row for each dataset: n, mean_reward, truncated_ratio, and pass_k for each k: the mean over its groups of tries, a reward of 1 being right."""
    tries = rows.groupBy(dataset, group).agg(F.count("*").alias("_n"), F.count_if(F.col(reward) == 1).alias("_right"), F.sum(reward).alias("_sum"), F.count_if(F.col(truncated)).alias("_cut"))
    n = F.sum("_n")
    return tries.groupBy(dataset).agg(n.alias("n"), (F.sum("_sum") / n).alias("mean_reward"), (F.sum("_cut") / n).alias("truncated_ratio"), *(F.avg(pass_at_k(tries, "_n", "_right", k)).alias(f"pass_{k}") for k in ks))


def rollout_metrics(rows: DataFrame, length: str, text: str, truncated: Column, *by: str) -> DataFrame:
    """n, the mean, median, largest and least length, repetition_frac and truncated_ratio of samples."""
    looped = repetition(F.col(text))["repeated"]
    whole = rows.withColumn("_loop", looped.cast("int")).groupBy(*by).agg(F.count("*").alias("n"), (F.sum(length) / F.count(length)).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min"), F.avg("_loop").alias("repetition_frac"), F.avg(truncated.cast("int")).alias("truncated_ratio"))
    middle = quantiles(rows, length, {"median": 0.5}, *by).drop("n")
    return join_measured(whole, middle, list(by), "left") if by else whole.crossJoin(middle)


def multi_turn_metrics(rows: DataFrame, mask: str, rounds: str, max_length: int, *by: str) -> DataFrame:
    """Of masks as wide as their responses: the mean, largest and least length, with and without what is masked out, the share of max_length or more, and the same of rounds."""
    lengths = {"raw": F.size(mask).cast("double"), "trained": F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m).cast("double"), "rounds": F.col(rounds).cast("double")}
    out = [f(c).alias(f"{n}_{w}") for n, c in lengths.items() for w, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return rows.groupBy(*by).agg(*out, F.avg((lengths["raw"] >= max_length).cast("int")).alias("clip_ratio"))


def training_report(steps: DataFrame, *by: str) -> DataFrame:
    """num_steps, final_loss (of the last step), average_loss, examples_seen, and duration_seconds from the first step's start to the last one's end. steps: step, loss, examples, started, ended (seconds)."""
    return steps.groupBy(*by).agg(F.count("*").alias("num_steps"), F.max_by("loss", "step").alias("final_loss"), F.avg("loss").alias("average_loss"), F.sum("examples").alias("examples_seen"), (F.max("ended") - F.min("started")).alias("duration_seconds"))


def credibility_bundle(audit: DataFrame, statuses: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row of a bundle: the counts of the audit (one row), n_ of each status of runs (status, n), pass_rate, each gate (a condition on these) and credible, whether all hold."""
    totals = statuses.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    both = audit.crossJoin(totals).withColumn("pass_rate", F.coalesce(F.try_divide(F.col("passed_run_count").cast("double"), F.col("run_count")), F.lit(0.0)))
    held = both.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in gates.items()})
    credible = F.lit(True)
    for k in gates:
        credible &= F.col(k)
    return held.withColumn("credible", credible)
