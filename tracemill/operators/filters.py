"""Row filters, samples and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunFilter:
    """What a run must be to be kept; None asks for nothing. A run without a verdict counts as not passed."""

    statuses: tuple[str, ...] | None = None
    include_failed: bool = True
    verifier_passed: bool | None = None
    min_reward: float | None = None
    tasks: tuple[str, ...] | None = None
    profiles: tuple[str, ...] | None = None

    def condition(self, status="status", passed="passed", reward="reward", task="task_id", profile="tool_profile_id") -> Column:
        keep = F.lit(True)
        if self.statuses is not None:
            keep &= F.col(status).isin(*self.statuses)
        if not self.include_failed:
            keep &= F.col(status) == "completed"
        if self.verifier_passed is not None:
            keep &= F.coalesce(F.col(passed), F.lit(False)) == self.verifier_passed
        if self.min_reward is not None:
            keep &= F.col(reward) >= self.min_reward
        if self.tasks is not None:
            keep &= F.col(task).isin(*self.tasks)
        if self.profiles is not None:
            keep &= F.col(profile).isin(*self.profiles)
        return keep


def varied_groups(rows: DataFrame, group: str, value: str, least: float = 1e-6) -> DataFrame:
    """(group, n, std, kept, reason): groups are kept if the sample deviation of the value exceeds `least`; one row alone has none."""
    agg = rows.groupBy(group).agg(F.count("*").alias("n"), F.stddev_samp(value).alias("std"), F.min(value).alias("lowest"))
    kept = F.coalesce(F.col("std") > least, F.lit(False))
    return agg.select(group, "n", "std", kept.alias("kept"), F.when(~kept, F.concat(F.lit("zero_std_"), F.col("lowest").cast("string"))).alias("reason"))


def first_groups(kept: DataFrame, order: str, target: int) -> DataFrame:
    """The first `target` kept groups by order."""
    return kept.orderBy(order).limit(target)


def trim_to_multiple(rows: DataFrame, numbered: str, n: int, size: int) -> DataFrame:
    """Rows numbered from 1 up to the largest multiple of size; none left raises."""
    whole = n // size * size
    if not whole:
        raise ValueError(f"{n} rows are fewer than {size}")
    return rows.where(F.col(numbered) <= whole)


def head_and_tail(rows: DataFrame, numbered: str, n: int, k: int) -> DataFrame:
    """The first k // 2 and the last k - k // 2 of n rows numbered from 1; k = 0 keeps all."""
    if k == 0:
        return rows
    return rows.where((F.col(numbered) <= k // 2) | (F.col(numbered) > n - (k - k // 2)))


def first_of_each(rows: DataFrame, group: Column, order: str, k: int) -> DataFrame:
    """The first k rows of each group; a missing group reads <missing>."""
    named = rows.withColumn("group", F.coalesce(group, F.lit("<missing>")))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(order))).where(F.col("place") <= k)


def skip_occurrences(rows: DataFrame, skips: DataFrame, key: str, order: str) -> DataFrame:
    """rows without one occurrence, the first by order, for each occurrence of the key in skips."""
    n = skips.groupBy(key).agg(F.count("*").alias("_n"))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return numbered.join(n, key, "left").where(F.col("_at") > F.coalesce("_n", F.lit(0))).drop("_at", "_n")


def glob_condition(path: Column, allowed: list[str], denied: list[str]) -> Column:
    """Deny first; no allowed patterns allow all; paths that climb out are refused."""

    def pattern(glob: str) -> str:
        special = {"*": ".*", "?": "."}
        return "^" + "".join(special.get(c, "\\" + c if c in ".^$+{}[]()|\\" else c) for c in glob) + "$"

    any_of = lambda globs: F.lit(False) if not globs else F.greatest(F.lit(False), *(path.rlike(pattern(g)) for g in globs))
    climbs = path.rlike(r"(^|/)\.\.(/|$)") | path.startswith("/")
    return ~climbs & ~any_of(denied) & (F.lit(True) if not allowed else any_of(allowed))


def reason_counts(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the first rule that drops them; `kept` is those that none drops."""
    reason = F.lit("kept")
    for name, rule in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
