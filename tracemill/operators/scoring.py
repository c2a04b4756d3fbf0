"""Scores of tagged answers, nested values, secret keys, run identity and retention."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalized_answer


def tagged(text: Column, tag: str) -> Column:
    """The trimmed contents of every <tag>...</tag>."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(x))


def exact_match(text: Column, golden: Column, valid: Column, structure: float = 0.2, final: float = 0.1, retrieval: float = 0.1, score: float = 1.0) -> Column:
    """The score of a solution against golden answers.

    The answer is the last tagged one if there are two or more. A right answer scores 1, or less the structure's share
    if the text is not well formed; otherwise a well-formed text earns its structure and, if a
    retrieved block holds a golden answer, the retrieval; a wrong answer in another text earns `final`.
    """
    answers = tagged(text, "answer")
    answer = F.when(F.size(answers) > 1, F.element_at(answers, -1))
    wanted = F.transform(golden, lambda g: normalized_answer(g))
    blocks = F.transform(tagged(text, "information"), lambda b: normalized_answer(b))
    retrieved = valid & F.exists(blocks, lambda b: F.exists(wanted, lambda g: F.contains(b, g)))
    formed = F.when(retrieved, structure + retrieval).otherwise(structure)
    right = F.coalesce(F.array_contains(wanted, normalized_answer(answer)), F.lit(False))
    return F.when(right, F.when(valid, score).otherwise(score - structure)).when(valid, formed).when(answer.isNull(), 0.0).otherwise(final)


def _nested(value, inside: bool = False) -> bool:
    if isinstance(value, dict):
        return any(isinstance(v, dict) or _nested(v) for v in value.values())
    return isinstance(value, list) and any(_nested(v) for v in value)


def _secret(value, names: frozenset, path: str) -> str | None:
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, item in inner:
        here = f"{path}.{key}" if isinstance(value, dict) else f"{path}[{key}]"
        if isinstance(value, dict) and str(key).lower() in names:
            return here
        if found := _secret(item, names, here):
            return found
    return None


def has_nested(column: Column) -> Column:
    """Whether a JSON text holds an object within an object; false where it is no JSON."""

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return _nested(json.loads(v))
            except (TypeError, ValueError):
                return False

        return values.map(one).astype(bool)

    return check(column)


def secret_key(column: Column, names: list[str]) -> Column:
    """The path of the first key of a JSON text that is one of `names` in lower case; null without one."""
    wanted = frozenset(names)

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return _secret(json.loads(v), wanted, "metadata")
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return find(column)


def resumable(existing: DataFrame, new: DataFrame, run: str, identity: list[str]) -> DataFrame:
    """new rows of runs that may go on: a run whose identity differs from its earlier one, or that is finalised, raises."""
    kept = existing.groupBy(run).agg(*(F.max(c).alias(f"_{c}") for c in identity), F.bool_or("finalized").alias("_done"))
    both = new.join(kept, run, "left")
    same = F.lit(True)
    for c in identity:
        same &= F.coalesce(F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(True)) | F.col("_done").isNull()
    fault = F.when(F.coalesce("_done", F.lit(False)), "finalized run").when(~same, "another identity")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.col(run).cast("string")))).otherwise(F.col(run))
    return both.select(checked.alias(run), *(c for c in new.columns if c != run))


def cleanup_plan(artifacts: DataFrame, days: dict[str, int], age: Column, kind: str = "kind") -> DataFrame:
    """artifacts with disposition: expired beyond the days of their kind, kept within them, unknown for other kinds."""
    limit = F.lit(None).cast("int")
    for name, n in days.items():
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
    return artifacts.withColumn("disposition", F.when(limit.isNull(), "unknown").when(age > limit, "expired").otherwise("kept"))


def rendered(actions: DataFrame, events: DataFrame, profiles: DataFrame, trace: str, seq: str) -> DataFrame:
    """Every action under every profile, with the number of its trace's events before it; profiles is a small dimension table."""
    from pyspark.sql import Window

    both = actions.select(trace, seq, F.lit(True).alias("_action")).unionByName(events.select(trace, seq, F.lit(False).alias("_action")))
    before = Window.partitionBy(trace).orderBy(seq).rangeBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("n_context", F.count_if(~F.col("_action")).over(before)).where("_action").drop("_action")
    return counted.crossJoin(F.broadcast(profiles))


def advantages(kind: str, reward: Column, group_mean: Column, group_std: Column, kl: Column, beta: float) -> Column:
    """The advantage by estimator: grpo (normalised in the group), reinforce_baseline (less the mean) or distillation (minus the divergence)."""
    if kind == "grpo":
        return (reward - group_mean) / (group_std + 1e-6)
    if kind == "reinforce_baseline":
        return reward - group_mean - beta * kl
    if kind == "distillation":
        return -beta * kl
    raise ValueError(kind)


def value_loss(value: Column, old: Column, target: Column, clip: float) -> Column:
    """Half the larger squared error of the value and of the value kept within clip of the old one."""
    cut = F.greatest(old - clip, F.least(old + clip, value))
    return 0.5 * F.greatest((value - target) * (value - target), (cut - target) * (cut - target))
