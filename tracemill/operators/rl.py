"""Arithmetic of reinforcement-learning batches on arrays, one row a sequence."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOUBLES = T.ArrayType(T.DoubleType())
_ADVANTAGES = T.StructType([T.StructField("advantage", _DOUBLES), T.StructField("ret", _DOUBLES)])


def _backwards(deltas: Sequence[float], decay: float) -> list[float]:
    """x = delta + decay * x from the end, in one pass."""
    out, ahead = [0.0] * len(deltas), 0.0
    for i in range(len(deltas) - 1, -1, -1):
        ahead = out[i] = deltas[i] + decay * ahead
    return out


def zip3(a: Column, b: Column, c: Column) -> Column:
    return F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def masked_array_mean(values: Column, mask: Column) -> Column:
    """Sum over the mask divided by its size, at least 1."""
    return total(F.zip_with(values, mask, lambda x, m: x * m)) / F.greatest(total(mask.cast("array<double>")), F.lit(1.0))


def discounted_returns(rewards: Column, gamma: float) -> Column:
    """g = r + gamma * g from the end; one pass over each array, in Arrow batches."""

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _backwards(r, gamma) for r in rows])

    return F.pandas_udf(run, _DOUBLES)(rewards)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Advantages A = d + gamma * lam * A' with d = r + gamma * V' - V, and returns A + V, in order; one pass over each array."""

    def run(all_r: pd.Series, all_v: pd.Series) -> pd.DataFrame:
        advantages, returns = [], []
        for r, v in zip(all_r, all_v, strict=True):
            if r is None or v is None:
                advantages.append(None)
                returns.append(None)
                continue
            ahead = [*v[1:], 0.0]
            a = _backwards([x + gamma * y - z for x, y, z in zip(r, ahead, v, strict=True)], gamma * lam)
            advantages.append(a)
            returns.append([x + y for x, y in zip(a, v, strict=True)])
        return pd.DataFrame({"advantage": advantages, "ret": returns})

    out = F.pandas_udf(run, _ADVANTAGES)(rewards, values)
    return F.arrays_zip(out["advantage"].alias("advantage"), out["ret"].alias("ret"))


def kl(log_ratio: Column, kind: str) -> Column:
    """Estimators of the divergence from log p - log q: k1, k2, k3 and low_var (k3 within 10)."""
    if kind == "k1":
        return log_ratio
    if kind == "k2":
        return log_ratio * log_ratio / 2.0
    k3 = F.exp(-log_ratio) - 1 + log_ratio
    if kind == "k3":
        return k3
    if kind == "low_var":
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), k3))
    raise ValueError(kind)


def clipped_loss(ratio: Column, advantage: Column, low: float, high: float, dual: float | None = None) -> tuple[Column, Column]:
    """The clipped policy loss and whether clipping took effect; dual bounds the loss of negative advantages."""
    plain, cut = -ratio * advantage, -F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio)) * advantage
    loss = F.greatest(plain, cut)
    if dual is not None:
        loss = F.when(advantage < 0, F.least(loss, -dual * advantage)).otherwise(loss)
    return loss, cut > plain


def importance_weight(log_ratio: Column, mode: str, low: float, high: float) -> Column:
    """exp(log_ratio), kept within 20, then truncated, clipped or zeroed outside the bounds."""
    w = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), log_ratio)))
    if mode == "truncate":
        return F.least(w, F.lit(high))
    if mode == "clip":
        return F.greatest(F.lit(low), F.least(w, F.lit(high)))
    if mode == "mask":
        return F.when((w >= low) & (w <= high), w).otherwise(0.0)
    raise ValueError(mode)


def sequence_mask(advantage: Column, sequence_kl: Column, limit: float) -> Column:
    """0 for sequences with a negative advantage that lie further off policy than the limit."""
    return F.when((advantage < 0) & (sequence_kl > limit), 0).otherwise(1)


def last_n(values: Column, n: Column) -> Column:
    """Without the first entry, the last n."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(n > 0, F.slice(rest, F.greatest(F.size(rest) - n + 1, F.lit(1)), n)).otherwise(F.slice(rest, F.lit(1), F.lit(0)))


def loss_report(tokens: DataFrame, sample: str, mask: Column, values: dict[str, Column], per_token: bool = False) -> DataFrame:
    """One row: n_samples, n_tokens (of the mask), and each value as the sum of its samples' masked means, or with per_token as its masked sum.

    A sample whose mask is empty counts as one of mean 0.
    """
    m = mask.cast("double")
    per = tokens.groupBy(sample).agg(F.sum(m).alias("_m"), *(F.sum(v * m).alias(n) for n, v in values.items()))
    share = {n: F.col(n) if per_token else F.col(n) / F.greatest(F.col("_m"), F.lit(1.0)) for n in values}
    return per.agg(F.count("*").alias("n_samples"), F.sum("_m").cast("long").alias("n_tokens"), *(F.sum(c).alias(n) for n, c in share.items()))


def policy_report(tokens: DataFrame, sample: str, mask: Column, new: Column, old: Column, advantage: Column, low: float, high: float, per_token: bool = False) -> DataFrame:
    """The clipped policy loss, the share of clipped tokens and the divergence (old less new log probability) of a batch, as loss_report() reduces them."""
    loss, clipped = clipped_loss(F.exp(new - old), advantage, low, high)
    return loss_report(tokens, sample, mask, {"pg_loss": loss, "pg_clipfrac": clipped.cast("double"), "ppo_kl": old - new}, per_token)


def sft_report(tokens: DataFrame, sample: str, mask: Column, log_prob: Column, per_token: bool = False) -> DataFrame:
    """The negative log likelihood of a batch, as loss_report() reduces it."""
    return loss_report(tokens, sample, mask, {"loss": -log_prob}, per_token)
