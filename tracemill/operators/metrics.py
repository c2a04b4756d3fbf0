"""Summaries of runs, rewards, groups and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joining import join_measured
from ..functions.numbering import global_row_number


def exact_sum(value: str | Column) -> Column:
    """A sum of cents that does not depend on the order of rows."""
    return F.sum((F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")).cast("double")


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """min, max, mean, total and count; zeros where there are no values."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.count(value)
    return rows.groupBy(*by).agg(zero(F.min(value).cast("double")).alias("min"), zero(F.max(value).cast("double")).alias("max"), zero(F.try_divide(exact_sum(value), n)).alias("mean"), zero(exact_sum(value)).alias("total"), n.alias("count"))


def bucket_counts(rows: DataFrame, column: str, names: list[str], *by: str) -> DataFrame:
    """One count for each name; other values are not counted."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(column) == n).alias(n) for n in names))


def merge_means(parts: DataFrame, mean: str, count: str, *by: str) -> DataFrame:
    """Means of parts merged by their counts; empty parts do not matter."""
    held = parts.where(F.col(count) > 0)
    return held.groupBy(*by).agg((F.sum(F.col(mean) * F.col(count)) / F.sum(count)).alias("mean"), F.sum(count).alias("count"))


def rates(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """The share of rows with each flag for every value of `by` and over all (by null, overall true)."""
    return rows.rollup(by).agg(F.count("*").alias("n"), *(F.avg(c.cast("int")).alias(k) for k, c in flags.items()), F.grouping(by).cast("boolean").alias("overall"))


def pass_at_k(groups: DataFrame, n: str, correct: str, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product, for a row of group counts; 1 if fewer than k are wrong."""
    wrong = F.col(n) - F.col(correct)
    product = F.aggregate(F.sequence(wrong + 1, F.col(n)), F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i))
    return F.when(wrong < k, 1.0).when(F.col(correct) == 0, 0.0).otherwise(1.0 - product)


def constant_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose values are all equal, counted by that value."""
    same = rows.groupBy(group).agg(F.min(value).alias("value"), F.max(value).alias("_hi")).where(F.col("value") == F.col("_hi"))
    return same.groupBy("value").agg(F.count("*").alias("n_groups"))


def shares(rows: DataFrame, category: str) -> DataFrame:
    counts = rows.groupBy(category).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all")))).select(category, "n", (F.col("n") / F.col("_all")).alias("share"))


def mean_of_longest(rows: DataFrame, size: str, value: str, *by: str) -> DataFrame:
    """The largest size and the mean value over all rows that tie for it."""
    top = rows.groupBy(*by).agg(F.max(size).alias("longest"))
    joined = rows.join(top, list(by)) if by else rows.crossJoin(F.broadcast(top))
    return joined.where(F.col(size) == F.col("longest")).groupBy(*by, "longest").agg(F.try_divide(exact_sum(value), F.count("*")).alias("mean"), F.count("*").alias("ties"))


def quantiles(rows: DataFrame, value: str, at: dict[str, float], *by: str) -> DataFrame:
    """Exact percentiles with linear interpolation; null values do not count.

    Rows are numbered in the order of group and value by range partitions, so a group that holds most rows is
    sorted in many tasks; of each group only the rows at its percentiles' places meet.
    """
    groups = list(by)
    held = rows.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    placed = global_row_number(held, [*groups, "_v"], "_rn")
    sizes = placed.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_rn").alias("_first"))
    ranked = join_measured(placed, sizes, groups, "inner") if groups else placed.crossJoin(F.broadcast(sizes))
    place = F.col("_rn") - F.col("_first")
    low = {k: F.floor(p * (F.col("n") - 1)) for k, p in at.items()}
    picked = ranked.where(reduce(lambda a, b: a | b, [(place == x) | (place == x + 1) for x in low.values()]))
    at_place = lambda x: F.max(F.when(place == x, F.col("_v")))
    parts = picked.groupBy(*groups, "n").agg(*(c for k, x in low.items() for c in (at_place(x).alias(f"_lo_{k}"), at_place(x + 1).alias(f"_hi_{k}"))))
    at_p = lambda p: p * (F.col("n") - 1)
    between = lambda k, p: F.when(F.col(f"_hi_{k}").isNull(), F.col(f"_lo_{k}")).otherwise((low[k] + 1 - at_p(p)) * F.col(f"_lo_{k}") + (at_p(p) - low[k]) * F.col(f"_hi_{k}"))
    return parts.select(*groups, "n", *(between(k, p).alias(k) for k, p in at.items()))


def cut_point_histogram(rows: DataFrame, value: str, limit: float, n: int) -> DataFrame:
    """How many values fall into each of n equal parts of [0, limit]; a value on a cut point belongs below, one beyond the limit nowhere."""
    bucket = F.greatest(F.lit(1), F.ceil(F.col(value) * n / limit)).cast("int")
    counts = rows.where(F.col(value) <= limit).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def failure_buckets(rows: DataFrame, run: str, rules: dict[str, Column]) -> DataFrame:
    """(bucket, run), each once: a run may fall into many buckets. Counted by bucket these are the buckets' sizes; the runs of one are not gathered in a row."""
    hit = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return rows.select(F.explode(hit).alias("bucket"), run).distinct()


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(1))


def whiten(rows: DataFrame, value: str, mask: str, keep_mean: bool = False, eps: float = 1e-8) -> DataFrame:
    """rows with `whitened`: the value less the masked mean, over the masked deviation, from sums over all rows, of differences from the mean."""
    m, v = F.col(mask), F.col(value)
    means = rows.agg(F.sum(m).alias("_n"), F.sum(v * m).alias("_s"))
    sums = rows.select(value, mask).crossJoin(F.broadcast(means)).groupBy("_n", "_s").agg(F.sum((v - F.try_divide("_s", "_n")) ** 2 * m).alias("_q"))
    mean = F.try_divide("_s", "_n")
    var = F.try_divide("_q", "_n")
    unbiased = F.when(F.col("_n") >= 2, var * F.col("_n") / (F.col("_n") - 1)).otherwise(var)
    out = (v - mean) / F.sqrt(unbiased + eps)
    checked = F.when(F.col("_n") == 0, F.raise_error(F.lit("the mask is empty"))).otherwise(out + mean if keep_mean else out)
    return rows.crossJoin(F.broadcast(sums)).withColumn("whitened", checked.cast("double")).drop("_n", "_s", "_q")


def first_by(order: str, value: str) -> Column:
    """The first non-null value by order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def flops_estimate(length: Column, layers: int, hidden: int, ffn: int, vocab: int, kv_share: float = 1.0) -> Column:
    """Multiply-adds, times two, of a forward pass over a sequence: projections, attention, feed-forward and output layer."""
    projections = length * (2.0 * hidden * hidden * (1 + kv_share))
    attention = length * length * (2.0 * hidden)
    feed = length * (3.0 * hidden * ffn)
    return 2.0 * (layers * (projections + attention + feed) + length * float(hidden * vocab))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, as often as they are missing on the other."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).union(after.exceptAll(before).withColumn("side", F.lit("added")))


def normalized(rows: DataFrame, group: str, value: str, population: bool = False, eps: float = 1e-6) -> Column:
    w = Window.partitionBy(group)
    std = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / (std + eps)


def markdown_row(*columns: str, decimals: dict[str, int]) -> Column:
    """A row of a table in Markdown: columns as they are, then those of `decimals` with a fixed number of decimals."""
    cells = [F.col(c).cast("string") for c in columns] + [F.format_string(f"%.{n}f", F.col(c)) for c, n in decimals.items()]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
