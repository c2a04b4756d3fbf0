"""Projections of run records: defaults, provenance, content parts, training columns, tool catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one wins."""
    left, right = F.coalesce(left, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce(right, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def joined_parts(parts: Column) -> Column:
    """Text parts, without empty ones, on lines of their own."""
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def placeholder_parts(text: Column, mark: str, items: Column) -> Column:
    """Pieces of the text between marks, each with the item that follows it; as many marks as items or it raises."""
    pieces = F.split(text, mark, -1)
    bound = F.zip_with(pieces, items, lambda p, i: F.struct(p.alias("text"), i.alias("item")))
    return F.when(F.size(pieces) - 1 == F.size(items), bound).otherwise(F.raise_error(F.lit("the numbers of marks and items differ")))


def train_columns(rows: DataFrame, tokens: str, response_length: str, loss_mask: str, removed: str, status: str) -> DataFrame:
    """rows with a loss mask of the response's length (ones by default, zeros if removed) and truncated."""
    ones = F.array_repeat(F.lit(1), F.col(response_length).cast("int"))
    mask = F.when(F.col(removed), F.array_repeat(F.lit(0), F.col(response_length).cast("int"))).otherwise(F.coalesce(F.col(loss_mask), ones))
    return rows.withColumn(loss_mask, mask).withColumn("truncated", (F.col(status) == "truncated").cast("int"))


def response_window(tokens: Column, mask: Column) -> Column:
    """(response_length, loss_mask) from the first trainable token on; raises without one."""
    first = F.array_position(mask, 1)
    n = F.size(mask) - first + 1
    found = F.struct(n.cast("long").alias("response_length"), F.slice(mask, first.cast("int"), n.cast("int")).alias("loss_mask"))
    return F.when(first > 0, found).otherwise(F.raise_error(F.lit("no trainable token")))


def inverse_permutation(rows: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """Where each value of a permutation stands."""
    return rows.select(group, F.col(value).alias(place), F.col(place).alias(value))


def microbatch_plan(rows: DataFrame, rank: str, step: str, order: str, length: str, limit: int) -> DataFrame:
    """Micro-batches that each step needs: the largest first-fit count of its ranks."""
    from .tokens import first_fit_count

    lengths = rows.groupBy(step, rank).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, length))), lambda x: x[length]).alias("_l"))
    return lengths.select(step, rank, first_fit_count(F.col("_l"), limit).alias("n_micro")).withColumn("n_step", F.max("n_micro").over(Window.partitionBy(step)))


def stable_order(names: DataFrame, group: str, name: str, seed: str) -> DataFrame:
    """Names of each group in the order of a hash; an order that equals the old one is rotated by 1 + hash modulo (n - 1)."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(name)), 256)
    old = F.row_number().over(Window.partitionBy(group).orderBy(name))
    new = F.row_number().over(Window.partitionBy(group).orderBy(digest, name))
    w = Window.partitionBy(group)
    placed = names.withColumn("old", old).withColumn("new", new).withColumn("n", F.count("*").over(w))
    same = F.max((F.col("old") != F.col("new")).cast("int")).over(w) == 0
    turn = 1 + F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("long") % F.greatest(F.col("n") - 1, F.lit(1))
    return placed.withColumn("new", F.when(same & (F.col("n") > 1), F.pmod(F.col("new") - 1 + turn, F.col("n")) + 1).otherwise(F.col("new")).cast("int")).drop("n")


def reconstructed(contexts: DataFrame, entries: DataFrame, context: str, ids: str, entry: str, text: str) -> DataFrame:
    """The texts of each context's entries in its own order, and how many are missing."""
    wanted = contexts.select(context, F.posexplode(ids).alias("at", entry))
    met = wanted.join(entries.select(entry, text), entry, "left")
    return met.groupBy(context).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", text))), lambda x: x[text]), "\n").alias("text"), F.count_if(F.col(text).isNull()).alias("missing"))


def block_assembly(events: DataFrame, key: str, order: str, kind: str, data: str) -> DataFrame:
    """Streamed blocks put together: a start opens a block, deltas add to it, a stop closes it; deltas before any start are unknown."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = events.withColumn("block", F.sum((F.col(kind) == "start").cast("long")).over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col(kind) == "delta", F.struct(order, data)))), lambda x: x[data])
    return numbered.groupBy(key, "block").agg(F.array_join(parts, "").alias("text"), F.bool_or(F.col(kind) == "stop").alias("closed")).withColumn("kind", F.when(F.col("block") == 0, "unknown").otherwise("block"))


def outcome_code(rules: list[tuple[str, Column]], default: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def choice_letter(text: Column) -> Column:
    """The letter that an answer to a multiple-choice question gives, from the most to the least explicit form."""
    forms = [r"(?i)answer\s*(?:is|:)\s*\(?([A-J])\)?", r"\(([A-J])\)", r"(?:^|\s)([A-J])(?:[.)]|\s*$)"]
    return F.coalesce(*(F.nullif(F.upper(F.regexp_extract(text, f, 1)), F.lit("")) for f in forms))


def dispatched(kind: Column, scorers: dict[str, Column]) -> Column:
    """The score of the row's own kind; an unknown kind raises."""
    out = F.raise_error(F.concat(F.lit("unknown reward "), kind))
    for name, score in scorers.items():
        out = F.when(kind == name, score).otherwise(out)
    return out
