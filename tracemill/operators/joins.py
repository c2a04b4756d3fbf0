"""Lookups and reconciliations between record sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import global_row_number
from ..functions.storage import checkpointed


def last_wins(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row by order for its keys."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v"))
    return left.join(last, keys, "left").select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """left with the values of right's first row by order for its keys."""
    first = right.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v"))
    return left.join(first, keys, "left").select(*left.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def mismatches(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `mismatches`: the distinct names of the rules that hold, in their order."""
    return rows.withColumn("mismatches", F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))))


def equal_columns(pairs: list[tuple[str, str]]) -> Column:
    """How many of the column pairs are equal, null equal to null."""
    return sum((F.col(a).eqNullSafe(F.col(b)).cast("int") for a, b in pairs), F.lit(0))


def later_matches(early: DataFrame, late: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each early row with the order of the next late row of its keys that comes after it.

    One pass over both sides in order, so a key's rows are not paired with one another.
    """
    both = early.select(*keys, order, F.lit(True).alias("_early")).unionByName(late.select(*keys, order, F.lit(False).alias("_early")))
    after = Window.partitionBy(*keys).orderBy(order).rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("later", F.min(F.when(~F.col("_early"), F.col(order))).over(after)).where(F.col("_early") & F.col("later").isNotNull()).drop("_early")


def overlapping(gaps: DataFrame, ops: DataFrame, key: str, width: int) -> DataFrame:
    """Each gap (gap_start, gap_end) with the first op (op_id, op_start, op_end) of its key that overlaps it.

    Both sides are cut to buckets of `width`, so the join is on equality; the first op by start, then id, stays.
    """
    cut = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    met = cut(gaps, "gap_start", "gap_end").join(cut(ops, "op_start", "op_end"), [key, "_bucket"]).where("op_start < gap_end and op_end > gap_start")
    return met.groupBy(key, "gap_start", "gap_end").agg(F.min(F.struct("op_start", "op_id")).alias("_f")).select(key, "gap_start", "gap_end", F.col("_f.op_id").alias("op_id"))


def first_rule(rows: DataFrame, key: str, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """rows with `rule`, the matching rule of the lowest priority number, and `unique`, whether no other rule ties with it.

    The rules are conditions on the row, so nothing is joined.
    """
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(n).alias("rule"))) for n, p, c in rules)))
    best = F.array_min(F.col("_hits"))
    found = rows.withColumn("_hits", hits).withColumn("rule", best["rule"])
    return found.withColumn("unique", F.size(F.filter("_hits", lambda h: h["priority"] == best["priority"])) == 1).drop("_hits")


def matrix(*sides: DataFrame) -> DataFrame:
    """Every combination of the rows of small dimension tables, with a run_id from their canonical text.

    The sides are the axes of a plan; their product is the plan's size.
    """
    out = sides[0]
    for s in sides[1:]:
        out = out.crossJoin(F.broadcast(s))
    identity = F.to_json(F.struct(*sorted(out.columns)))
    return out.withColumn("run_id", F.substring(F.sha2(identity, 256), 1, 20))


def pending(plan: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The plan with each record's status; pending where there is none."""
    return plan.join(records.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def still_to_run(plan: DataFrame, records: DataFrame, key: str, terminal: tuple[str, ...]) -> DataFrame:
    """Plan rows without a terminal record, with the number of the next attempt."""
    tries = records.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.col("status").isin(*terminal)).alias("_done"))
    return plan.join(tries, key, "left").where(~F.coalesce("_done", F.lit(False))).withColumn("attempt", F.coalesce("_n", F.lit(0)) + 1).drop("_n", "_done")


def deltas(base: DataFrame, other: DataFrame, key: str, values: list[str]) -> DataFrame:
    """other less base for each key on either side; null where a side lacks it."""
    b = base.select(key, *(F.col(v).alias(f"_b_{v}") for v in values))
    return other.select(key, *values).join(b, key, "full").select(key, *((F.col(v) - F.col(f"_b_{v}")).alias(v) for v in values))


#: Counts of a right side that are broadcast: so many (key, token) rows at most.
BROADCAST_COUNTS = 500_000


def _counted(rows: DataFrame, key: str, token: str, name: str) -> DataFrame:
    return rows.groupBy(key, token).agg(F.count("*").alias(name))


def _met_in_place(left: DataFrame, b: DataFrame, left_key: str, right_key: str, token: str) -> DataFrame:
    """multiset_overlap() of left with the right side's counts b, which are broadcast.

    Tokens that b holds become numbers and a left key's tokens one array, so the only shuffle takes four bytes for each
    of them; what follows stays where the key lies.
    """
    numbers = checkpointed(global_row_number(b.select(token).distinct(), [token], "_n").select(token, F.col("_n").cast("int").alias("_n")))
    held = checkpointed(b.join(F.broadcast(numbers), token).select("_n", right_key, "_b"))
    known = left.join(F.broadcast(numbers), token).groupBy(left_key).agg(F.collect_list("_n").alias("_all"))
    a = _counted(known.select(left_key, F.explode("_all").alias("_n")), left_key, "_n", "_a")
    return a.join(F.broadcast(held), "_n").groupBy(left_key, right_key).agg(F.sum(F.least("_a", "_b")).alias("common"))


def multiset_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, token: str, max_broadcast: int = BROADCAST_COUNTS) -> DataFrame:
    """(left_key, right_key, common): tokens that both have, each as often as the rarer side.

    Where right has max_broadcast counts at most they are broadcast and left is shuffled once; a key's tokens meet in one task.
    """
    b = checkpointed(_counted(right, right_key, token, "_b"))
    if b.count() <= max_broadcast:
        return _met_in_place(left, b, left_key, right_key, token)
    return _counted(left, left_key, token, "_a").join(b, token).groupBy(left_key, right_key).agg(F.sum(F.least("_a", "_b")).alias("common"))


def overlaps_of_least(left: DataFrame, right: DataFrame, left_key: str, right_key: str, token: str, least: int, max_broadcast: int = BROADCAST_COUNTS, max_keys: int = 1000) -> DataFrame:
    """multiset_overlap() of the pairs that have `least` tokens or more in common. Null keys and tokens do not count; a key's distinct tokens meet in one task.

    A right side of max_keys keys and max_broadcast counts at most is broadcast: a left key then has no more than max_keys sums, which cost less than to
    look for the pairs first. Beyond that pairs that share only frequent tokens do not meet: the tokens that both sides hold
    are ordered by how many keys hold them, rarest first. The rarest common token of a pair lies, on either side, before
    all but the last least - 1 occurrences, so only these first tokens meet. What is left is counted in full.
    """
    whole = lambda df, key: df.where(F.col(key).isNotNull() & F.col(token).isNotNull())
    b = checkpointed(_counted(whole(right, right_key), right_key, token, "_b"))
    size = b.agg(F.count("*").alias("n"), F.count_distinct(right_key).alias("keys")).first()
    if size["n"] <= max_broadcast and size["keys"] <= max_keys:
        return _met_in_place(whole(left, left_key), b, left_key, right_key, token).where(F.col("common") >= least)
    # A token that the other side lacks is in no pair, so it is not stored.
    a = checkpointed(_counted(whole(left, left_key), left_key, token, "_a").join(b.select(token).distinct(), token, "left_semi"))
    # Stored, so that the joins deal out both sides anew and can split a token that many keys hold.
    held = a.groupBy(token).agg(F.count("*").alias("_m")).join(b.groupBy(token).agg(F.count("*").alias("_k")), token)
    held = checkpointed(held.select(token, (F.col("_m") + F.col("_k")).alias("_df")))

    def first(df: DataFrame, key: str, n: str) -> DataFrame:
        own = Window.partitionBy(key)
        order = own.orderBy("_df", token).rowsBetween(Window.unboundedPreceding, -1)
        placed = df.join(held, token).withColumns({"_before": F.coalesce(F.sum(n).over(order), F.lit(0)), "_all": F.sum(n).over(own)})
        return placed.where(F.col("_before") <= F.col("_all") - least).select(key, token)

    met = checkpointed(first(a, left_key, "_a")).join(checkpointed(first(b, right_key, "_b")), token).select(left_key, right_key).distinct()
    full = met.join(b, right_key).join(a, [left_key, token]).groupBy(left_key, right_key).agg(F.sum(F.least("_a", "_b")).alias("common"))
    return full.where(F.col("common") >= least)
