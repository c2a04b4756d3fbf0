"""Contexts of actions by reference: one text a trace, and for each action how much of it comes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joining import join_measured
from .toolcalls import exposed_arguments


def _line(role: str, text: str) -> Column:
    return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def context_ranges(messages: DataFrame, key: str, order: str, action: Column, role: str = "role", text: str = "text") -> DataFrame:
    """(key, order, n_context, context_chars) of every message for which `action` holds: how many messages of its key come before it, and their length in trace_texts().

    Nothing is copied, so the output is linear in the messages. Messages of one order value do not come before each other.
    """
    before = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(key, order)
    n = F.count("*").over(before) - F.count("*").over(own)
    chars = F.sum(F.length("_line") + 1).over(before) - F.sum(F.length("_line") + 1).over(own)
    sized = messages.select(key, order, action.alias("_action"), _line(role, text).alias("_line"))
    placed = sized.select(key, order, "_action", n.alias("n_context"), chars.cast("long").alias("_chars"))
    return placed.where("_action").select(key, order, "n_context", F.greatest(F.col("_chars") - 1, F.lit(0)).cast("long").alias("context_chars"))


def trace_texts(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(key, trace_text): the messages of each key as lines `role: text` in their order; one key's text is one row."""
    lines = messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), _line(role, text).alias("line")))).alias("_l"))
    return lines.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("trace_text"))


def with_contexts(ranges: DataFrame, texts: DataFrame, key: str, default: Column | None = None) -> DataFrame:
    """ranges with `context`, cut from the texts; an action without messages before it gets `default` (a text by its row), if there is one."""
    cut = F.when(F.col("n_context") > 0, F.substring("trace_text", F.lit(1), F.col("context_chars").cast("int")))
    return ranges.join(texts, key, "left").withColumn("context", F.coalesce(cut, default if default is not None else F.lit(""))).drop("trace_text")


def rendered_calls(actions: DataFrame, tools: DataFrame, profiles: DataFrame, max_profiles: int = 10_000) -> DataFrame:
    """Every action (with canonical_name and arguments, a JSON text) under every profile: exposed_name, call (JSON text) and fault.

    tools: profile_id, exposed_name, canonical_name, kind, input_schema, canonical_schema, mapping. profiles (profile_id) is a dimension
    table of max_profiles rows at most, or it raises; the output is its product with the actions. A tool is found by its
    canonical name, letter case aside. fault is unknown_tool, ambiguous_tool (a profile has several views of it), freeform_tool, or what
    exposed_arguments() says.
    """
    n = profiles.limit(max_profiles + 1).count()
    if n > max_profiles:
        raise ValueError(f"more than {max_profiles} profiles")
    views = tools.groupBy("profile_id", F.lower("canonical_name").alias("_name")).agg(F.count("*").alias("_n"), F.first(F.struct("exposed_name", "kind", "input_schema", "canonical_schema", "mapping")).alias("_v"))
    every = actions.withColumn("_name", F.lower("canonical_name")).crossJoin(F.broadcast(profiles.select("profile_id").distinct()))
    met = join_measured(every, views, ["profile_id", "_name"], "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False)) & F.coalesce(F.col("_v.kind") != "freeform", F.lit(True))
    made = met.withColumn("_c", F.when(one, exposed_arguments(F.col("arguments"), F.col("_v.mapping"), F.col("_v.canonical_schema"), F.col("_v.input_schema"))))
    fault = F.when(F.col("_n").isNull(), "unknown_tool").when(F.col("_n") > 1, "ambiguous_tool").when(F.col("_v.kind") == "freeform", "freeform_tool").otherwise(F.col("_c.fault"))
    call = F.when(fault.isNull(), F.concat(F.lit('{"name":"'), "_v.exposed_name", F.lit('","arguments":'), "_c.arguments", F.lit("}")))
    return made.select(*actions.columns, "profile_id", F.when(fault.isNull(), F.col("_v.exposed_name")).alias("exposed_name"), call.alias("call"), fault.alias("fault"))
