"""Conversations as tagged segments, with offsets, masks, turns and context.

A message table has a key, an order within the key, a role and a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import running_ends, spans_of


def tagged(role: Column, text: Column, name: Column | None = None) -> Column:
    """A message as the block that training text shows for its role."""
    result = F.concat(F.lit('<tool_result name="'), F.coalesce(F.nullif(name, F.lit("")), F.lit("tool")) if name is not None else F.lit("tool"), F.lit('">\n'), text, F.lit("\n</tool_result>\n"))
    return F.when(role == "tool", result).otherwise(F.concat(F.lit("<"), role, F.lit(">\n"), text, F.lit("\n</"), role, F.lit(">\n")))


def segments(messages: DataFrame, trainable: tuple[str, ...] = ("assistant",), role: str = "role", text: str = "text") -> DataFrame:
    """messages with segment, trainable and n_chars; assistant messages without text give no segment."""
    body = F.coalesce(F.col(text), F.lit(""))
    kept = messages.where(~((F.col(role) == "assistant") & (body == "")))
    return kept.withColumn("segment", tagged(F.col(role), body)).withColumn("trainable", F.col(role).isin(*trainable)).withColumn("n_chars", F.length("segment").cast("long"))


def char_spans(segs: DataFrame, key: str, order: str) -> DataFrame:
    """segs with start and end offsets in the text that their concatenation gives."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segs.withColumn("end", F.sum("n_chars").over(w)).withColumn("start", F.col("end") - F.col("n_chars"))


def mask_counts(segs: DataFrame, key: str) -> DataFrame:
    """Characters of each key, and how many of them are trainable."""
    return segs.groupBy(key).agg(F.sum("n_chars").alias("total_chars"), F.sum(F.when(F.col("trainable"), F.col("n_chars")).otherwise(0)).alias("trainable_chars"))


def char_mask(segs: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: text and its mask, one 0 or 1 for each character."""
    rows = segs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "segment", "trainable"))).alias("s"))
    mask = F.flatten(F.transform("s", lambda x: F.array_repeat(x["trainable"].cast("int"), F.length(x["segment"]))))
    return rows.select(key, F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), mask.alias("mask"))


def split_context(segs: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the context text, the target text, and the targets' spans in the latter."""
    rows = segs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "segment", "trainable"))).alias("s"))
    texts = lambda keep: F.transform(F.filter("s", lambda x: x["trainable"] == keep), lambda x: x["segment"])
    rows = rows.withColumn("_ends", running_ends(F.transform(texts(True), lambda x: F.length(x))))
    return rows.select(key, F.array_join(texts(False), "").alias("context"), F.array_join(texts(True), "").alias("target"), spans_of(F.col("_ends")).alias("spans"))


def context_prefix(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Every assistant message with the texts of all messages before it, in order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("context", F.collect_list(F.concat(F.col(role), F.lit(": "), F.col(text))).over(w)).where(F.col(role) == "assistant")


def step_index(messages: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """Assistant messages numbered from 1 in each key."""
    return messages.where(F.col(role) == "assistant").withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def turn_ranges(messages: DataFrame, key: str, order: str, role: str = "role", follows: tuple[str, ...] = ("tool",)) -> DataFrame:
    """Turns of each key: one opens at each assistant message and takes the following messages of the roles in `follows`; other roles do not close it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = messages.withColumn("turn_no", F.sum((F.col(role) == "assistant").cast("long")).over(w))
    inside = numbered.where((F.col("turn_no") > 0) & F.col(role).isin("assistant", *follows))
    return inside.groupBy(key, "turn_no").agg(F.count("*").alias("n_messages"), F.min(order).alias("first"), F.max(order).alias("last"))


def chain(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the order values of their predecessor and successor."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("predecessor", F.lag(order).over(w)).withColumn("successor", F.lead(order).over(w))


def token_estimate(*parts: Column) -> Column:
    """max(1, bytes / 4 rounded up) of the parts joined by a space; nulls count as empty."""
    joined = F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.octet_length(joined) / 4).cast("long"))


def status_name(status: Column) -> Column:
    return F.when(status == "completed", "completed").when(status.isin("failed", "error", "timeout"), "failed").otherwise("pending")


def json_text(value: Column) -> Column:
    """A string as JSON, quoted and escaped; characters beyond ASCII stay."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def call_text(call_id: Column, name: Column, arguments: Column, input_text: Column | None = None) -> Column:
    """A tool call as training text shows it: JSON with sorted keys and a space after : and , between the call's marks.

    arguments maps names to values in JSON; null counts as empty. A call with input_text has that and its kind instead.
    """
    entry = lambda k, v: F.concat(F.lit('"'), F.lit(k), F.lit('": '), v)
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(arguments, F.create_map().cast("map<string,string>")))), lambda e: F.concat(json_text(e["key"]), F.lit(": "), e["value"]))
    plain = F.concat_ws(", ", entry("arguments", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))), entry("id", json_text(call_id)), entry("name", json_text(name)))
    if input_text is not None:
        given = F.concat_ws(", ", entry("id", json_text(call_id)), entry("input_text", json_text(input_text)), entry("name", json_text(name)), F.lit('"payload_kind": "input_text"'))
        plain = F.when(input_text.isNotNull(), given).otherwise(plain)
    return F.concat(F.lit("<|tool|>\n{"), plain, F.lit("}\n<|end|>\n"))


def sample_segments(messages: DataFrame, key: str, order: str, targets: DataFrame, tool_specs: DataFrame | None = None, role: str = "role", text: str = "text") -> DataFrame:
    """(key, part, place, kind, segment, trainable) of samples: their messages, a block of tool specs if there are any, then their targets.

    targets has key, place, kind (assistant_tool_call, or assistant for a text) and text; only calls are
    trainable, so assistant messages and target texts are context. tool_specs has key and text. A role other
    than system, user, assistant and tool raises.
    """
    checked = F.when(F.col(role).isin("system", "user", "assistant", "tool"), F.col(role)).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.col(role))).cast("string"))
    said = messages.select(key, F.lit(0).alias("part"), F.col(order).cast("long").alias("place"), checked.alias("kind"), F.coalesce(text, F.lit("")).alias("_body"))
    out = said.select(key, "part", "place", "kind", tagged(F.col("kind"), F.col("_body")).alias("segment"), F.lit(False).alias("trainable"))
    if tool_specs is not None:
        out = out.union(tool_specs.select(key, F.lit(1), F.lit(0).cast("long"), F.lit("user"), tagged(F.lit("user"), F.col("text")), F.lit(False)))
    call = F.col("kind") == "assistant_tool_call"
    body = F.coalesce(F.col("text"), F.lit(""))
    return out.union(targets.select(key, F.lit(2), F.col("place").cast("long"), "kind", F.when(call, body).otherwise(tagged(F.lit("assistant"), body)), call))


def prepared_samples(segs: DataFrame, key: str) -> DataFrame:
    """One row a key: text, segments, spans, character_mask, trainable_char_count and total_char_count, from sample_segments()."""
    rows = segs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "place", "kind", "segment", "trainable"))).alias("s"))
    lengths = F.transform("s", lambda x: F.length(x["segment"]).cast("long"))
    spans = F.transform(F.col("s"), lambda x, i: F.struct(F.get("_ends", i).alias("start"), F.get("_ends", i + 1).alias("end"), x["trainable"].alias("trainable")))
    mask = F.flatten(F.transform("s", lambda x: F.array_repeat(x["trainable"].cast("int"), F.length(x["segment"]))))
    return rows.withColumn("_ends", running_ends(lengths)).select(
        key, F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["segment"].alias("text"), x["trainable"].alias("trainable"))).alias("segments"),
        spans.alias("spans"), mask.alias("character_mask"), F.aggregate(F.transform("s", lambda x: F.when(x["trainable"], F.length(x["segment"])).otherwise(0)), F.lit(0).cast("long"), lambda acc, n: acc + n).alias("trainable_char_count"),
        F.element_at("_ends", -1).alias("total_char_count"),
    )


def turn_mask(messages: DataFrame, key: str, order: str, role: str = "role", step_mask: str | None = None, last_only: bool = False) -> DataFrame:
    """messages with `trained`: 1 for assistant messages whose step is not opted out (step_mask 0), else 0; with last_only just those after the last user message."""
    flag = (F.col(role) == "assistant") & (F.lit(True) if step_mask is None else F.coalesce(F.col(step_mask), F.lit(1)) != 0)
    if not last_only:
        return messages.withColumn("trained", flag.cast("int"))
    last = messages.where(F.col(role) == "user").groupBy(key).agg(F.max(order).alias("_last"))
    return messages.join(last, key, "left").withColumn("trained", (flag & (F.col("_last").isNull() | (F.col(order) > F.col("_last")))).cast("int")).drop("_last")
