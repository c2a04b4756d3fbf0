"""Loss masks over the tokens of chat messages, with a tokenizer's own tokens.

A template writes a message as a block; the tokenizer cuts the blocks to tokens. Rows are messages and stay so:
every rule needs a message alone, or it and one more. That holds for whole texts too, as a byte-level
tokenizer has no token over the place where one block ends and the next begins.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("alone", "prefix", "offsets")
_loaded: dict = {}


@dataclass(frozen=True)
class Template:
    """A block is opening, role, a line break, the text, closing and a line break. `system` comes before a first message of another role."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    system: str | None = None
    thought: str = "<think>\n"

    def header(self, role: str) -> str:
        return f"{self.opening}{role}\n"

    def block(self, role: str, text: str) -> str:
        return f"{self.header(role)}{text}{self.closing}\n"

    def default(self, first_role: str) -> str:
        return self.block("system", self.system) if self.system is not None and first_role != "system" else ""

    def render(self, messages: list[tuple[str, str]], answer: bool = False) -> str:
        whole = (self.default(messages[0][0]) if messages else "") + "".join(self.block(r, t) for r, t in messages)
        return whole + self.header("assistant") if answer else whole


def _tokenizer(path: str):
    if _loaded.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded.update(path=path, tokenizer=tokenizer, apart=conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
    return _loaded["tokenizer"], _loaded["apart"]


def _spans(tokenizer, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Ids of a text, and 1 for each token that has a character from start to end."""
    found = tokenizer.encode(text, add_special_tokens=False)
    return found.ids, [int(a < b and a < end and b > start) for a, b in found.offsets]


class Masker:
    """The ids and masks of single messages by one of METHODS."""

    def __init__(self, path: str, template: Template, method: str):
        if method not in METHODS:
            raise ValueError(method)
        self.tokenizer, self.apart = _tokenizer(path)
        if method == "offsets" and not (self.apart and template.opening[:1] == "<" and template.closing[-1:] == ">"):
            raise ValueError("tokens could go on from one message to the next")
        self.template, self.method = template, method
        self.other = [("user", "x")]
        self.n_other = len(self.ids(template.render(self.other)))
        self.n_header = len(self.ids(template.render(self.other, answer=True))) - self.n_other
        self.n_system = len(self.ids(template.default("user")))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def message(self, role: str, text: str, first: bool, counts: bool) -> tuple[list[int], list[int]]:
        one, t = [(role, text)], self.template
        if self.method == "offsets":
            before = t.default(role) if first else ""
            start = len(before) + len(t.header(role))
            whole = before + t.block(role, text)
            if text.startswith(t.thought):
                start += len(t.thought)
            return _spans(self.tokenizer, whole, start, len(whole) if counts and role == "assistant" else start)
        if self.method == "alone":
            ids = self.ids(t.render(one))
        elif first:
            ids = self.ids(t.render(one + self.other))[: -len(self.ids(t.block(*self.other[0])))]
        else:
            ids = self.ids(t.render(self.other + one))[self.n_other :]
        if not first and role != "system" and self.method == "alone":
            ids = ids[self.n_system :]
        mask = [0] * self.n_header + [1] * (len(ids) - self.n_header) if role == "assistant" and counts else [0] * len(ids)
        return ids, mask


def _small(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows: the tokens of a part are Python's numbers, which take ten times the room of its text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def message_masks(messages: DataFrame, key: str, order: str, tokenizer_path: str, method: str, template: Template | None = None, role: str = "role", text: str = "text", step: str | None = None) -> DataFrame:
    """(key, order, token_ids, loss_mask) of every message; a conversation's tokens are those of its messages in order.

    Answers of the assistant are trained, from after their header to the end of their block. method is `alone` (each block
    cut by itself, less the default system block for all but the first), `prefix` (what a block adds to the tokens of
    another message, or, for the first, what is there besides those of one that follows) or `offsets` (tokens
    that hold a character of an answer, which begins after an opening thought mark). An answer whose
    `step` is not 1 (null counts as 1) is not trained. Null roles and texts count as empty. Other columns are ignored.
    """
    template = template or Template()
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    counts = F.lit(True) if step is None else F.coalesce(F.col(step), F.lit(1)) == 1
    rows = messages.select(key, order, F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"), first.alias("_first"), counts.alias("_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(tokenizer_path, template, method)
        for batch in _small(batches):
            columns = (batch.column(c).to_pylist() for c in ("_role", "_text", "_first", "_counts"))
            found = [masker.message(*x) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=[key, order, "token_ids", "loss_mask"])

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, token_ids array<int>, loss_mask array<int>")


def response_masks(messages: DataFrame, key: str, order: str, tokenizer_path: str, template: Template | None = None, role: str = "role", text: str = "text", step: str | None = None) -> DataFrame:
    """(key, token_ids, loss_mask) of each conversation: its first message as a prompt, and the tokens of its last text as the response, which is trained."""
    template = template or Template()
    said = F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), (F.lit(True) if step is None else F.coalesce(F.col(step), F.lit(1)) == 1).alias("counts"))
    ends = messages.groupBy(key).agg(F.min_by(said, order).alias("_a"), F.max_by(said, order).alias("_b")).select(key, F.col("_a.role").alias("_role"), F.col("_a.text").alias("_text"), F.col("_b.text").alias("_answer"), F.col("_b.counts").alias("_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, _ = _tokenizer(tokenizer_path)
        for batch in _small(batches):
            ids, masks = [], []
            for r, t, answer, counts in zip(*(batch.column(c).to_pylist() for c in ("_role", "_text", "_answer", "_counts")), strict=True):
                a, b = (tokenizer.encode(x, add_special_tokens=False).ids for x in (template.render([(r, t)], answer=True), answer))
                ids.append(a + b)
                masks.append([0] * len(a) + [int(counts)] * len(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32()))], names=[key, "token_ids", "loss_mask"])

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    return ends.mapInArrow(run, f"`{key}` {kinds[key]}, token_ids array<int>, loss_mask array<int>")
