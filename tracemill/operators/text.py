"""Text, JSON and hash expressions: buckets, scrubbing, labels, scores, schema checks."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is scrubbed, in order: name, pattern, what it becomes.
SCRUB_PATTERNS = [
    ("private_key", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "<redacted-private-key>"),
    ("email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "<redacted-email>"),
    ("absolute_user_path", r"(?:/home/|/Users/)[A-Za-z0-9._-]+", r"\$HOME"),
    ("bearer_token", r"(?i)\bBearer[ \t]+(?!<redacted>)[A-Za-z0-9._~+/\-=]+", "Bearer <redacted>"),
    ("credential_assignment", r"(?i)\b(authorization|api[_-]?key|access[_-]?token|secret[_-]?key)[ \t]*[:=][ \t]*(?!<redacted>)[^\s,;]+", "$1=<redacted>"),
]
# Risks by what a text holds and by its artifact's class.
RISK_PATTERNS = [
    ("potential_authorization_material", r"(?i)(authorization|api[_-]?key|access[_-]?token|secret[_-]?key|bearer[ \t]+[A-Za-z0-9])"),
    ("private_key_material", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("personal_email", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("absolute_user_path", r"(?:/home/|/Users/)[A-Za-z0-9._-]+/"),
]
CLASS_RISKS = {
    "raw_provider_payload": "raw_provider_content",
    "trace": "raw_trace_content",
    "event_log": "raw_trace_content",
    "workspace_snapshot": "workspace_snapshot_content",
    "compiled_artifact": "compiled_or_binary_content",
    "log": "log_content",
}


#: Workers import this module without a session, so types are not written as DDL here.


_CREDENTIALS = ("authorization", *(a + between + b for a, b in (("api", "key"), ("access", "token"), ("secret", "key")) for between in ("", "_", "-")))
#: Substrings in lower case of which a text must hold one for the pattern to match; without them it is not searched.
_SIGNS = {
    "private_key": ("private key",), "email": ("@",), "absolute_user_path": ("/home/", "/users/"), "bearer_token": ("bearer",), "credential_assignment": _CREDENTIALS,
    "potential_authorization_material": (*_CREDENTIALS, "bearer"), "private_key_material": ("private key",), "personal_email": ("@",),
}


def _may_hold(text: Column, name: str) -> Column:
    low, out = F.lower(text), F.lit(False)
    for sign in _SIGNS[name]:
        out |= F.contains(low, F.lit(sign))
    return out


def hash_bucket(value: Column, n: int) -> Column:
    """The first 4 bytes of the SHA-256, modulo n."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % n


def split_name(key: Column, held_out: Column) -> Column:
    return F.when(held_out, "eval_unseen").when(hash_bucket(key, 5) == 0, "eval_seen").otherwise("train")


def variant_index(seed: Column, name: Column, kind: str, n: int) -> Column:
    """A stable choice among variants 1 to n - 1."""
    return 1 + hash_bucket(F.concat_ws(":", seed, name, F.lit(kind), F.lit("mut")), n - 1)


def scrubbed(text: Column) -> tuple[Column, list[tuple[str, Column]]]:
    """The text after all replacements, and the number of each; every pattern sees what the ones before left."""
    counts, source = [], text
    for name, pattern, new in SCRUB_PATTERNS:
        # The signs survive earlier replacements or were in the text before them, so the first text decides.
        found = _may_hold(source, name)
        counts.append((name, F.when(found, F.regexp_count(text, F.lit(pattern))).otherwise(F.when(source.isNotNull(), 0)).cast("long")))
        text = F.when(found, F.regexp_replace(text, pattern, new)).otherwise(text)
    return text, counts


def risk_labels(text: Column, artifact_class: Column) -> Column:
    """Sorted names of the risks that a text and its artifact's class show."""
    rules = [(name, _may_hold(text, name) & text.rlike(pattern)) for name, pattern in RISK_PATTERNS]
    rules += [(risk, artifact_class.isin(*(c for c, r in CLASS_RISKS.items() if r == risk))) for risk in sorted(set(CLASS_RISKS.values()))]
    return F.sort_array(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules))))


def name_candidates(name: Column) -> Column:
    """snake, camel and Pascal forms of an identifier, with _tool after and use_ before, each once."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda p: p != "")
    snake = F.array_join(parts, "_")
    pascal = F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")
    camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1_000_000))
    return F.array_distinct(F.array(snake, camel, pascal, F.concat(snake, F.lit("_tool")), F.concat(F.lit("use_"), snake)))


def normalized_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and English articles, white space squeezed."""
    plain = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def token_f1(predicted: Column, truth: Column) -> Column:
    """(f1, precision, recall) of the tokens of two normalised answers, each token as often as the rarer side."""
    p, t = (F.filter(F.split(x, " "), lambda w: w != "") for x in (predicted, truth))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(F.array_intersect(p, t)), F.lit(0), lambda acc, w: acc + F.least(count(p, w), count(t, w)))
    closed = ["yes", "no", "noanswer"]
    guard = (predicted.isin(*closed) | truth.isin(*closed)) & (predicted != truth)
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    precision, recall = common / F.size(p), common / F.size(t)
    return F.when(predicted.isNull() | guard | (common == 0), zero).otherwise(F.struct((2 * precision * recall / (precision + recall)).alias("f1"), precision.alias("precision"), recall.alias("recall")))


def final_answer(text: Column) -> Column:
    """What follows the last `Answer:` in the last 300 characters; [INVALID] without one."""
    tail = F.substring(text, F.greatest(F.length(text) - 299, F.lit(1)), F.lit(300))
    found = F.try_element_at(F.regexp_extract_all(tail, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.trim(found), F.lit("[INVALID]"))


def call_reward(name_ok: Column, args_ok: Column, schema_ok: Column | None = None) -> Column:
    """0.1 for a call, 0.4 for its name, 0.4 for its arguments and 0.1 for its schema, over what can be had."""
    got = F.lit(0.1) + F.when(name_ok, 0.4).otherwise(0.0) + F.when(args_ok, 0.4).otherwise(0.0)
    if schema_ok is None:
        return F.least(F.lit(1.0), got / 0.9)
    return F.least(F.lit(1.0), got + F.when(schema_ok, 0.1).otherwise(0.0))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of columns: keys sorted, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def digests_in_order(rows: DataFrame, tree: str, path: str, entry: Column) -> DataFrame:
    """(tree, digest): the SHA-256 of each tree's entries in the order of their paths.

    A digest over an order is one sequence, so a tree is one task's; it is hashed as its sorted rows
    stream by and never held as a whole. Entries of equal paths follow in the order of their texts.
    """
    kind = rows.schema[tree].dataType.simpleString()
    placed = rows.select(tree, F.col(path).alias("_path"), entry.alias("_entry")).repartition(F.col(tree)).sortWithinPartitions(tree, "_path", "_entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, begun = None, hashlib.sha256(), False
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if begun and key != own:
                    yield _digest_row(batch.schema.field(0), own, digest)
                    digest = hashlib.sha256()
                own, begun = key, True
                digest.update((text or "").encode())
        if begun:
            yield _digest_row(batch.schema.field(0), own, digest)

    return placed.mapInArrow(run, f"`{tree}` {kind}, digest string")


def _digest_row(field: pa.Field, key, digest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], field.type), pa.array([digest.hexdigest()])], names=[field.name, "digest"])


def tree_digests(rows: DataFrame, tree: str, path: str, size: str, digest: str, between: str = "\0") -> DataFrame:
    """(tree, digest) over the sorted path, size and digest lines of each tree."""
    return digests_in_order(rows, tree, path, F.concat(F.col(path), F.lit(between), F.col(size).cast("string"), F.lit(between), F.col(digest), F.lit("\n")))


def workspace_digests(rows: DataFrame, workspace: str, path: str, content: str, is_folder: str, between: str = "\0") -> DataFrame:
    """(workspace, digest) over the sorted paths of each, with their content, or <dir> for a folder; <missing> where the only path is null."""
    entry = F.concat(F.col(path), F.lit(between), F.when(F.col(is_folder), F.lit("<dir>")).otherwise(F.coalesce(F.col(content), F.lit(""))), F.lit(between))
    return digests_in_order(rows, workspace, path, F.coalesce(entry, F.lit("<missing>")))


def slug(text: Column, length: int = 24) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, length)


def tool_call_block(text: Column) -> Column:
    """(name, arguments, error) of the first <|tool|> block up to the next <|end|>."""
    start = F.locate("<|tool|>", text)
    body = F.substring_index(F.substr(text, start + 8), "<|end|>", 1)
    closed = F.instr(F.substr(text, start + 8), "<|end|>") > 0
    value = F.try_parse_json(body)
    name = F.try_variant_get(value, "$.name", "string")
    args = F.try_variant_get(value, "$.arguments", "variant")
    given = F.try_variant_get(value, "$.input_text", "string")
    kind = F.schema_of_variant(args)
    error = (
        F.when(start == 0, "no_block").when(~closed, "not_closed").when(value.isNull(), "invalid_json").when(~F.schema_of_variant(value).startswith("OBJECT"), "not_an_object")
        .when(F.coalesce(F.trim(name), F.lit("")) == "", "missing_name").when(args.isNull() & given.isNull(), "missing_payload").when(args.isNotNull() & ~kind.startswith("OBJECT"), "arguments_not_an_object")
    )
    return F.struct(name.alias("name"), F.to_json(args).alias("arguments"), error.alias("error"))


def sse_blocks(text: Column) -> Column:
    """Events of a server-sent stream: (event, data) of each block between blank lines."""
    blocks = F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n+"), lambda b: F.trim(b) != "")

    def fields(block, name):
        lines = F.filter(F.split(block, "\n"), lambda line: line.startswith(name))
        return F.array_join(F.transform(lines, lambda line: F.trim(F.substr(line, F.lit(len(name) + 1)))), "\n")

    return F.transform(blocks, lambda b: F.struct(fields(b, "event:").alias("event"), fields(b, "data:").alias("data")))


@F.arrow_udf(T.DoubleType())
def _compression(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size by compressed size of each text, which is a Python object only for its own turn; 0 for none."""
    for texts in batches:
        found = []
        for t in texts:
            raw = (t.as_py() or "").encode()
            found.append(len(raw) / len(zlib.compress(raw, 9)) if raw else 0.0)
        yield pa.array(found, pa.float64())


def repetition(text: Column | str) -> Column:
    """Compression ratio of the last 10,000 characters, which alone go to Python, and whether a text longer than that is compressed over tenfold."""
    c = F.col(text) if isinstance(text, str) else text
    ratio = _compression(F.right(c, F.lit(10_000)))
    return F.struct(ratio.alias("ratio"), (F.coalesce(F.char_length(c) > 10_000, F.lit(False)) & (ratio > 10)).alias("repeated"))


@F.pandas_udf(T.StringType())
def boxed_answer(texts: pd.Series) -> pd.Series:
    r"""The content of the last \boxed{...}, braces matched; null without one."""

    def find(t: str | None) -> str | None:
        at = (t or "").rfind("\\boxed{")
        if at < 0:
            return None
        depth, begin = 0, at + len("\\boxed{")
        for i in range(at + len("\\boxed"), len(t)):
            depth += {"{": 1, "}": -1}.get(t[i], 0)
            if not depth:
                return t[begin:i]
        return None

    return texts.map(find)


def _kind(value) -> set[str]:
    if isinstance(value, bool):
        return {"boolean"}
    if isinstance(value, int):
        return {"integer", "number"}
    if isinstance(value, float):
        return {"number"}
    return {{str: "string", list: "array", dict: "object", type(None): "null"}[type(value)]}


def schema_fault(value, schema: dict, path: str = "$") -> str | None:
    """The first path at which a value breaks a JSON-Schema subset (type, enum, properties, required, additionalProperties, items)."""
    kinds = schema.get("type")
    if kinds is not None and not _kind(value) & set([kinds] if isinstance(kinds, str) else kinds):
        return path
    if "enum" in schema and value not in schema["enum"]:
        return path
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}"
        known = schema.get("properties", {})
        for name, inner in value.items():
            if name in known:
                if fault := schema_fault(inner, known[name], f"{path}.{name}"):
                    return fault
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}"
    if isinstance(value, list) and "items" in schema:
        for i, inner in enumerate(value):
            if fault := schema_fault(inner, schema["items"], f"{path}[{i}]"):
                return fault
    return None


def schema_check(column: Column, schema: dict) -> Column:
    """The first faulty path of a JSON text under the schema; `$` where it is no JSON, null where it fits."""
    text = json.dumps(schema)

    @F.pandas_udf("string")
    def check(values: pd.Series) -> pd.Series:
        wanted = json.loads(text)

        def one(v: str | None) -> str | None:
            try:
                return schema_fault(json.loads(v), wanted)
            except (TypeError, ValueError):
                return "$"

        return values.map(one)

    return check(column)
