"""Tool calls as text: parsing, nested argument paths, mapping between two schemas, and scores of predictions.

A JSON Schema and a mapping of paths come with each row. They are compiled once for each distinct text
and kept while a task meets them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joining import join_measured

# ---- paths

def _leaves(value, prefix: str = ""):
    """(dotted path, value) of everything in nested objects that is no object itself; lists are values."""
    for key, inner in value.items() if isinstance(value, dict) else ():
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(inner, dict):
            yield from _leaves(inner, path)
        else:
            yield path, inner


def _at(value, path: str):
    for key in path.split("."):
        if not isinstance(value, dict) or key not in value:
            return None
        value = value[key]
    return value


def _put(value: dict, path: str, new) -> None:
    *above, last = path.split(".")
    for key in above:
        value = value.setdefault(key, {})
        if not isinstance(value, dict):
            raise ValueError(f"path through a value: {path}")
    value[last] = new


def _object(text: str | None) -> dict:
    found = json.loads(text) if text else {}
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def _written(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _inverse(mapping: dict[str, str]) -> dict[str, str]:
    found: dict[str, str] = {}
    for source, target in mapping.items():
        if found.setdefault(target, source) != source:
            raise ValueError(f"ambiguous: {target}")
    return found


def _moved(value: dict, mapping: dict[str, str], defaults: dict) -> dict:
    """The object with its leaves under the paths of mapping (all as they are without one), and defaults where nothing stands."""
    if mapping:
        if lost := sorted({p for p, _ in _leaves(value)} - mapping.keys()):
            raise ValueError("unmapped: " + ",".join(lost))
        out: dict = {}
        for source, target in mapping.items():
            if (found := _at(value, source)) is not None:
                _put(out, target, found)
    else:
        out = json.loads(json.dumps(value)) if defaults else value
    for path, new in defaults.items():
        if _at(out, path) is None:
            _put(out, path, new)
    return out


def leaf_paths(column: Column) -> Column:
    """array<struct<path, value>>: the leaves of a JSON object in their order, values as JSON text; null where the text is no object."""

    @F.pandas_udf("array<struct<path string, value string>>")
    def leaves(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return [{"path": p, "value": _written(v)} for p, v in _leaves(_object(text))] if text else None
            except ValueError:
                return None

        return texts.map(one)

    return leaves(column)


def path_value(column: Column, path: Column) -> Column:
    """The JSON text at a dotted path of a JSON object; null if nothing stands there."""

    @F.pandas_udf("string")
    def get(texts: pd.Series, paths: pd.Series) -> pd.Series:
        def one(text, where):
            try:
                found = _at(json.loads(text), where)
            except (TypeError, ValueError, AttributeError):
                return None
            return None if found is None else _written(found)

        return pd.Series([one(t, p) for t, p in zip(texts, paths, strict=True)], dtype=object)

    return get(column, path)


def assembled(leaves: DataFrame, keys: list[str], path: str = "path", value: str = "value") -> DataFrame:
    """(keys, object, fault): one JSON object for each key out of its rows of (path, JSON value), which one argument object bounds.

    Of a repeated path the greatest value stays. A path through another one's value is a fault; keys come sorted.
    """

    @F.pandas_udf("struct<object string, fault string>")
    def build(lists: pd.Series) -> pd.DataFrame:
        def one(rows):
            out: dict = {}
            try:
                for row in rows:
                    _put(out, row["path"], json.loads(row["value"]))
            except ValueError as e:
                return None, str(e)
            return _written(out), None

        return pd.DataFrame([one(rows) for rows in lists], columns=["object", "fault"])

    rows = leaves.groupBy(*keys, path).agg(F.max(value).alias("_v")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(path).alias("path"), F.col("_v").alias("value")))).alias("_rows"))
    return rows.select(*keys, build("_rows").alias("_o")).select(*keys, "_o.object", "_o.fault")


# ---- schemas

Check = Callable[[object, str], "str | None"]
_KINDS: dict[str, Callable[[object], bool]] = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def _checker(schema: dict) -> Check:
    """The first path at which a value breaks the schema. Without a type all is well; enum counts for plain values; several types are tried in turn."""
    kind = schema.get("type")
    if kind is None:
        return lambda value, path: None
    if isinstance(kind, list):
        tries = [_checker({**schema, "type": k}) for k in kind]

        def any_of(value, path: str) -> str | None:
            fault = None
            for check in tries:
                if (fault := check(value, path)) is None:
                    return None
            return fault

        return any_of
    fits = _KINDS.get(kind, lambda v: True)
    if kind == "object":
        inner = {k: _checker(s) for k, s in schema.get("properties", {}).items()}
        required, closed = list(schema.get("required", [])), schema.get("additionalProperties", True) is False

        def of_object(value, path: str) -> str | None:
            if not fits(value):
                return path
            for key in required:
                if key not in value:
                    return f"{path}.{key}"
            for key, item in value.items():
                if key in inner:
                    if fault := inner[key](item, f"{path}.{key}"):
                        return fault
                elif closed:
                    return f"{path}.{key}"
            return None

        return of_object
    if kind == "array":
        each = _checker(schema["items"]) if schema.get("items") is not None else None

        def of_array(value, path: str) -> str | None:
            if not fits(value):
                return path
            return next((fault for i, x in enumerate(value) if (fault := each(x, f"{path}[{i}]"))), None) if each else None

        return of_array
    allowed = schema.get("enum")
    return lambda value, path: None if fits(value) and (allowed is None or value in allowed) else path


@lru_cache(4096)
def _compiled(text: str) -> Check:
    return _checker(json.loads(text))


@lru_cache(4096)
def _mapping(text: str | None) -> dict:
    return _object(text)


@lru_cache(4096)
def _inverted(text: str | None) -> dict:
    return _inverse(_object(text))


@lru_cache(1024)
def _specs(text: str) -> dict:
    found: dict = {}
    for spec in json.loads(text):
        found.setdefault(spec.get("name"), spec.get("input_schema"))
    return found


_CALL = "struct<arguments string, fault string, equal boolean>"


def _call(value: dict, mapping: dict, defaults: dict, before: str | None, after: str | None, names: tuple[str, str]) -> dict:
    if before and (fault := _compiled(before)(value, "$")):
        raise ValueError(f"{names[0]} {fault}")
    out = _moved(value, mapping, defaults)
    if after and (fault := _compiled(after)(out, "$")):
        raise ValueError(f"{names[1]} {fault}")
    return out


def canonical_arguments(payload: Column, mapping: Column, defaults: Column, exposed_schema: Column, canonical_schema: Column, expected: Column) -> Column:
    """struct<arguments, fault, equal>: the `arguments` of a call's payload under their canonical paths.

    All six are JSON texts and may be null. The arguments are checked against the exposed schema, moved by mapping
    (exposed path to canonical path) with defaults added, and checked against the canonical schema. fault is
    `exposed $.path`, `unmapped: paths`, `path through a value: path` or `canonical $.path`; equal tells whether the result is the expected object.
    """

    @F.pandas_udf(_CALL)
    def run(payloads: pd.Series, mappings: pd.Series, fills: pd.Series, before: pd.Series, after: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        def one(p, m, d, b, a, w):
            try:
                given = json.loads(p).get("arguments")
                if not isinstance(given, dict):
                    return None, "no object", None
                found = _call(given, _mapping(m), _mapping(d), b, a, ("exposed", "canonical"))
            except (TypeError, ValueError, AttributeError) as e:
                return None, str(e), None
            return _written(found), None, w is not None and found == json.loads(w)

        return pd.DataFrame([one(*x) for x in zip(payloads, mappings, fills, before, after, wanted, strict=True)], columns=["arguments", "fault", "equal"])

    return run(payload, mapping, defaults, exposed_schema, canonical_schema, expected)


def exposed_arguments(arguments: Column, mapping: Column, canonical_schema: Column, exposed_schema: Column) -> Column:
    """struct<arguments, fault, equal>: canonical arguments under their exposed paths, by the inverse of mapping; equal is null.

    fault may be `ambiguous: path`, where two exposed paths lead to one canonical path.
    """

    @F.pandas_udf(_CALL)
    def run(texts: pd.Series, mappings: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        def one(t, m, b, a):
            try:
                return _written(_call(_object(t), _inverted(m), {}, b, a, ("canonical", "exposed"))), None, None
            except (TypeError, ValueError) as e:
                return None, str(e), None

        return pd.DataFrame([one(*x) for x in zip(texts, mappings, before, after, strict=True)], columns=["arguments", "fault", "equal"])

    return run(arguments, mapping, canonical_schema, exposed_schema)


def light_check(specs: Column, name: Column, arguments: Column) -> Column:
    """struct<status, fault> of arguments (JSON text) against the spec of that name in a JSON list of {name, input_schema}.

    valid or invalid by required names and the plain types of properties; types that are no JSON types pass.
    not_applicable without arguments, without such a spec, or where its schema is no object's.
    """

    def judge(schema, given: dict) -> tuple[str, str | None]:
        if not isinstance(schema, dict) or schema.get("type") not in (None, "object"):
            return "not_applicable", None
        required = schema.get("required", [])
        if not isinstance(required, list):
            return "invalid", "required is no list"
        for key in required:
            if not isinstance(key, str):
                return "invalid", "required holds no name"
            if key not in given:
                return "invalid", f"missing: {key}"
        properties = schema.get("properties", {})
        if not isinstance(properties, dict):
            return "not_applicable", None
        for key, value in given.items():
            kind = properties[key].get("type") if isinstance(properties.get(key), dict) else None
            if isinstance(kind, str) and not _KINDS.get(kind, lambda v: True)(value):
                return "invalid", f"no {kind}: {key}"
        return "valid", None

    @F.pandas_udf("struct<status string, fault string>")
    def run(lists: pd.Series, names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        def one(s, n, t):
            given = json.loads(t) if t else None
            return judge(_specs(s or "[]").get(n), given) if isinstance(given, dict) else ("not_applicable", None)

        return pd.DataFrame([one(*x) for x in zip(lists, names, texts, strict=True)], columns=["status", "fault"])

    return run(specs, name, arguments)


# ---- calls and scores

def parsed_call(text: Column) -> Column:
    """struct<name, payload, has_object, error> of the first <|tool|> block up to the next <|end|>; payload is the JSON text between them.

    A payload is an object with a name and either arguments that are an object or an input_text.
    """
    start = F.locate("<|tool|>", text)
    rest = F.substr(text, start + F.lit(8))
    body = F.trim(F.regexp_replace(F.substring_index(rest, "<|end|>", 1), r"^\s+|\s+$", ""))
    value = F.try_parse_json(body)
    part = lambda key: F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    name = F.when(part("name") == "STRING", F.try_variant_get(value, "$.name", "string"))
    has_object = F.coalesce(part("arguments").startswith("OBJECT"), F.lit(False))
    # The codes by which such reports are compared.
    error = (
        F.when(text.isNull() | (start == 0), "missing_tool_call_block").when(F.instr(rest, "<|end|>") == 0, "missing_end_marker").when(value.isNull(), "invalid_json").when(~F.schema_of_variant(value).startswith("OBJECT"), "invalid_payload_type")
        .when(F.coalesce(F.trim(name), F.lit("")) == "", "invalid_payload_name").when(~has_object & ~F.coalesce(part("input_text") == "STRING", F.lit(False)), "invalid_payload_arguments")
    )
    return F.struct(name.alias("name"), body.alias("payload"), has_object.alias("has_object"), error.alias("error"))


def score_predictions(samples: DataFrame, tools: DataFrame) -> DataFrame:
    """samples with the outcome of each predicted call: predicted_name, predicted_arguments (canonical), parse_ok, tool_name_ok, schema_valid, canonical_intent_ok, exact_match, stale_canonical_name, error_code.

    samples: profile_id, predicted_text, target_text, expected_name, expected_canonical_name, expected_arguments (JSON), expected_freeform.
    tools: profile_id, position, exposed_name, canonical_name, kind (function or freeform), input_schema, canonical_schema, mapping, defaults
    (JSON). Of tools of one name in a profile the first counts. Only the tool that a prediction names travels with it.
    error_code is the first that holds: a payload without arguments is expected; the parse error; the profile has no such tool; the
    call has no argument object; mapping or a schema fails; the canonical call is another one; only the text differs.
    """
    first = tools.withColumn("_n", F.row_number().over(Window.partitionBy("profile_id", "exposed_name").orderBy("position"))).where("_n = 1")
    known = first.select("profile_id", F.col("exposed_name").alias("predicted_name"), F.col("canonical_name").alias("_tool"), F.col("kind").alias("_kind"), F.col("input_schema").alias("_before"), F.col("canonical_schema").alias("_after"), F.col("mapping").alias("_map"), F.col("defaults").alias("_fill"))
    read = samples.withColumn("_p", parsed_call(F.col("predicted_text"))).withColumn("predicted_name", F.when(F.col("_p.error").isNull(), F.col("_p.name")))
    met = join_measured(read, known, ["profile_id", "predicted_name"], "left")
    met = met.withColumn("_c", canonical_arguments(F.col("_p.payload"), F.col("_map"), F.col("_fill"), F.col("_before"), F.col("_after"), F.col("expected_arguments")))
    plain = F.coalesce(F.col("expected_freeform"), F.lit(False))
    resolved = F.col("_tool").isNotNull()
    fault = F.col("_c.fault").isNotNull() | (F.col("_kind") == "freeform")
    same = (F.col("_tool") == F.col("expected_canonical_name")) & F.coalesce(F.col("_c.equal"), F.lit(False))
    exact = F.coalesce(F.col("predicted_text") == F.col("target_text"), F.lit(False))
    code = (
        F.when(plain, "freeform_not_supported_in_schema_following_eval").when(F.col("_p.error").isNotNull(), F.col("_p.error")).when(~resolved, "unknown_tool_name").when(~F.col("_p.has_object"), "freeform_not_supported_in_schema_following_eval")
        .when(fault, "schema_validation_error").when(~same, "canonical_intent_mismatch").when(~exact, "exact_text_mismatch")
    )
    read_ok = ~plain & F.col("_p.error").isNull()
    valid = read_ok & resolved & F.col("_p.has_object") & ~fault
    out = {
        "predicted_name": F.when(read_ok, F.col("predicted_name")), "predicted_arguments": F.when(valid, F.col("_c.arguments")), "parse_ok": read_ok, "tool_name_ok": read_ok & resolved & (F.col("predicted_name") == F.col("expected_name")),
        "schema_valid": valid, "canonical_intent_ok": valid & same, "exact_match": valid & exact, "stale_canonical_name": read_ok & (F.col("predicted_name") == F.col("expected_canonical_name")) & (F.col("predicted_name") != F.col("expected_name")), "error_code": code,
    }
    keep = [c for c in samples.columns if c not in out]
    return met.select(*keep, *((F.coalesce(c, F.lit(False)) if n in ("parse_ok", "tool_name_ok", "schema_valid", "canonical_intent_ok", "exact_match", "stale_canonical_name") else c).alias(n) for n, c in out.items()))


RATES = {"parse_rate": "parse_ok", "tool_name_accuracy": "tool_name_ok", "schema_valid_rate": "schema_valid", "canonical_intent_accuracy": "canonical_intent_ok", "exact_match_rate": "exact_match", "stale_canonical_name_rate": "stale_canonical_name"}


def prediction_metrics(scored: DataFrame, split: str) -> DataFrame:
    """(split, sample_count, the six rates, error_counts): a row for each split and one called overall; error_counts maps each code to its number."""
    sums = [F.sum(F.col(c).cast("long")).alias(n) for n, c in RATES.items()]
    one = scored.groupBy(F.col(split).alias("split"), "error_code").agg(F.count("*").alias("n"), *sums)
    both = one.union(one.groupBy("error_code").agg(F.sum("n"), *(F.sum(n) for n in RATES)).select(F.lit("overall"), "*"))
    entries = F.collect_list(F.when(F.col("error_code").isNotNull(), F.struct("error_code", "n")))
    return both.groupBy("split").agg(F.sum("n").alias("sample_count"), *(F.sum(n).alias(n) for n in RATES), F.map_from_entries(F.array_sort(entries)).alias("error_counts")).select("split", "sample_count", *((F.col(n) / F.col("sample_count")).alias(n) for n in RATES), "error_counts")


def completion_rewards(samples: DataFrame) -> DataFrame:
    """samples (predicted_text, expected_name, expected_arguments, tool_specs) with schema_status, reward, tool_name_ok, arguments_exact_match and error_code.

    A tenth for a call that can be read, four for its name, four for its arguments, and one for a valid schema where
    a schema applies; the sum is divided by what could be reached. A call that cannot be read earns nothing.
    """
    read = samples.withColumn("_p", parsed_call(F.col("predicted_text")))
    given = F.when(F.col("_p.error").isNull() & F.col("_p.has_object"), path_value(F.col("_p.payload"), F.lit("arguments")))

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and json.loads(x) == json.loads(y) for x, y in zip(a, b, strict=True)], dtype=bool)

    judged = read.withColumn("_a", given).withColumns({"_s": light_check(F.col("tool_specs"), F.col("_p.name"), F.col("_a")), "_same": same(F.col("_a"), F.col("expected_arguments"))})
    ok, named = F.col("_p.error").isNull(), F.coalesce(F.col("_p.name") == F.col("expected_name"), F.lit(False))
    applies, status = F.col("_s.status") != "not_applicable", F.col("_s.status")
    tenths = 1 + F.when(named, 4).otherwise(0) + F.when(F.col("_same"), 4).otherwise(0) + F.when(applies & (status == "valid"), 1).otherwise(0)
    reward = F.when(ok, F.least(F.lit(1.0), tenths / F.when(applies, 10.0).otherwise(9.0))).otherwise(0.0)
    code = F.when(~ok, F.col("_p.error")).when(~named, "tool_name_mismatch").when(status == "invalid", "schema_invalid").when(~F.col("_same"), "arguments_mismatch")
    out = {"schema_status": F.when(ok, status).otherwise("not_applicable"), "reward": reward, "tool_name_ok": ok & named, "arguments_exact_match": ok & F.col("_same"), "error_code": code}
    return judged.select(*(c for c in samples.columns if c not in out), *(c.alias(n) for n, c in out.items()))
