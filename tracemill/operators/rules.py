"""Row-set validation: rules as conditions, violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def violations(rows: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """(keys, code): a row for each rule that a row breaks, in the rules' order."""
    broken = F.filter(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(code).alias("code"), F.coalesce(c, F.lit(False)).alias("hit")) for i, (code, c) in enumerate(rules))), lambda x: x["hit"])
    return rows.select(*keys, F.explode(broken).alias("_b")).select(*keys, F.col("_b.code").alias("code"))


def report(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: ok, n_rows, n_issues."""
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(found.agg(F.count("*").alias("n_issues"))).withColumn("ok", F.col("n_issues") == 0)


def span_rules(key: str, start: str, end: str, length: str) -> list[Rule]:
    """Spans lie within the text and do not overlap what any earlier span reaches; gaps are allowed."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return [("negative_start", F.col(start) < 0), ("end_before_start", F.col(end) < F.col(start)), ("beyond_text", F.col(end) > F.col(length)), ("overlap", F.col(start) < F.max(end).over(w))]


def checked_spans(rows: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """Violations of span_rules; the windows are computed before the rules are gathered."""
    rules = span_rules(key, start, end, length)
    flagged = rows.withColumns({f"_r{i}": c for i, (_, c) in enumerate(rules)})
    return violations(flagged, [key, start, end], [(code, F.col(f"_r{i}")) for i, (code, _) in enumerate(rules)])


def tokenized_rules(ids: str, attention: str, label: str, mask: str) -> list[Rule]:
    """Parallel arrays of one length; masks of 0 and 1; labels -100 where the mask is 0 and the id where it is 1."""
    zipped = F.arrays_zip(F.col(ids).alias("i"), F.col(label).alias("l"), F.col(mask).alias("m"))
    return [
        ("length_mismatch", (F.size(ids) != F.size(attention)) | (F.size(ids) != F.size(label)) | (F.size(ids) != F.size(mask))),
        ("mask_not_binary", F.exists(mask, lambda m: ~m.isin(0, 1))),
        ("label_not_ignored", F.exists(F.arrays_zip(label, mask), lambda x: (x[mask] == 0) & (x[label] != -100))),
        ("label_not_id", F.exists(F.arrays_zip(ids, label, mask), lambda x: (x[mask] == 1) & (x[label] != x[ids]))),
    ]


def mask_rules(text: str, mask: str, count: str) -> list[Rule]:
    """A mask has one entry for each character and as many ones as the row says."""
    return [("mask_length", F.size(mask) != F.length(text)), ("mask_sum", F.aggregate(mask, F.lit(0), lambda a, m: a + m) != F.col(count))]


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
