"""Line deduplication with a fixed-depth template tree, in DataFrame functions only.

A line is parsed by its number of tokens, then by its leading tokens, to a leaf. Tokens that hold a
digit are variable fields and read as <*>. A leaf holds any number of templates: in a leaf that many
lines reach, each line keeps the tokens after the leading ones that most lines of the leaf have at
the same place, as many as `similarity` of the line calls for, and the rest are variable fields. If
each token kept is that of min_docs lines or more, these tokens are the line's template; otherwise the
masked line is a template of its own, as it is in any other leaf. Lines of another kind in the same leaf
change nothing about that. A template that recurs in min_docs documents or more is dropped from all of
them but the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, text_or_empty

FIELD = "<*>"


_BLANK = " \t\r\x0b\f"


def masked(line: Column) -> Column:
    """The line with white space runs as one space and every token with an ASCII digit as <*>."""
    odd = F.contains(line, F.lit("  "))
    for c in _BLANK[1:]:
        odd |= F.contains(line, F.lit(c))
    tidy = F.trim(F.when(odd, F.regexp_replace(line, "[ \\t\\r\\x0b\\f]+", " ")).otherwise(line))
    return F.when(tidy.rlike("[0-9]"), F.regexp_replace(tidy, "[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(tidy)


def _n_tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, body, place, line, template, leaf) of every non-blank line, masked; template and leaf are 64-bit hashes."""
    lines = docs.select("doc_id", "body", F.posexplode(F.split("_text", "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("line", masked(F.col("line"))).where("line <> ''")
    return lines.withColumns({"template": F.xxhash64("line"), "leaf": F.xxhash64(_n_tokens(F.col("line")), F.substring_index("line", " ", depth))})


def _templates(lines: DataFrame, crowded: DataFrame, min_docs: int, depth: int, percent: int, broadcast_rows: int) -> DataFrame:
    """(leaf, template, key) of the masked lines of crowded leaves that have a template with variable fields; key is the template's hash."""
    few = crowded.count() <= broadcast_rows  # 8 bytes a row
    own = lines.join(F.broadcast(crowded) if few else crowded, "leaf")
    # From here on a masked line counts once, with the number of its occurrences.
    distinct = checkpointed(own.groupBy("leaf", "template").agg(F.min("line").alias("line"), F.count("*").alias("n")).withColumn("tokens", F.split("line", " ", -1)).where(F.size("tokens") > depth).drop("line"))
    kept = F.greatest(F.lit(1), F.floor((F.size("tokens") * percent + 99) / 100).cast("int") - depth)
    tokens = distinct.select("leaf", "template", "n", kept.alias("kept"), F.posexplode(F.slice("tokens", F.lit(depth + 1), F.size("tokens"))).alias("at", "token")).withColumn("token", F.xxhash64("token"))
    # Stored, so that the join deals out both sides anew and can split a token that many lines have.
    often = checkpointed(tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("support")).where(F.col("support") >= min_docs))
    held = tokens.join(often, ["leaf", "at", "token"]).groupBy("leaf", "template", "kept").agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), "at", "token"))).alias("held")).where(F.size("held") >= F.col("kept"))
    return held.select("leaf", "template", F.xxhash64("leaf", F.array_sort(F.transform(F.slice("held", F.lit(1), F.col("kept")), lambda x: F.xxhash64(x["at"], x["token"])))).alias("key"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, similarity: float = 0.7, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with text cut to the lines that stay, and n_lines and n_dropped (of non-blank lines).

    Lines end at \\n. The document with the smallest doc_id keeps a recurring template's lines, a
    null doc_id coming last; lines that one document repeats do not recur by that. Blank lines stay. Null
    texts stay null with 0 lines, empty texts stay empty; rows that repeat a doc_id with another
    text are documents of their own, and rows that repeat both count as one and are treated alike;
    an empty table gives no rows. Other columns are kept; n_lines and n_dropped replace columns of
    that name. Texts and lines may be of any length. Of leaves of min_docs lines or more up to
    broadcast_rows are broadcast, more are joined by shuffle.
    """
    docs = docs.drop("n_lines", "n_dropped")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), text_or_empty().alias("_text"))
    lines = _lines(base, depth)
    # A document's lines lie in one task, so this combines before the shuffle.
    once = checkpointed(lines.groupBy("doc_id", "body", "leaf", "template").agg(F.collect_set("place").alias("places")))
    crowded = checkpointed(
        once.groupBy("leaf").agg(F.count("*").alias("n"), F.min("template").alias("lo"), F.max("template").alias("hi")).where((F.col("n") >= min_docs) & (F.col("lo") < F.col("hi"))).select("leaf")
    )
    merged = checkpointed(_templates(lines, crowded, min_docs, depth, round(100 * similarity), broadcast_rows))
    keyed = checkpointed(once.join(merged, ["leaf", "template"], "left").select("doc_id", "body", F.coalesce("key", "template").alias("key"), "places"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")
    recurring = keyed.groupBy("key", "doc_id", "body").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") >= min_docs)
    # Stored, so that the join deals out both sides anew and can split a template that many documents hold.
    recurring = checkpointed(recurring.select("key", "first"))
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body")))
    dropped = keyed.join(recurring, "key").where(later).groupBy("doc_id", "body").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    # One byte a line up to the last that goes, so that each line is looked up in one step however many go.
    before = F.concat(F.array(F.lit(-1)), F.slice("places", F.lit(1), F.size("places") - 1))
    marks = F.zip_with("places", before, lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1")))
    cut = dropped.select("doc_id", "body", F.size("places").cast("long").alias("n"), F.array_join(marks, "").cast("binary").alias("cut"))
    names = [free_name(docs, c) for c in ("_key_id", "_key_null", "_key_body", "_cut", "_n_cut")]
    gone, n_gone = names[3:]
    # A null doc_id joins under a number that stands beside a flag.
    plain = lambda c: [F.coalesce(c, F.lit(0).cast("long")).alias(names[0]), c.isNull().alias(names[1])]
    left = docs.select("*", *plain(F.col("doc_id").cast("long")), F.xxhash64("text").alias(names[2]))
    right = cut.select(*plain(F.col("doc_id")), F.col("body").alias(names[2]), F.col("cut").alias(gone), F.col("n").alias(n_gone))
    joined = left.join(right, names[:3], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: F.substring(F.col(gone), i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.size(F.filter(F.split(text_or_empty(), "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")).cast("long")
    return joined.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), n_lines.alias("n_lines"), F.coalesce(n_gone, F.lit(0).cast("long")).alias("n_dropped"))


#: The same in DuckDB: min_docs 10, depth 3, similarity 0.7.
ORACLE = r"""
with base as (select doc_id, md5(coalesce(text, '')) as body, coalesce(text, '') as text from documents),
parts as (select doc_id, body, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from base),
tidy as (select doc_id, body, place, trim(regexp_replace(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    '), '  +', ' ', 'g')) as line from parts),
masked as (select distinct doc_id, body, place, regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g') as line from tidy where line <> ''),
lines as (select *, len(string_split(line, ' ')) || ':' || array_to_string(string_split(line, ' ')[1:3], ' ') as leaf from masked),
once as (select distinct doc_id, body, leaf, line from lines),
crowded as (select leaf from once group by leaf having count(*) >= 10 and count(distinct line) > 1),
occurring as (select leaf, line, count(*) as n from lines semi join crowded using (leaf) group by leaf, line),
tokens as (select leaf, line, n, greatest(1, (len(string_split(line, ' ')) * 70 + 99) // 100 - 3) as kept, unnest(string_split(line, ' ')) as token, unnest(range(len(string_split(line, ' ')))) as spot from occurring),
often as (select leaf, spot, token, sum(n) as support from tokens where spot >= 3 group by leaf, spot, token having sum(n) >= 10),
ranked as (select leaf, line, kept, spot, token, row_number() over (partition by leaf, line order by support desc, spot) as r from tokens join often using (leaf, spot, token)),
merged as (select leaf, line, string_agg(spot || ':' || token, ' ' order by spot) as template from ranked where r <= kept group by leaf, line, kept having count(*) = kept),
keyed as (select doc_id, body, place, case when m.leaf is null then 'line ' || lines.line else 'leaf ' || lines.leaf || ' ' || m.template end as key from lines left join merged m on m.leaf = lines.leaf and m.line = lines.line),
recurring as (select key, min(doc_id) as first_id from keyed group by key having count(distinct struct_pack(d := doc_id, b := body)) >= 10),
cut as (select keyed.doc_id, body, list(place) as places from keyed join recurring using (key) where doc_id <> first_id group by keyed.doc_id, body)
select base.doc_id,
  case when places is null then text else coalesce(array_to_string([x for x, i in string_split(text, chr(10)) if not list_contains(places, i - 1)], chr(10)), '') end as text,
  cast(len([x for x in string_split(text, chr(10)) if trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> '']) as bigint) as n_lines,
  cast(coalesce(len(places), 0) as bigint) as n_dropped
from base left join cut on cut.doc_id = base.doc_id and cut.body = base.body
"""
