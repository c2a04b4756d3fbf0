"""Queries on records as they are read, projected, scored and validated."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbering import global_row_number
from ..functions.plugins import apply_filter
from ..functions.storage import fresh_path
from ..operators import metrics as G
from ..operators import records as P
from ..operators import rl as R
from ..operators import rules as V
from ..operators import text as X
from ..operators import tokens as T
from ..sources import records as S
from .registry import query, table


def _folder(spark, kind: str) -> str:
    return fresh_path(spark, kind) + ".jsonl"


@query("select event_id, user_id, event_type from events")
def op_s01_jsonl(spark, sf_dir):
    path = _folder(spark, "s01")
    S.append_records(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path)
    return S.read_records(spark, path, "event_id long, user_id long, event_type string")


@query("select event_id, event_type from events order by event_id limit 50 offset 100")
def op_s02_slice(spark, sf_dir):
    path = _folder(spark, "s02")
    S.append_records(table(spark, sf_dir, "events").select("event_id", "event_type"), path)
    return S.read_slice(spark, f"{path}@[100:150]", "event_id long, event_type string", "event_id")


@query("select conv_id, turn, role from conversations")
def op_s03_strict(spark, sf_dir):
    path = _folder(spark, "s03")
    S.append_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), path)
    return S.read_strict(spark, path, "conv_id long, turn long, role string")


@query()
def op_s13_epochs(spark, sf_dir):
    return S.epoch_slice(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 30, 100, seed=3, copies=2)


@query("""select event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' as line from events""")
def op_k02_canonical(spark, sf_dir):
    path = _folder(spark, "k02")
    S.write_canonical(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("line"))


@query("select cast(doc_id as varchar) as name, case when doc_id % 5 = 0 then 'missing' else 'changed' end as fault from documents where doc_id % 5 = 0 or doc_id % 7 = 0")
def op_k06_bundle(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))
    found = files.where("cast(name as long) % 5 <> 0").withColumn("digest", F.when(F.col("name").cast("long") % 7 == 0, "x").otherwise(F.col("digest")))
    return S.bundle_faults(files, found)


@query("select event_id, case when event_type = 'purchase' then 'completed' when event_type in ('error', 'click') then 'failed' else 'pending' end as status from events")
def op_p08_status(spark, sf_dir):
    from ..operators.messages import status_name

    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "timeout").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", status_name(kind).alias("status"))


@query("select conv_id, string_agg(text, chr(10) order by turn) filter (text <> '') as content from conversations group by conv_id")
def op_p10_content(spark, sf_dir):
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(P.joined_parts(parts).alias("content"))


@query("select item_id, part, piece from (select item_id, unnest(string_split(text, ', ')) as piece, unnest(range(1, len(string_split(text, ', ')) + 1)) as part from benchmark)")
def op_p11_placeholders(spark, sf_dir):
    items = F.transform(F.slice(F.split("text", ", ", -1), F.lit(2), F.greatest(F.size(F.split("text", ", ", -1)) - 1, F.lit(0))), lambda x: F.length(x))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(P.placeholder_parts(F.col("text"), ", ", items)).alias("at", "p"))
    return rows.select("item_id", (F.col("at") + 1).cast("long").alias("part"), F.col("p.text").alias("piece"))


@query("select event_id, case when event_type = 'error' then 0 else cast(user_id % 7 as int) end as mask_sum, cast(user_id % 7 as int) as mask_length, case when event_type = 'click' then 1 else 0 end as truncated from events")
def op_p12_traincolumns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("n"), F.lit(None).cast("array<int>").alias("mask"), (F.col("event_type") == "error").alias("removed"), F.when(F.col("event_type") == "click", "truncated").otherwise("completed").alias("status"))
    out = P.train_columns(rows, "tokens", "n", "mask", "removed", "status")
    return out.select("event_id", F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("mask_sum"), F.size("mask").alias("mask_length"), "truncated")


@query("select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else lang end, ''), source) as source_name from documents")
def op_p13_provenance(spark, sf_dir):
    preferred = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", P.first_filled(preferred, F.col("source")).alias("source_name"))


@query("select event_id, case when user_id % 2 = 0 then 'new' else json_extract_string(props, '$.k') end as k, event_type as kind from events")
def op_p15_override(spark, sf_dir):
    base = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"))
    over = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new")))
    return table(spark, sf_dir, "events").select("event_id", P.merged_maps(base, over).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"))


@query("select conv_id, turn, role, case when role = 'system' then length(text) end as meta from conversations")
def op_p16_contextrow(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "system", F.length("text").cast("long")).alias("meta"))


@query("select conv_id, cast(count(*) filter (role = 'assistant') as bigint) as n_targets from conversations group by conv_id having count(*) filter (role = 'assistant') > 0")
def op_p17_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_targets")).where("n_targets > 0")


@query("select conv_id, first(text order by turn) as prompt, arg_max(text, turn) filter (role = 'assistant') as label from conversations where role in ('user', 'assistant') group by conv_id")
def op_p21_remap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("label"))


@query("select coalesce(round(avg(case when event_type = 'view' then 1 else 0 end), 9), 0.0) as name_rate, coalesce(round(avg(case when event_type = 'view' and value > 50 then 1 else 0 end), 9), 0.0) as exact_rate, count(*) as n from events")
def op_g07_toolmetrics(spark, sf_dir):
    name = F.col("event_type") == "view"
    rate = lambda c: F.coalesce(F.round(F.avg(c.cast("int")), 9), F.lit(0.0))
    return table(spark, sf_dir, "events").agg(rate(name).alias("name_rate"), rate(name & (F.col("value") > 50)).alias("exact_rate"), F.count("*").alias("n"))


@query("select cast(sum(n) as bigint) as issues, count(*) filter (n > 60) as busy, round(sum(m * n) / greatest(sum(n), 1), 4) as weighted from (select user_id, count(*) as n, avg(value) as m from events group by user_id)")
def op_g11_audit(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return runs.agg(F.sum("n").alias("issues"), F.count_if(F.col("n") > 60).alias("busy"), F.round(F.sum(F.col("m") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)), 4).alias("weighted"))


@query("select o_custkey, count(*) as runs, count(*) filter (o_orderstatus = 'F') as passed, count(*) filter (o_orderstatus = 'P') as pending, count(*) filter (o_totalprice > 300000) as large from orders group by o_custkey")
def op_g13_pertask(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("runs"), F.count_if(s == "F").alias("passed"), F.count_if(s == "P").alias("pending"), F.count_if(F.col("o_totalprice") > 300_000).alias("large"))


@query("select o_orderpriority, count(*) filter (o_orderstatus = 'P') = 0 as contract_ok, count(*) as n, max(o_orderdate) as newest from orders group by o_orderpriority")
def op_g16_campaign(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("contract_ok"), F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))


@query("select lang, round(avg(n_chars), 6) as mean_length, max(n_chars) as max_length, round(avg(case when n_chars >= 8000 then 1 else 0 end), 9) as truncated_ratio from documents group by lang")
def op_g21_samplemetrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean_length"), F.max("n_chars").alias("max_length"), F.round(F.avg((F.col("n_chars") >= 8000).cast("int")), 9).alias("truncated_ratio"))


@query("select case when length(text) > 400 then 'long' when text = '' then 'empty' else 'short' end as class, role as kind, count(*) as n, cast(sum(length(text)) as bigint) as size from conversations group by all")
def op_g31_kinds(spark, sf_dir):
    """Artifacts of each retention class by kind, with their size."""
    n = F.length("text")
    kept = F.when(n > 400, "long").when(n == 0, "empty").otherwise("short")
    return table(spark, sf_dir, "conversations").groupBy(kept.alias("class"), F.col("role").alias("kind")).agg(F.count("*").alias("n"), F.sum(n).alias("size"))


@query("select 'sessions' as counter, count(distinct user_id) as n from events union all select 'requests', count(*) from events union all select 'skipped', count(*) from events where event_type = 'error' union all select 'types', count(distinct event_type) from events")
def op_g38_buildcounters(spark, sf_dir):
    one = table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("sessions"), F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("skipped"), F.count_distinct("event_type").alias("types"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in one.columns))).alias("x")).select("x.counter", "x.n")


@query("select count(*) as n_rows, count(*) filter (text = '' or length(text) < 100) as invalid, count(*) filter (not (text = '' or length(text) < 100)) as valid from conversations")
def op_g40_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    bad = V.violations(rows, ["conv_id", "turn"], [("short", F.length("text") < 100), ("empty", F.col("text") == "")]).select("conv_id", "turn").distinct()
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(bad.agg(F.count("*").alias("invalid"))).withColumn("valid", F.col("n_rows") - F.col("invalid"))


@query("select (select count(*) from events) as n_events, (select round(avg(quality), 9) from labels) as pass_rate, (select count(*) from labels where toxic = 1) = 0 as clean")
def op_g42_credibility(spark, sf_dir):
    events = table(spark, sf_dir, "events").agg(F.count("*").alias("n_events"))
    labels = table(spark, sf_dir, "labels").agg(F.round(F.avg("quality"), 9).alias("pass_rate"), (F.count_if(F.col("toxic") == 1) == 0).alias("clean"))
    return events.crossJoin(labels)


@query("select conv_id, string_agg(text, chr(10) order by turn desc) as text, cast(0 as bigint) as missing from conversations group by conv_id")
def op_j10_reconstruct(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("entry", F.concat_ws(":", "conv_id", "turn"))
    contexts = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "entry")), asc=False), lambda x: x["entry"]).alias("ids"))
    return P.reconstructed(contexts, rows.select("entry", "text"), "conv_id", "ids", "entry", "text")


@query("select a.event_id, a.event_type = b.event_type as same_type, a.user_id = b.user_id as same_user from (select *, row_number() over (order by event_id) as rn from events) a join (select *, row_number() over (order by event_id desc) as rn from events) b using (rn)")
def op_j15_zip(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    one = global_row_number(events, ["event_id"])
    two = global_row_number(events.withColumn("k", -F.col("event_id")), ["k"]).select("rn", F.col("event_type").alias("t"), F.col("user_id").alias("u"))
    return one.join(two, "rn").select("event_id", (F.col("event_type") == F.col("t")).alias("same_type"), (F.col("user_id") == F.col("u")).alias("same_user"))


@query("select d.doc_id, coalesce(l.quality, d.doc_id % 2) as value, l.quality is not null and l.quality <> d.doc_id % 2 as conflict from documents d left join labels l using (doc_id)")
def op_j19_sidecar(spark, sf_dir):
    asserted = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("claim"))
    both = asserted.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("truth")), "doc_id", "left")
    return both.select("doc_id", F.coalesce("truth", "claim").alias("value"), (F.col("truth").isNotNull() & ~F.col("truth").eqNullSafe(F.col("claim"))).alias("conflict"))


@query("select event_id, case when event_type = 'error' then 'parse_error' when event_type = 'signup' then 'wrong_tool' when value > 100 then 'wrong_arguments' else 'exact' end as outcome from events")
def op_x02_score(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", P.outcome_code([("parse_error", e == "error"), ("wrong_tool", e == "signup"), ("wrong_arguments", F.col("value") > 100)], "exact").alias("outcome"))


@query("select event_id, case when event_type = 'error' then 'not_applicable' when cast(json_extract_string(props, '$.k') as int) is not null and json_type(props, '$.k') in ('UBIGINT', 'BIGINT') then 'valid' else 'invalid' end as verdict from events")
def op_x04_lightschema(spark, sf_dir):
    v = F.try_parse_json("props")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "not_applicable").when(kind == "BIGINT", "valid").otherwise("invalid").alias("verdict"))


@query("select event_id, json_extract_string('{\"a\":{\"b\":' || props || '}}', '$.a.b.k') as leaf from events")
def op_x06_path(spark, sf_dir):
    v = F.parse_json(F.concat(F.lit('{"a":{"b":'), F.col("props"), F.lit("}}")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.a.b.k", "string").alias("leaf"))


@query("select l_orderkey, l_linenumber, cast(new as int) as new from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by sha256('7:' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int), l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int) as new, row_number() over (partition by l_orderkey order by l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int) as old from lineitem) where l_orderkey in (select l_orderkey from (select l_orderkey, row_number() over (partition by l_orderkey order by sha256('7:' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int)) as a, row_number() over (partition by l_orderkey order by l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::int) as b from lineitem) where a <> b)")
def op_x13_reorder(spark, sf_dir):
    """Orders whose hash order differs from the old one; the others are rotated."""
    name = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"))
    out = P.stable_order(rows, "l_orderkey", "name", "7")
    digest_order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.sha2(F.concat_ws(":", F.lit("7"), "name"), 256)))
    changed = out.withColumn("d", digest_order).where("d <> old").select("l_orderkey").distinct()
    return out.join(changed, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "new")


#: Documents that end in an answer of some form, or in none.
_SAID = "text || chr(10) || case doc_id % 6 when 0 then 'So the answer is (' || chr(cast(65 + doc_id % 9 as int)) || ').' when 1 then 'I pick (' || chr(cast(65 + doc_id % 4 as int)) || ') here' when 2 then 'well, ' || chr(cast(65 + doc_id % 5 as int)) when 3 then 'Answer: b' when 4 then 'ANSWER : ' || source || chr(10) || 'answer:  ' || lang || ' ' else '' end"


@query(f"select doc_id, coalesce(nullif(upper(regexp_extract(said, '(?i)answer\\s*(?:is|:)\\s*\\(?([A-J])\\)?', 1)), ''), nullif(upper(regexp_extract(said, '\\(([A-J])\\)', 1)), ''), nullif(upper(regexp_extract(said, '(?:^|\\s)([A-J])(?:[.)]|\\s*$)', 1)), '')) as letter from (select doc_id, {_SAID} as said from documents)")
def op_x23_choice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.choice_letter(F.expr(_SAID.replace("chr(10)", "char(10)").replace("chr(cast", "char(cast"))).alias("letter"))


@query(f"select doc_id, coalesce(trim(regexp_extract_all(right(said, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1]), '[INVALID]') as answer from (select doc_id, {_SAID} as said from documents)")
def op_x24_final(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.final_answer(F.expr(_SAID.replace("chr(10)", "char(10)").replace("chr(cast", "char(cast"))).alias("answer"))


@query("select event_id, case event_type when 'view' then value when 'click' then value * 2 else 0.0 end as reward from events")
def op_x27_dispatch(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", P.dispatched(kind, {"view": F.col("value"), "click": F.col("value") * 2, "none": F.lit(0.0)}).alias("reward"))


@query("""with s as (select user_id, event_id, case event_type when 'signup' then 'start' when 'purchase' then 'stop' else 'delta' end as kind, cast(event_id as varchar) || ';' as data from events),
b as (select *, cast(sum(case when kind = 'start' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as block from s)
select user_id, block, coalesce(string_agg(data, '' order by event_id) filter (kind = 'delta'), '') as text, bool_or(kind = 'stop') as closed, case when block = 0 then 'unknown' else 'block' end as kind from b group by user_id, block""")
def op_x30_assembly(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "stop").otherwise("delta")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("k"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("data"))
    return P.block_assembly(rows, "user_id", "event_id", "k", "data")


@query("select l_orderkey, cast(old as int) as place, cast(new as int) as value from (select l_orderkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber) as old, row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey, l_suppkey, l_linenumber) as new from lineitem)")
def op_a13_inverse(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w.orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber")).alias("value"), F.row_number().over(w.orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")).alias("place"))
    return P.inverse_permutation(rows, "l_orderkey", "place", "value")


@query("""with recursive r as (select doc_id // 250 as step, doc_id % 4 as rank, n_chars as n, row_number() over (partition by doc_id // 250, doc_id % 4 order by doc_id) as rn from documents),
walk as (select step, rank, rn, [n] as bins from r where rn = 1
union all select r.step, r.rank, r.rn, case when len([b for b in w.bins if b + r.n <= 40000]) = 0 then list_append(w.bins, r.n) else [case when i = list_position([b + r.n <= 40000 for b in w.bins], true) then b + r.n else b end for b, i in w.bins] end from walk w join r on r.step = w.step and r.rank = w.rank and r.rn = w.rn + 1),
c as (select step, rank, len(bins) as n from walk qualify row_number() over (partition by step, rank order by rn desc) = 1)
select step, rank, cast(n as int) as n_micro, cast(max(n) over (partition by step) as int) as n_step from c""")
def op_a15_microbatches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 250).alias("step"), (F.col("doc_id") % 4).alias("rank"))
    return P.microbatch_plan(rows, "rank", "step", "doc_id", "n_chars", 40_000)


@query("select event_id, round(case when w > 2.0 then 2.0 else w end, 9) as tis, round(case when w < 0.5 or w > 2.0 then 0.0 else w end, 9) as icepop from (select event_id, exp((value - 50) / 40) as w from events)")
def op_a24_tis(spark, sf_dir):
    x = (F.col("value") - 50) / 40
    return table(spark, sf_dir, "events").select("event_id", F.round(R.importance_weight(x, "truncate", 0.0, 2.0), 9).alias("tis"), F.round(R.importance_weight(x, "mask", 0.5, 2.0), 9).alias("icepop"))


@query("select conv_id, cast(len(m) - list_position(m, 1) + 1 as bigint) as response_length, cast(list_sum(m) as bigint) as n_trained from (select conv_id, list(case when role = 'assistant' then 1 else 0 end order by turn) as m from conversations group by conv_id) where list_contains(m, 1)")
def op_p09_window(spark, sf_dir):
    mask = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: (x["role"] == "assistant").cast("int"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(mask.alias("m")).where(F.array_contains("m", 1)).select("conv_id", P.response_window(F.col("m"), F.col("m")).alias("w"))
    return rows.select("conv_id", "w.response_length", F.aggregate("w.loss_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_trained"))


@query("select conv_id, 'mask_length' as code from conversations where conv_id % 9 = 0 group by conv_id union all select conv_id, 'mask_sum' from conversations where conv_id % 4 = 0 or conv_id % 9 = 0 group by conv_id")
def op_v05_masks(spark, sf_dir):
    """Masks that were cut or miscounted on purpose are found."""
    from ..operators import messages as M

    rows = M.char_mask(M.segments(table(spark, sf_dir, "conversations"), trainable=("assistant", "user", "system")), "conv_id", "turn")
    bent = rows.select("conv_id", "text", F.when(F.col("conv_id") % 9 == 0, F.slice("mask", 1, 3)).otherwise(F.col("mask")).alias("mask"), (F.length("text") + F.when(F.col("conv_id") % 4 == 0, 1).otherwise(0)).alias("n"))
    return V.violations(bent, ["conv_id"], V.mask_rules("text", "mask", "n"))


@query("select doc_id, side from (select doc_id, 'removed' as side from labels where quality = 0 union all select doc_id, 'added' from documents where doc_id not in (select doc_id from labels))")
def op_v12_drift(spark, sf_dir):
    before = table(spark, sf_dir, "labels").select("doc_id")
    new = table(spark, sf_dir, "documents").select("doc_id").join(before, "doc_id", "left_anti")
    return G.drift(before, table(spark, sf_dir, "labels").where("quality <> 0").select("doc_id").union(new))


def large_values(least: float):
    """A condition that u01 loads by its path."""
    return F.col("value") > least


@query("select event_id from events where value > 100")
def op_u01_plugin(spark, sf_dir):
    return apply_filter(table(spark, sf_dir, "events"), "tracemill.plans.records.large_values", least=100).select("event_id")


@query("select o_orderkey, o_orderstatus = 'F' as passed from orders where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having count(*) > 1)")
def op_o09_jobs(spark, sf_dir):
    many = V.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(many, "o_orderkey", "left_semi").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("passed"))


@query("select item_id, cast(start as bigint) as start, label from (select item_id, start, case when start >= 8 then cast(cast('0x' || substr(sha256(substr(text, cast(start as bigint) + 1, 4)), 1, 16) as ubigint) % 31996 + 4 as bigint) else -100 end as label from (select item_id, text, unnest(range(0, length(text), 4)) as start from benchmark))")
def op_a03_labels(spark, sf_dir):
    rows = T.chunk_tokens(table(spark, sf_dir, "benchmark"))
    spans = table(spark, sf_dir, "benchmark").select("item_id", F.lit(8).alias("start"), F.length("text").alias("end"), F.lit(True).alias("trainable"))
    return T.token_mask(rows, spans, "item_id").select("item_id", F.col("start").cast("long").alias("start"), "label")

