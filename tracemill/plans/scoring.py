"""Queries on scores, renderings, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import running_ends, spans_of
from ..functions.numbering import global_row_number
from ..operators import scoring as C
from ..operators import tokens as T
from .registry import query, table


@query("""select event_id, case when event_id % 4 = 0 then case when event_id % 3 = 0 then 1.0 else 0.8 end when event_id % 3 = 0 then case when event_type = 'view' then 0.3 else 0.2 end when event_id % 4 = 1 then 0.0 else 0.1 end as score from events""")
def op_x37_exactmatch(spark, sf_dir):
    i = F.col("event_id")
    answer = F.when(i % 4 == 0, "The Blue!").when(i % 4 == 1, None).otherwise("red")
    text = F.concat(F.lit("<information>It was "), F.when(F.col("event_type") == "view", "a blue one").otherwise("nothing"), F.lit("</information><answer>x</answer>"), F.coalesce(F.concat(F.lit("<answer>"), answer, F.lit("</answer>")), F.lit("")))
    score = C.exact_match(text, F.array(F.lit("blue"), F.lit("azure")), i % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 9).alias("score"))


@query("select event_id, event_id % 6 in (1, 3, 4) as nested from events")
def op_x07_nested(spark, sf_dir):
    """An object in an object, at any depth and through lists; an object in a list alone, plain properties and broken text are not."""
    k = F.col("event_id") % 6
    wrap = lambda before, after: F.concat(F.lit(before), F.col("props"), F.lit(after))
    props = F.when(k == 0, wrap("[1, ", "]")).when(k == 1, wrap('{"a": ', "}")).when(k == 2, wrap('{"a": [', "]}")).when(k == 3, wrap('{"a": [1, {"b": ', "}]}")).when(k == 4, wrap('[[{"x": 1, "y": ', "}]]")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", C.has_nested(props).alias("nested"))


@query("select event_id, case event_id % 5 when 0 then 'metadata.u' || user_id || '[1].Api_Key' when 1 then 'metadata.TOKEN' when 2 then 'metadata.' || event_type || '.in.token' end as path from events")
def op_x20_secretkey(spark, sf_dir):
    """Keys that name secrets, in any letter case, in lists and objects; values and parts of names do not count."""
    k = F.col("event_id") % 5
    body = F.when(k == 0, F.concat(F.lit('{"k": 1, "u'), "user_id", F.lit('": [1, {"x": 2, "Api_Key": "z"}], "token": 3}'))).when(k == 1, F.concat(F.lit('{"TOKEN": '), "props", F.lit("}")))
    body = body.when(k == 2, F.concat(F.lit('{"'), "event_type", F.lit('": {"in": {"token": '), "props", F.lit("}}}"))).when(k == 3, '{"tokens": "token", "key": ["api_key"]}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", C.secret_key(body, ["api_key", "token"]).alias("path"))


@query("select p_partkey, d from (select p_partkey, unnest(['Uses ' || p_name || '.', 'Tool for ' || p_name || ' (' || lower(p_type) || ').', p_name]) as d from part)")
def op_x12_descriptions(spark, sf_dir):
    tidy = F.trim(F.regexp_replace("p_name", r"\s+", " "))
    forms = F.array_distinct(F.array(F.concat(F.lit("Uses "), tidy, F.lit(".")), F.concat(F.lit("Tool for "), tidy, F.lit(" ("), F.lower("p_type"), F.lit(").")), tidy))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(forms).alias("d"))


@query("select e.user_id, e.event_id, p.profile, cast(count(c.event_id) as bigint) as n_context from events e cross join (values ('plain'), ('renamed')) p(profile) left join events c on c.user_id = e.user_id and c.event_id < e.event_id and c.event_type in ('view', 'click') where e.event_type = 'purchase' group by e.user_id, e.event_id, p.profile")
def op_p19_render(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    profiles = spark.createDataFrame([("plain",), ("renamed",)], "profile string")
    return C.rendered(events.where("event_type = 'purchase'"), events.where("event_type in ('view', 'click')"), profiles, "user_id", "event_id")


@query("select p_partkey, cast(place - 1 as int) as place, name from (select p_partkey, unnest(string_split(p_name, ' ')) as name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) as place from part)")
def op_p20_catalog(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ", -1)).alias("place", "name"))


@query("select d.lang, count(*) as n, count(*) filter (l.quality = p.expected) as right from documents d join labels l using (doc_id) join (values ('en', 1), ('fr', 0)) p(lang, expected) on p.lang = d.lang group by d.lang")
def op_j14_predictions(spark, sf_dir):
    expected = spark.createDataFrame([("en", 1), ("fr", 0)], "lang string, expected int")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").join(F.broadcast(expected), "lang")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("expected")).alias("right"))


@query("select event_id, round((value - m) / (s + 0.000001), 6) as grpo, round(value - m - 0.1 * (user_id % 7), 6) as baseline, round(-0.1 * (user_id % 7), 6) as distilled from (select *, avg(value) over (partition by user_id) as m, stddev_samp(value) over (partition by user_id) as s from events) where s is not null")
def op_a25_advantages(spark, sf_dir):
    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumns({"m": F.avg("value").over(w), "s": F.stddev_samp("value").over(w), "kl": F.col("user_id") % 7}).where("s is not null")
    made = {n: C.advantages(k, F.col("value"), F.col("m"), F.col("s"), F.col("kl"), 0.1) for n, k in (("grpo", "grpo"), ("baseline", "reinforce_baseline"), ("distilled", "distillation"))}
    return rows.select("event_id", *(F.round(c, 6).alias(n) for n, c in made.items()))


@query("select event_id, round(0.5 * greatest((v - t) * (v - t), (greatest(o - 0.2, least(o + 0.2, v)) - t) * (greatest(o - 0.2, least(o + 0.2, v)) - t)), 9) as loss from (select event_id, value / 100 as v, (user_id % 3) / 2.0 as o, 0.75 as t from events)")
def op_a26_valueloss(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(C.value_loss(F.col("value") / 100, (F.col("user_id") % 3) / 2.0, F.lit(0.75), 0.2), 9).alias("loss"))


@query("select o_orderkey, case when o_orderpriority = '5-LOW' then case when age > 30 then 'expired' else 'kept' end when o_orderpriority = '1-URGENT' then case when age > 365 then 'expired' else 'kept' end else 'unknown' end as disposition from (select *, date_diff('day', cast(o_orderdate as date), date '1999-01-01') as age from orders)")
def op_v13_cleanup(spark, sf_dir):
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate"))
    return C.cleanup_plan(table(spark, sf_dir, "orders"), {"5-LOW": 30, "1-URGENT": 365}, age, "o_orderpriority").select("o_orderkey", "disposition")


@query("select user_id, count(*) as n from events where user_id not in (select user_id from events group by user_id having arg_max(event_type, event_id) = 'error') group by user_id")
def op_t05_resumed(spark, sf_dir):
    """Users whose last event is an error are finalised; the events of the others go on under the same task."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    seen = events.groupBy("user_id").agg((F.max_by("event_type", "event_id") == "error").alias("finalized")).withColumn("task", F.lit("t"))
    fresh = events.join(seen.where("finalized").select("user_id"), "user_id", "left_anti").withColumn("task", F.lit("t"))
    return C.resumable(seen, fresh, "user_id", ["task"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as types, array_to_string(list_sort([x for x in ['view', 'click', 'refund', 'error'] if not list_contains(list(event_type), x)]), ',') as missing from events group by user_id")
def op_o08_missing(spark, sf_dir):
    wanted = F.array(*(F.lit(x) for x in ("view", "click", "refund", "error")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t")).select("user_id", F.array_join(F.sort_array("t"), ",").alias("types"), F.array_join(F.sort_array(F.array_except(wanted, "t")), ",").alias("missing"))


@query("select user_id, string_agg(event_type, ',' order by first) as types from (select user_id, event_type, min(event_id) as first from events group by user_id, event_type) group by user_id")
def op_o06_firstwins(spark, sf_dir):
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(in_order), ",").alias("types"))


@query("select doc_id, cast(place as bigint) as place from (select doc_id, row_number() over (order by lang, source, n_chars, doc_id) as place from documents)")
def op_o01_bundleorder(spark, sf_dir):
    return global_row_number(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars", "doc_id"], "place").select("doc_id", "place")


@query("select user_id, event_id, kind from (select user_id, event_id, 'failed' as kind from events where event_type = 'error' union all select user_id, event_id, 'completed' from events where event_type = 'purchase')")
def op_o07_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    side = lambda e, k: events.where(F.col("event_type") == e).select("user_id", "event_id", F.lit(k).alias("kind"))
    return side("error", "failed").unionByName(side("purchase", "completed"))


@query("""with c as (select conv_id, turn, text, unnest(range(0, length(text), 4)) as start from conversations where role = 'assistant' and length(text) > 0),
p as (select conv_id, turn, list(cast(start as int) order by start) as ids from c group by conv_id, turn)
select conv_id, turn, cast(len(ids) as bigint) as n_ids, cast(list_sum(ids) as bigint) as id_sum from p""")
def op_a08_unpack(spark, sf_dir):
    """Packs of a conversation's assistant turns come apart into the turns they were made of."""
    rows = T.chunk_tokens(table(spark, sf_dir, "conversations").where("role = 'assistant'"))
    each = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("start")).alias("ids"))
    packs = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ids"))).alias("m"))
    packs = packs.withColumn("spans", spans_of(running_ends(F.transform("m", lambda x: F.size(x["ids"]))), "int"))
    packed = packs.select("conv_id", F.transform("m", lambda x: x["turn"]).alias("turns"), F.flatten(F.transform("m", lambda x: x["ids"])).alias("ids"), "spans")
    out = T.unpack(packed, "ids", "spans")
    return out.select("conv_id", F.element_at("turns", F.col("member") + 1).alias("turn"), F.size("part").cast("long").alias("n_ids"), F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))
