"""Queries on the event log, orders and labels as runs, rewards and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import global_row_number
from ..operators import filters as L
from ..operators import metrics as G
from ..operators import ordered as W
from .registry import query, table

SUM = "cast(sum(cast({0} as decimal(18,2))) as double)"
LABELLED = "select d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id)"


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")


# ---- filters and samples


@query(f"select doc_id, source from ({LABELLED}) where coalesce(quality = 1, false) = false and n_chars >= 100 and lang in ('en', 'de')")
def op_f01_filter(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumn("passed", F.col("quality") == 1)
    keep = L.RunFilter(statuses=("en", "de"), verifier_passed=False, min_reward=100).condition(status="lang", reward="n_chars")
    return rows.where(keep).select("doc_id", "source")


@query(f"""select source, count(*) as n, coalesce(round(stddev_samp(quality), 6) > 0.000001, false) as kept, case when coalesce(stddev_samp(quality) > 0.000001, false) then null else 'zero_std_' || min(quality) end as reason
from ({LABELLED}) where quality is not null group by source""")
def op_f03_varied(spark, sf_dir):
    return L.varied_groups(_labelled(spark, sf_dir).where("quality is not null"), "source", "quality").select("source", "n", "kept", "reason")


@query(f"""select reason, count(*) as n from (select case when quality is null then 'no_label' when toxic = 1 then 'toxic' when quality = 0 then 'low_quality' else 'kept' end as reason from ({LABELLED})) group by reason""")
def op_f04_reasons(spark, sf_dir):
    return L.reason_counts(_labelled(spark, sf_dir), [("no_label", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("low_quality", F.col("quality") == 0)])


@query("""select user_id, first_id from (select user_id, min(event_id) as first_id, stddev_samp(value) > 0.000001 as kept from events group by user_id) where kept order by first_id limit 32""")
def op_f05_oversample(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = L.varied_groups(events, "user_id", "value").where("kept").join(events.groupBy("user_id").agg(F.min("event_id").alias("first_id")), "user_id")
    return L.first_groups(kept.select("user_id", "first_id"), "first_id", 32)


@query("select event_id from (select event_id, row_number() over (order by event_id) as rn, count(*) over () as n from events) where rn <= n // 64 * 64")
def op_f06_trim(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return L.trim_to_multiple(global_row_number(events, ["event_id"]), "rn", events.count(), 64).select("event_id")


@query("select event_id from (select event_id, row_number() over (order by event_id) as rn, count(*) over () as n from events) where rn <= 3 or rn > n - 4")
def op_f07_headtail(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return L.head_and_tail(global_row_number(events, ["event_id"]), "rn", events.count(), 7).select("event_id")


@query("select conv_id from conversations group by conv_id having count(*) >= 4 and count(*) filter (trim(text) <> '') >= 4")
def op_f08_valid(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("filled")).where("n >= 4 and filled >= 4").select("conv_id")


@query("""with skips as (select user_id, count(*) as k from events where event_type = 'error' group by user_id)
select event_id from (select e.event_id, e.user_id, row_number() over (partition by user_id order by event_id) as rn from events e) e left join skips using (user_id) where rn > coalesce(k, 0)""")
def op_f09_skiplist(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return L.skip_occurrences(events, events.where("event_type = 'error'").select("user_id"), "user_id", "event_id").select("event_id")


@query("select page_id from pages where regexp_matches(url, '^http.*/en/.*$') and not regexp_matches(url, '^.*casino.*$') and not regexp_matches(url, '(^|/)\\.\\.(/|$)')")
def op_f10_globs(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(L.glob_condition(F.col("url"), ["http*/en/*"], ["*casino*"])).select("page_id")


@query(f"""select "group", doc_id, cast(place as int) as place from (select coalesce(cast(quality as varchar), '<missing>') as "group", doc_id, row_number() over (partition by coalesce(cast(quality as varchar), '<missing>') order by doc_id) as place from ({LABELLED})) where place <= 5""")
def op_f11_probe(spark, sf_dir):
    return L.first_of_each(_labelled(spark, sf_dir), F.col("quality").cast("string"), "doc_id", 5).select("group", "doc_id", "place")


@query(f"select doc_id, source from ({LABELLED}) where quality = 0 order by doc_id limit 20")
def op_f13_failed(spark, sf_dir):
    return _labelled(spark, sf_dir).where("quality = 0").orderBy("doc_id").limit(20).select("doc_id", "source")


@query(f"select source, coalesce(bool_or(toxic = 1), false) as any_toxic, coalesce(bool_and(quality = 1), false) as all_good, count(*) filter (quality = 1) >= 10 as enough from ({LABELLED}) group by source")
def op_f14_gates(spark, sf_dir):
    no = F.lit(False)
    return _labelled(spark, sf_dir).groupBy("source").agg(F.coalesce(F.bool_or(F.col("toxic") == 1), no).alias("any_toxic"), F.coalesce(F.bool_and(F.col("quality") == 1), no).alias("all_good"), (F.count_if(F.col("quality") == 1) >= 10).alias("enough"))


# ---- aggregations


@query(f"""select source, coalesce(min(cast(quality as double)), 0.0) as min, coalesce(max(cast(quality as double)), 0.0) as max, coalesce({SUM.format('quality')} / nullif(count(quality), 0), 0.0) as mean, coalesce({SUM.format('quality')}, 0.0) as total, count(quality) as count from ({LABELLED}) group by source""")
def op_g01_summary(spark, sf_dir):
    return G.summary(_labelled(spark, sf_dir), "quality", "source")


@query("select user_id, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'click') as click from events group by user_id")
def op_g02_status(spark, sf_dir):
    return G.bucket_counts(table(spark, sf_dir, "events"), "event_type", ["purchase", "error", "view", "click"], "user_id")


@query(f"select lang, count(*) filter (quality = 1) as passed, count(*) filter (quality = 0) as failed from ({LABELLED}) group by lang")
def op_g03_verifier(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"))


@query(f"select count(*) as n, count(distinct source) as n_sources, array_to_string(list_sort(list(distinct lang)), ',') as langs, count(*) filter (quality = 1) as passed, coalesce(max(n_chars), 0) as longest from ({LABELLED})")
def op_g04_manifest(spark, sf_dir):
    return _labelled(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.count_if(F.col("quality") == 1).alias("passed"), F.coalesce(F.max("n_chars"), F.lit(0).cast("long")).alias("longest"))


@query("select event_type, round(avg(value), 6) as mean, count(*) as count from events group by event_type")
def op_g05_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return G.merge_means(parts, "mean", "n", "event_type").select("event_type", F.round("mean", 6).alias("mean"), "count")


@query("""select event_type, count(*) as n, round(avg(case when value >= 50 then 1 else 0 end), 9) as large_rate, round(avg(case when user_id % 2 = 0 then 1 else 0 end), 9) as even_rate, cast(grouping(event_type) as boolean) as overall from events group by rollup (event_type)""")
def op_g06_rollup(spark, sf_dir):
    r = G.rates(table(spark, sf_dir, "events"), "event_type", {"large_rate": F.col("value") >= 50, "even_rate": F.col("user_id") % 2 == 0})
    return r.select("event_type", "n", F.round("large_rate", 9).alias("large_rate"), F.round("even_rate", 9).alias("even_rate"), "overall")


@query("select lang, source, count(*) as n from documents group by grouping sets ((lang), (source), (lang, source))")
def op_g08_sets(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("g08_documents")
    return spark.sql("select lang, source, count(*) as n from g08_documents group by grouping sets ((lang), (source), (lang, source))")


@query("select event_type, array_to_string(list_sort(list(u || ':' || n)), ',') as users from (select event_type, user_id % 5 as u, count(*) as n from events group by event_type, user_id % 5) group by event_type")
def op_g09_nested(spark, sf_dir):
    inner = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("u")).agg(F.count("*").alias("n"))
    return inner.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "u", "n"))), ",").alias("users"))


@query(f"select source, reason, count(*) as n from (select source, case when quality is null then 'no_label' when quality = 0 then 'low' else 'ok' end as reason from ({LABELLED})) group by rollup (source, reason) having source is not null or reason is null")
def op_g10_skips(spark, sf_dir):
    reason = F.when(F.col("quality").isNull(), "no_label").when(F.col("quality") == 0, "low").otherwise("ok")
    return _labelled(spark, sf_dir).withColumn("reason", reason).rollup("source", "reason").agg(F.count("*").alias("n"))


@query(f"""select user_id, count(*) as n_events, count(*) filter (event_type = 'error') as n_errors, {SUM.format('value')} as total, count(*) filter (event_type = 'purchase' and seen) as recoveries from (
select *, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), 0) = 1 as seen from events) group by user_id""")
def op_g12_fold(spark, sf_dir):
    e = F.col("event_type")
    rows = W.recovery_flags(table(spark, sf_dir, "events"), "user_id", "ts", e == "error", e == "click", e == "purchase")
    return rows.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(e == "error").alias("n_errors"), G.exact_sum("value").alias("total"), F.count_if("passed_after").alias("recoveries"))


@query("""select distinct bucket, user_id from (
select user_id, unnest(list_filter([case when event_type = 'error' then 'error' end, case when value > 200 then 'slow' end, case when event_type = 'error' and value > 100 then 'slow_error' end], lambda x: x is not null)) as bucket from events)""")
def op_g14_buckets(spark, sf_dir):
    e, v = F.col("event_type"), F.col("value")
    return G.failure_buckets(table(spark, sf_dir, "events"), "user_id", {"error": e == "error", "slow": v > 200, "slow_error": (e == "error") & (v > 100)})


@query("select coalesce(count(*) filter (quality = 1) * 1.0 / nullif(count(*), 0), 0.0) as pass_rate, count(*) as n from labels")
def op_g15_passrate(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.coalesce(F.try_divide(F.count_if(F.col("quality") == 1), F.count("*")), F.lit(0.0)).alias("pass_rate"), F.count("*").alias("n"))


@query(f"""select k, round(avg(p), 9) as pass_at_k, count(*) as n_groups from (select source, k, case when n - c < k then 1.0 when c = 0 then 0.0 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k::double / i)) end as p
from (select source, count(*) as n, count(*) filter (quality = 1) as c from ({LABELLED}) where quality is not null group by source), (select unnest([1, 2, 4]) as k)) group by k""")
def op_g17_passk(spark, sf_dir):
    groups = _labelled(spark, sf_dir).where("quality is not null").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("c"))
    every = [groups.select(F.lit(k).alias("k"), G.pass_at_k(groups, "n", "c", k).alias("p")) for k in (1, 2, 4)]
    return every[0].union(every[1]).union(every[2]).groupBy("k").agg(F.round(F.avg("p"), 9).alias("pass_at_k"), F.count("*").alias("n_groups"))


@query("select event_type, round(avg(value), 6) as mean, median(value) as median, max(value) as max, min(value) as min from events group by event_type")
def op_g18_statistics(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    plain = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))
    middle = G.quantiles(events, "value", {"median": 0.5}, "event_type").drop("n")
    return plain.join(middle, "event_type").select("event_type", "mean", "median", "max", "min")


@query("select value, count(*) as n_groups from (select user_id, min(event_type) as value, max(event_type) as hi from (select *, row_number() over (partition by user_id order by ts) as rn from events) where rn <= 2 group by user_id) where value = hi group by value")
def op_g19_zerostd(spark, sf_dir):
    first = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))).where("rn <= 2")
    return G.constant_groups(first, "user_id", "event_type")


@query("select event_type, count(*) as n, count(*) * 1.0 / (select count(*) from events) as share from events group by event_type")
def op_g20_share(spark, sf_dir):
    return G.shares(table(spark, sf_dir, "events"), "event_type")


@query(f"select d.lang, longest, {SUM.format('d.doc_id')} / count(*) as mean, count(*) as ties from documents d join (select lang, max(n_chars) as longest from documents group by lang) m on d.lang = m.lang and d.n_chars = longest group by d.lang, longest")
def op_g22_longest(spark, sf_dir):
    return G.mean_of_longest(table(spark, sf_dir, "documents").select("lang", "n_chars", "doc_id"), "n_chars", "doc_id", "lang")


@query("select round(avg(l_discount / l_quantity), 9) as mean_of_ratios, round(cast(sum(cast(l_discount as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double), 9) as ratio_of_sums from lineitem")
def op_g23_ratios(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg(F.col("l_discount") / F.col("l_quantity")), 9).alias("mean_of_ratios"), F.round(G.exact_sum("l_discount") / G.exact_sum("l_quantity"), 9).alias("ratio_of_sums"))


@query(f"select lang, round(avg(quality), 9) as mean_reward, round(avg(case when n_chars >= 4000 then 1 else 0 end), 9) as truncated, count(*) as n from ({LABELLED}) where quality is not null group by lang")
def op_g24_evalset(spark, sf_dir):
    return _labelled(spark, sf_dir).where("quality is not null").groupBy("lang").agg(F.round(F.avg("quality"), 9).alias("mean_reward"), F.round(F.avg((F.col("n_chars") >= 4000).cast("int")), 9).alias("truncated"), F.count("*").alias("n"))


@query("select count(*) as n_groups, cast(sum(n) as bigint) as n_rows, round(sum(n) / count(*), 9) as mean_size from (select conv_id, count(*) as n from conversations group by conv_id)")
def op_g25_buffer(spark, sf_dir):
    groups = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return groups.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.round(F.sum("n") / F.count("*"), 9).alias("mean_size"))


@query("select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def op_g26_latency(spark, sf_dir):
    q = G.quantiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_type")
    return q.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query(f"""select category, count(*) as n, {SUM.format('l_extendedprice')} as total from (select l_extendedprice, case when l_discount = 0 then 'full' when l_tax = 0 then 'untaxed' when l_quantity > 40 then 'bulk' else 'other' end as category from lineitem) group by category""")
def op_g27_categories(spark, sf_dir):
    kind = F.when(F.col("l_discount") == 0, "full").when(F.col("l_tax") == 0, "untaxed").when(F.col("l_quantity") > 40, "bulk").otherwise("other")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("category")).agg(F.count("*").alias("n"), G.exact_sum("l_extendedprice").alias("total"))


@query("select class, lang, count(*) as n, cast(sum(strlen(text)) as bigint) as bytes from (select *, case when n_chars < 200 then 'short' when n_chars < 5000 then 'medium' else 'long' end as class from documents) group by class, lang")
def op_g28_inventory(spark, sf_dir):
    kind = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("class"), "lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("select user_id, arg_min(event_type, ts) as first_type, arg_min(value, ts) filter (value > 50) as first_large, array_to_string(list_sort(list(distinct event_type)), ',') as types from events group by user_id")
def op_g29_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("large", F.when(F.col("value") > 50, F.col("value")))
    return rows.groupBy("user_id").agg(G.first_by("ts", "event_type").alias("first_type"), G.first_by("ts", "large").alias("first_large"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query("select count(distinct (l_returnflag, l_linestatus)) as combos, count(distinct l_suppkey) as suppliers, count(*) as n from lineitem")
def op_g30_coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct(F.struct("l_returnflag", "l_linestatus")).alias("combos"), F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


@query("select l_orderkey, round(cast(sum(case when l_returnflag = 'N' then cast(l_quantity as decimal(18,2)) else 0 end) as double) / greatest(count(*) filter (l_returnflag = 'N'), 1), 6) as masked_mean from lineitem group by l_orderkey")
def op_g32_maskedmean(spark, sf_dir):
    mask = (F.col("l_returnflag") == "N").cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(G.masked_mean(F.col("l_quantity"), mask), 6).alias("masked_mean"))


@query("select round(sum(m), 4) as sum_of_means, cast(sum(s) as double) as token_sum from (select l_orderkey, avg(l_quantity) as m, sum(cast(l_quantity as decimal(18,2))) as s from lineitem group by l_orderkey)")
def op_g33_reducers(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("s"))
    return per.agg(F.round(F.sum("m"), 4).alias("sum_of_means"), F.sum("s").cast("double").alias("token_sum"))


@query("""with m as (select count(*) as n, sum(value) as s, sum(value * value) as q from events where event_type <> 'error')
select event_id, round((value - s / n) / sqrt((q / n - (s / n) * (s / n)) * n / (n - 1) + 0.00000001), 4) as whitened from events, m""")
def op_g34_whiten(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("mask", (F.col("event_type") != "error").cast("int"))
    return G.whiten(rows, "value", "mask").select("event_id", F.round("whitened", 4).alias("whitened"))


@query("select b as bucket, count(n_chars) as n from (select unnest([1, 2, 3, 4]) as b) left join documents on n_chars <= 20000 and greatest(1, ceil(n_chars * 4 / 20000.0)) = b group by b")
def op_g35_histogram(spark, sf_dir):
    return G.cut_point_histogram(table(spark, sf_dir, "documents"), "n_chars", 20_000.0, 4)


@query("select round(avg(turns), 9) as mean_rounds, max(turns) as max_rounds, round(avg(case when chars >= 3000 then 1 else 0 end), 9) as clip_ratio from (select conv_id, count(*) as turns, sum(length(text)) as chars from conversations group by conv_id)")
def op_g36_multiturn(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return per.agg(F.round(F.avg("turns"), 9).alias("mean_rounds"), F.max("turns").alias("max_rounds"), F.round(F.avg((F.col("chars") >= 3000).cast("int")), 9).alias("clip_ratio"))


@query("select lang, cast(sum(2.0 * (2 * (n * (2.0 * 64 * 64 * 2) + n * n * 128.0 + n * (3.0 * 64 * 256)) + n * 64000.0)) as double) as flops from (select lang, n_chars as n from documents) group by lang")
def op_g37_flops(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(G.flops_estimate(F.col("n_chars"), 2, 64, 256, 1000)).alias("flops"))


@query("select arg_max(o_totalprice, o_orderkey) as final_loss, round(avg(o_totalprice), 4) as avg_loss, count(*) as steps from orders")
def op_g39_trainreport(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max_by("o_totalprice", "o_orderkey").alias("final_loss"), F.round(F.avg("o_totalprice"), 4).alias("avg_loss"), F.count("*").alias("steps"))


@query("select round(avg(m), 6) as mean_of_means, count(*) as ranks from (select l_suppkey % 8 as r, avg(l_quantity) as m from lineitem group by l_suppkey % 8)")
def op_g41_crossrank(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("r")).agg(F.avg("l_quantity").alias("m"))
    return per.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count("*").alias("ranks"))


@query(f"select count(*) as total, count(*) filter (quality is not null) as completed, count(*) filter (quality = 1) as passed, coalesce({SUM.format('quality')}, 0.0) as total_reward, cast(coalesce(sum(n_chars), 0) as bigint) as total_chars from ({LABELLED})")
def op_g43_export(spark, sf_dir):
    zero = F.coalesce(G.exact_sum("quality"), F.lit(0.0))
    return _labelled(spark, sf_dir).agg(F.count("*").alias("total"), F.count("quality").alias("completed"), F.count_if(F.col("quality") == 1).alias("passed"), zero.alias("total_reward"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total_chars"))


# ---- ordered computation


@query("""select event_id, event_type = 'click' and seen as revised_after, event_type = 'purchase' and seen as passed_after from (select *, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), 0) = 1 as seen from events)""")
def op_w06_recovery(spark, sf_dir):
    e = F.col("event_type")
    return W.recovery_flags(table(spark, sf_dir, "events"), "user_id", "ts", e == "error", e == "click", e == "purchase").select("event_id", "revised_after", "passed_after")


@query("select event_id from (select *, coalesce(max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts rows between 1 following and unbounded following), 0) as later from events) where event_type = 'error' and later = 0")
def op_w07_unrecovered(spark, sf_dir):
    e = F.col("event_type")
    return W.unrecovered(table(spark, sf_dir, "events"), "user_id", "ts", e == "error", e == "purchase").select("event_id")


@query(f"select doc_id, round((quality - avg(quality) over (partition by source)) / (stddev_samp(quality) over (partition by source) + 0.000001), 6) as reward from ({LABELLED}) where quality is not null")
def op_w09_normalize(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where("quality is not null")
    return rows.select("doc_id", F.round(G.normalized(rows, "source", "quality"), 6).alias("reward"))


@query("""select event_id, round(case when v > 1 then v when lo = 0 and hi = 0 then v when s < 0.00000001 then 0.0 else (v - m) / (s + 0.00000001) end, 6) as normalized from (
select event_id, v, avg(case when v <= 1 then v end) over w as m, stddev_pop(case when v <= 1 then v end) over w as s, min(case when v <= 1 then v end) over w as lo, max(case when v <= 1 then v end) over w as hi from (select *, value / 100 as v from events) window w as (partition by user_id))""")
def op_w10_normpop(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("v", F.col("value") / 100)
    return W.unit_normalized(rows, "user_id", "v").select("event_id", F.round("normalized", 6).alias("normalized"))


@query("select user_id, max(ts) as newest from events group by user_id order by newest desc, user_id limit 10")
def op_w13_newest(spark, sf_dir):
    return W.newest_groups(table(spark, sf_dir, "events"), "user_id", "ts", 10)


BUSY = """select user_id, min(s) as start, max(e) as "end", count(*) as n from (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as island from (
select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from (select user_id, epoch_us(ts) as s, epoch_us(ts) + cast(round(value * 100) as bigint) * 600000 as e from events))) group by user_id, island"""


def _busy(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return W.merged_intervals(rows.withColumn("end", F.col("start") + F.col("c") * 600_000), "user_id", "start", "end")


@query(f"select user_id, start, \"end\", n from ({BUSY})")
def op_w14_busy(spark, sf_dir):
    return _busy(spark, sf_dir)


@query(f"select user_id, \"end\" as gap_start, following as gap_end from (select *, lead(start) over (partition by user_id order by start) as following from ({BUSY})) where following > \"end\"")
def op_w14_gaps(spark, sf_dir):
    return W.gaps(_busy(spark, sf_dir), "user_id")


@query("""select event_id, cast(step as bigint) as step from (select event_id, user_id, floor((row_number() over (partition by user_id order by ts) - 1) / 3) as step from events) qualify count(*) over (partition by user_id, step) = 3""")
def op_w15_steps(spark, sf_dir):
    return W.full_steps(table(spark, sf_dir, "events"), "user_id", "ts", 3).select("event_id", "step")


@query(f"select user_id, {SUM.format('value')} as busy, cast(epoch_us(max(ts)) - epoch_us(min(ts)) as bigint) as span_us from events group by user_id")
def op_w16_utilization(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(G.exact_sum("value").alias("busy"), (F.max(us) - F.min(us)).alias("span_us"))


@query("""select first_path, n_chars, n, 'dup-' || lpad(cast(row_number() over (order by first_path) as varchar), 5, '0') as duplicate_id, n_chars * (n - 1) as redundant_bytes from (select n_chars, sha256(text) as h, count(*) as n, min(doc_id) as first_path from documents group by n_chars, sha256(text) having count(*) > 1)""")
def op_w20_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    return W.duplicate_groups(rows, "doc_id", "n_chars", "digest").drop("digest")


SIZED = "(select conv_id, turn, role, cast(ceil(strlen(text) / 4.0) as bigint) as n_tokens from conversations)"


@query(f"""with recursive b as (select *, role in ('system', 'user') as pinned from {SIZED}),
o as (select *, row_number() over (partition by conv_id order by turn desc) as rn from b where not pinned),
w as (select conv_id, cast(0 as bigint) as rn, count(*) filter (pinned) as c, cast(coalesce(sum(n_tokens) filter (pinned), 0) as bigint) as u, false as took from b group by conv_id
union all select conv_id, rn, case when fits then c + 1 else c end, case when fits then u + n_tokens else u end, fits from (select o.conv_id, o.rn, w.c, w.u, o.n_tokens, w.c + 1 <= 4 and w.u + o.n_tokens <= 400 as fits from w join o on o.conv_id = w.conv_id and o.rn = w.rn + 1))
select conv_id, turn, role, n_tokens from b where pinned union all select o.conv_id, turn, role, n_tokens from o join w using (conv_id, rn) where took""")
def op_w18_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n_tokens", F.ceil(F.octet_length("text") / 4).cast("long"))
    return W.tail_window(rows.select("conv_id", "turn", "role", "n_tokens"), "conv_id", "turn", "role", "n_tokens", 4, 400)


@query(f"""with t as (select *, sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as t from {SIZED}),
last as (select conv_id, max(t) as last from t group by conv_id), r as (select conv_id, last, unnest(range(0, cast(last as bigint) + 1)) as r from last),
fit as (select r.conv_id, r.r from r join t on t.conv_id = r.conv_id and (t.t = 0 or t.t > r.r) group by r.conv_id, r.r having count(*) + case when r.r > 0 then 1 else 0 end <= 4 and sum(n_tokens) + case when r.r > 0 then 20 else 0 end <= 400),
cut as (select conv_id, least(coalesce((select min(r) from fit where fit.conv_id = last.conv_id), greatest(last - 1, 0)), greatest(last - 1, 0)) as r from last)
select conv_id, turn, role, n_tokens, false as is_summary from t join cut using (conv_id) where t.t = 0 or t.t > cut.r
union all select conv_id, min(turn), 'user', cast(20 as bigint), true from t join cut using (conv_id) where t.t > 0 and t.t <= cut.r group by conv_id""")
def op_w19_compaction(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n_tokens", F.ceil(F.octet_length("text") / 4).cast("long"))
    return W.compacted_turns(rows.select("conv_id", "turn", "role", "n_tokens"), "conv_id", "turn", "role", "n_tokens", 4, 400, 20)


@query("""select l_partkey, l_extendedprice from (select l_partkey, max(l_extendedprice) as l_extendedprice from lineitem group by l_partkey) order by l_extendedprice desc, l_partkey limit 30""")
def op_o03_top(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("l_extendedprice")).orderBy(F.desc("l_extendedprice"), "l_partkey").limit(30)


@query("select user_id, event_type, count(*) as n from events group by user_id, event_type having count(*) > 1")
def op_o09_dupkeys(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 1")


@query("""select n_nationkey, side from (select n_nationkey, 'removed' as side from nation where n_nationkey not in (select s_nationkey + s_suppkey % 2 * 20 from supplier) union all select s, 'added' from (select distinct s_nationkey + s_suppkey % 2 * 20 as s from supplier) where s not in (select n_nationkey from nation))""")
def op_o11_drift(spark, sf_dir):
    before = table(spark, sf_dir, "nation").select("n_nationkey")
    after = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + F.col("s_suppkey") % 2 * 20).alias("n_nationkey")).distinct()
    return G.drift(before, after)


@query("select ts_day, count(*) as n from (select strftime(ts, '%Y-%m-%dT%H:00:00Z') as ts_day from events) group by ts_day")
def op_x33_iso(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'").alias("ts_day")).agg(F.count("*").alias("n"))


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by k")
def op_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
