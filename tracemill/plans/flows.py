"""Flows of several operators: training rows, prepared bundles, post-run audits and rollout batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import messages as M
from ..operators import metrics as G
from ..operators import rules as V
from ..operators import tokens as T
from .registry import query, table
from .training import SPANS


def training_rows(conversations: DataFrame, max_length: int = 2048, shard_width: int = 1_000) -> DataFrame:
    """One row a conversation: characters, trainable characters, tokens, trained tokens, and its place in a pack.

    Shards are ranges of shard_width keys, so their number follows the table and each is bounded; each packs in the order of keys.
    """
    spans = M.char_spans(M.segments(conversations), "conv_id", "turn")
    chars = M.mask_counts(spans, "conv_id")
    whole = M.char_mask(spans, "conv_id", "turn").select("conv_id", "text")
    tokens = T.token_mask(T.chunk_tokens(whole), spans.select("conv_id", "trainable", "start", "end"), "conv_id")
    counts = tokens.groupBy("conv_id").agg(F.count("*").alias("n_tokens"), F.sum("trained").alias("n_trained"))
    dealt = counts.withColumn("shard", F.floor(F.col("conv_id") / shard_width))
    packs = T.next_fit(dealt.select("shard", "conv_id", "n_tokens"), "shard", "conv_id", "n_tokens", max_length).drop("n_tokens", "emitted")
    return chars.join(counts, "conv_id").join(packs, "conv_id")


@query(f"""with recursive spans as ({SPANS}), whole as (select conv_id, string_agg(segment, '' order by turn) as text, sum(length(segment)) as total_chars, sum(case when trainable then length(segment) else 0 end) as trainable_chars from spans group by conv_id),
chunks as (select conv_id, text, unnest(range(0, length(text), 4)) as start from whole),
hit as (select c.conv_id, start, max(case when s.trainable and s.e - length(s.segment) < least(start + 4, length(text)) and s.e > start then 1 else 0 end) as t from chunks c join spans s on s.conv_id = c.conv_id group by c.conv_id, start),
counts as (select conv_id, count(*) as n, sum(t) as trained, conv_id // 1000 as shard from hit group by conv_id),
rows as (select *, row_number() over (partition by shard order by conv_id) as rn from counts),
walk as (select shard, conv_id, n, rn, n > 2048 as oversized, cast(0 as bigint) as pack, case when n > 2048 then cast(0 as bigint) else n end as used, n <= 2048 as held from rows where rn = 1
union all select r.shard, r.conv_id, r.n, r.rn, r.n > 2048, case when r.n <= 2048 and w.held and w.used + r.n > 2048 then w.pack + 1 else w.pack end,
 case when r.n > 2048 then w.used when w.held and w.used + r.n > 2048 then r.n else w.used + r.n end, w.held or r.n <= 2048 from walk w join rows r on r.shard = w.shard and r.rn = w.rn + 1)
select conv_id, cast(total_chars as bigint) as total_chars, cast(trainable_chars as bigint) as trainable_chars, c.n as n_tokens, cast(trained as bigint) as n_trained, cast(c.shard as bigint) as shard, oversized, case when oversized then null else pack end as pack, case when oversized then 0 else used - w.n end as start
from whole join counts c using (conv_id) join walk w using (conv_id)""")
def flow_training_rows(spark, sf_dir):
    return training_rows(table(spark, sf_dir, "conversations"))


@query(f"""with spans as ({SPANS}), per as (select conv_id, cast(sum(length(segment)) as bigint) as chars, cast(sum(case when trainable then length(segment) else 0 end) as bigint) as trainable from spans group by conv_id)
select count(*) as n_samples, cast(coalesce(sum(chars), 0) as bigint) as total_chars, cast(coalesce(sum(trainable), 0) as bigint) as trainable_chars, count(*) filter (trainable = 0) as n_issues, count(*) filter (trainable = 0) = 0 as ok from per""")
def flow_prep_manifest(spark, sf_dir):
    """Samples with nothing to train on are issues of the bundle's contract."""
    per = M.mask_counts(M.segments(table(spark, sf_dir, "conversations")), "conv_id")
    manifest = per.agg(F.count("*").alias("n_samples"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("total_chars"), F.coalesce(F.sum("trainable_chars"), F.lit(0)).alias("trainable_chars"))
    return manifest.crossJoin(V.report(V.violations(per, ["conv_id"], [("nothing_trainable", F.col("trainable_chars") == 0)]), per).drop("n_rows"))


@query("""with f as (select *, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding), 0) = 1 as seen, coalesce(max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts rows between 1 following and unbounded following), 0) as later from events),
r as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase' and seen) as recovered, count(*) filter (event_type = 'error' and later = 0) as lost from f group by user_id)
select count(*) as n_runs, cast(sum(errors) as bigint) as errors, cast(sum(recovered) as bigint) as recovered, cast(sum(lost) as bigint) as lost, count(*) filter (lost > 0) as runs_lost, cast(sum(recovered) as double) / greatest(sum(errors), 1) as rate from r""")
def flow_behavior_audit(spark, sf_dir):
    from ..operators import ordered as W

    e = F.col("event_type")
    rows = W.recovery_flags(table(spark, sf_dir, "events"), "user_id", "ts", e == "error", e == "click", e == "purchase")
    after = Window.partitionBy("user_id").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("later", F.coalesce(F.max((e == "purchase").cast("int")).over(after), F.lit(0)))
    runs = rows.groupBy("user_id").agg(F.count_if(e == "error").alias("errors"), F.count_if("passed_after").alias("recovered"), F.count_if((e == "error") & (F.col("later") == 0)).alias("lost"))
    return runs.agg(F.count("*").alias("n_runs"), F.sum("errors").alias("errors"), F.sum("recovered").alias("recovered"), F.sum("lost").alias("lost"), F.count_if(F.col("lost") > 0).alias("runs_lost"), (F.sum("recovered") / F.greatest(F.sum("errors"), F.lit(1))).cast("double").alias("rate"))


@query("""with g as (select user_id, count(*) as n, stddev_samp(value) as s from events group by user_id), k as (select user_id from g where s > 0.000001),
r as (select event_id, user_id, round((value - avg(value) over w) / (stddev_samp(value) over w + 0.000001), 6) as reward from events semi join k using (user_id) window w as (partition by user_id))
select event_id, reward, cast(user_id % 8 as int) as rank from r""")
def flow_rollout_batch(spark, sf_dir):
    """Groups whose rewards vary, normalised within the group and dealt to 8 ranks by group."""
    events = table(spark, sf_dir, "events")
    kept = L.varied_groups(events, "user_id", "value").where("kept").select("user_id")
    rows = events.join(kept, "user_id", "left_semi")
    return rows.select("event_id", F.round(G.normalized(rows, "user_id", "value"), 6).alias("reward"), (F.col("user_id") % 8).cast("int").alias("rank"))
