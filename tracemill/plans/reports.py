"""Roll-ups of campaigns, studies, evaluations, rollouts, trainings and dataset builds over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import samples as S
from ..operators import toolcalls as T
from .registry import query, table
from .samples import _RUNS, _runs
from .toolcalls import _FORMS, _samples


@query("""with r as (select o_orderkey, case when o_orderkey % 9 = 0 then 'executor_error' else 'trajectory_recorded' end as outcome, case when o_orderkey % 9 = 0 then null when o_orderstatus = 'F' then 'completed' else 'stopped' end as status, case when o_orderkey % 4 = 0 then 'kind_' || o_orderkey % 3 end as kind from orders where o_orderkey % 7 <> 0)
select 'runs' as part, unnest(['planned', 'terminal', 'pending', 'executor_errors', 'failed_trajectories', 'contract_ok']) as name, unnest([(select count(*) from orders), (select count(*) from r), (select count(*) from orders) - (select count(*) from r), (select count(*) from r where outcome = 'executor_error'), (select count(*) from r where status <> 'completed'), 0]) as n
union all select 'outcome', outcome, count(*) from r group by outcome union all select 'trajectory_status', status, count(*) from r where status is not null group by status
union all select 'failure_kind', coalesce(kind, 'unknown'), count(*) from r where outcome = 'executor_error' or status <> 'completed' group by coalesce(kind, 'unknown')""")
def op_g16_report(spark, sf_dir):
    """Orders as a campaign's plan, most of them with a record: outcomes, statuses, kinds of failure and whether the contract holds."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    broke = key % 9 == 0
    status = F.when(~broke, F.when(F.col("o_orderstatus") == "F", "completed").otherwise("stopped"))
    records = o.where(key % 7 != 0).select("o_orderkey", F.when(broke, "executor_error").otherwise("trajectory_recorded").alias("outcome"), status.alias("trajectory_status"), F.when(key % 4 == 0, F.format_string("kind_%d", key % 3)).alias("failure_kind"))
    return R.campaign_report(o.select("o_orderkey"), records, "o_orderkey")


@query("""with c as (select o_custkey, count(*) as samples, count(*) filter (o_orderstatus = 'P') as faults, cast(sum(o_orderkey % 5) as bigint) as rollouts from orders group by o_custkey)
select cast(sum(samples) as bigint) as samples, cast(sum(rollouts) as bigint) as rollouts, count(*) as n_children, count(*) filter (faults > 0) as n_failed, min(o_custkey) filter (faults > 0) as first_failed, case when count(*) filter (faults > 0) > 0 then 'study_child_verification_failed' end as issue from c""")
def op_v08_study(spark, sf_dir):
    """Customers as the verified experiments of a study; one with a pending order failed."""
    children = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("samples"), F.sum(F.col("o_orderkey") % 5).alias("rollouts"), (F.count_if(F.col("o_orderstatus") == "P") == 0).alias("ok"))
    return R.study_report(children, ["samples", "rollouts"])


@query(f"""with {_FORMS}, j as (select role, form not between 1 and 6 as parse_ok, form not between 1 and 7 and form not in (13, 15) as name_ok, not (form between 1 and 6 or form in (9, 11, 12, 13, 15, 16, 17) or (form = 8 and conv_id % 4 > 0)) as args_ok from scored)
select role, count(*) as sample_count, count(*) filter (parse_ok) / count(*) as parse_rate, count(*) filter (name_ok) / count(*) as tool_name_accuracy, count(*) filter (args_ok) / count(*) as argument_exact_match_rate from j group by role""")
def op_g07_names(spark, sf_dir):
    """How often predicted calls can be read, name the tool and give its arguments, by role."""
    scored = T.completion_rewards(_samples(spark, sf_dir).withColumn("tool_specs", F.lit("[]")).withColumn("expected_arguments", F.col("given")))
    return R.tool_name_metrics(scored.withColumn("parse_ok", F.col("reward") > 0), "role")


@query("""with t as (select o_orderpriority as dataset, o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as c, count(*) filter (o_orderkey % 5 = 0) as cut from orders group by 1, 2),
p as (select *, case when n - c < 1 then 1.0 when c = 0 then 0.0 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - 1::double / i)) end as p1, case when n - c < 2 then 1.0 when c = 0 then 0.0 else 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - 2::double / i)) end as p2 from t)
select dataset, cast(sum(n) as bigint) as n, round(sum(c) / sum(n), 9) as mean_reward, round(sum(cut) / sum(n), 9) as truncated_ratio, round(avg(p1), 9) as pass_1, round(avg(p2), 9) as pass_2 from p group by dataset""")
def op_g24_evaluation(spark, sf_dir):
    """Orders as tries of their customers at five datasets: mean reward, cut ones, and pass at one and two."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), "o_custkey", (F.col("o_orderstatus") == "F").cast("double").alias("reward"), (F.col("o_orderkey") % 5 == 0).alias("cut"))
    found = R.evaluation_metrics(o, "dataset", "o_custkey", "reward", "cut", (1, 2))
    return found.select("dataset", "n", *(F.round(c, 9).alias(c) for c in ("mean_reward", "truncated_ratio", "pass_1", "pass_2")))


@query("""with t as (select conv_id % 5 as part, conv_id, count(*) as raw, count(*) filter (role = 'assistant') as trained, count(*) filter (role = 'user') as rounds from conversations group by conv_id)
select part, avg(raw) as raw_mean, max(raw)::double as raw_max, min(raw)::double as raw_min, avg(trained) as trained_mean, max(trained)::double as trained_max, min(trained)::double as trained_min, avg(rounds) as rounds_mean, max(rounds)::double as rounds_max, min(rounds)::double as rounds_min, avg(case when raw >= 6 then 1 else 0 end) as clip_ratio from t group by part""")
def op_g36_masked(spark, sf_dir):
    """Conversations as masks of one place a message: lengths with and without what is masked, and rounds."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", (F.col("role") == "assistant").cast("int").alias("on")))), lambda x: x["on"]).alias("mask"), F.count_if(F.col("role") == "user").alias("rounds"))
    return R.multi_turn_metrics(rows.withColumn("part", F.col("conv_id") % 5), "mask", "rounds", 6, "part")


@query("""select user_id, count(*) as num_steps, arg_max(value, event_id) as final_loss, round(avg(value), 9) as average_loss, cast(sum(event_id % 8) as bigint) as examples_seen, max(event_id * 2 + 1) - min(event_id * 2) as duration_seconds from events group by user_id""")
def op_g39_training(spark, sf_dir):
    """Each user's events as the steps of a training."""
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("event_id") % 8).alias("examples"), (F.col("event_id") * 2).alias("started"), (F.col("event_id") * 2 + 1).alias("ended"))
    return R.training_report(steps, "user_id").withColumn("average_loss", F.round("average_loss", 9))


@query("""with e as (select event_type, case when event_id % 3 > 0 then 'm' || event_id % 3 end as model, case when event_type = 'error' then 'no_catalog' when value < 5 then 'no_tools' end as skip from events)
select 'model' as part, model as name, count(*) as n from e where model is not null group by model union all select 'stop_reason', event_type, count(*) from e group by event_type union all select 'skip', skip, count(*) from e where skip is not null group by skip""")
def op_g38_counters(spark, sf_dir):
    """Requests of a dataset build by model, stop reason and reason to skip, in one pass."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    return R.counters(e, {"model": F.when(F.col("event_id") % 3 > 0, F.format_string("m%d", F.col("event_id") % 3)), "stop_reason": F.col("event_type"), "skip": F.when(F.col("event_type") == "error", "no_catalog").when(v < 5, "no_tools")})


@query(f"""with {_RUNS}, s as (select status, count(*) as n from r group by status), a as (select count(*) as runs, count(*) filter (passed) as passed, count(*) filter (saw_parse_error) as parse_errors, cast(sum(validation_issue_count) as bigint) as issues from r)
select runs, issues, round(passed / runs, 9) as pass_rate, (select string_agg(status || '=' || n, ',' order by status) from s) as statuses, passed / runs >= 0.5 as enough_pass, parse_errors = 0 as no_parse_error, passed / runs >= 0.5 and parse_errors = 0 as credible from a""")
def op_g42_bundle(spark, sf_dir):
    """The behaviour audit, the runs' statuses and the gates on them in one record."""
    runs = _runs(spark, sf_dir)
    gates = {"enough_pass": F.col("pass_rate") >= 0.5, "no_parse_error": F.col("runs_with_parse_error") == 0}
    found = R.credibility_bundle(S.behavior_audit(runs), runs.groupBy("status").agg(F.count("*").alias("n")), gates)
    statuses = F.array_join(F.transform(F.map_entries("statuses"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return found.select(F.col("run_count").alias("runs"), F.col("validation_issue_count").alias("issues"), F.round("pass_rate", 9).alias("pass_rate"), statuses.alias("statuses"), *gates, "credible")


@query()
def op_g21_samples(spark, sf_dir):
    """Lengths, repetition and cut texts of documents by language; what repeats is told by compression, so there is no SQL."""
    docs = table(spark, sf_dir, "documents").select("lang", "text", F.length(F.coalesce("text", F.lit(""))).alias("length"))
    return R.rollout_metrics(docs, "length", "text", F.col("length") >= 8000, "lang")
