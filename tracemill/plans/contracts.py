"""Queries on samples as they are built and on the contracts that they are held to, with faults planted over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.storage import fresh_path
from ..operators import contracts as C
from ..operators import messages as M
from ..operators import ordered as W
from ..sources import records as S
from .registry import query, table

TAGGED = "'<' || role || '>' || chr(10) || coalesce(text, '') || chr(10) || '</' || role || '>' || chr(10)"
CALL = """'<|tool|>' || chr(10) || '{"arguments": {"n": ' || n || '}, "id": "t' || conv_id || '", "name": "act"}' || chr(10) || '<|end|>' || chr(10)"""
COUNTED = "(select conv_id, count(*) as n from conversations group by conv_id)"
#: Segments of the samples below: messages, tool specs of even conversations, a text, the call.
PARTS = f"""select conv_id, 0 as part, turn as place, role as kind, {TAGGED} as segment, false as trainable from conversations
union all select conv_id, 1, 0, 'user', '<user>' || chr(10) || '[{{"name": "act"}}]' || chr(10) || '</user>' || chr(10), false from {COUNTED} where conv_id % 2 = 0
union all select conv_id, 2, 0, 'assistant', '<assistant>' || chr(10) || 'I will act.' || chr(10) || '</assistant>' || chr(10), false from {COUNTED}
union all select conv_id, 2, 1, 'assistant_tool_call', {CALL}, true from {COUNTED}"""


def _segments(spark, sf_dir, api: bool):
    said = table(spark, sf_dir, "conversations")
    per = said.groupBy("conv_id").agg(F.count("*").alias("n"))
    call = M.call_text(F.concat(F.lit("t"), "conv_id"), F.lit("act"), F.create_map(F.lit("n"), F.col("n").cast("string")))
    targets = per.select("conv_id", F.lit(1).alias("place"), F.lit("assistant_tool_call").alias("kind"), call.alias("text"))
    if not api:
        return M.sample_segments(said, "conv_id", "turn", targets)
    targets = targets.union(per.select("conv_id", F.lit(0), F.lit("assistant"), F.lit("I will act.")))
    specs = per.where("conv_id % 2 = 0").select("conv_id", F.lit('[{"name": "act"}]').alias("text"))
    return M.sample_segments(said, "conv_id", "turn", targets, specs)


@query("""select event_id, '<|tool|>' || chr(10) || '{' || case when event_id % 3 = 0 then '"id": "c' || event_id || '", "input_text": "say \\"' || event_type || '\\"", "name": "' || event_type || '", "payload_kind": "input_text"'
 else '"arguments": {"k": ' || json_extract_string(props, '$.k') || ', "u": ' || user_id || '}, "id": "c' || event_id || '", "name": "' || event_type || '"' end || '}' || chr(10) || '<|end|>' || chr(10) as call from events""")
def op_p04_calltext(spark, sf_dir):
    arguments = F.create_map(F.lit("u"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('say "'), "event_type", F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", M.call_text(F.concat(F.lit("c"), "event_id"), F.col("event_type"), arguments, given).alias("call"))


@query(f"""select c.conv_id, said || {CALL.replace('conv_id', 'c.conv_id')} as text, cast(n + 1 as bigint) as n_segments, cast(length({CALL.replace('conv_id', 'c.conv_id')}) as bigint) as trainable
from {COUNTED} c join (select conv_id, string_agg({TAGGED}, '' order by turn) as said from conversations group by conv_id) s on s.conv_id = c.conv_id""")
def op_p02_schemasample(spark, sf_dir):
    return M.prepared_samples(_segments(spark, sf_dir, False), "conv_id").select("conv_id", "text", F.size("segments").cast("long").alias("n_segments"), F.col("trainable_char_count").alias("trainable"))


@query(f"""select conv_id, string_agg(segment, '' order by part, place) as text, count(*) as n_segments, cast(sum(case when trainable then length(segment) else 0 end) as bigint) as trainable from ({PARTS}) group by conv_id""")
def op_p03_apisample(spark, sf_dir):
    return M.prepared_samples(_segments(spark, sf_dir, True), "conv_id").select("conv_id", "text", F.size("segments").cast("long").alias("n_segments"), F.col("trainable_char_count").alias("trainable"))


@query(f"""select conv_id, cast(sum(length(segment)) as bigint) as total_char_count, cast(sum(case when trainable then length(segment) else 0 end) as bigint) as mask_sum from ({PARTS}) group by conv_id""")
def op_p05_rollout(spark, sf_dir):
    rows = M.prepared_samples(_segments(spark, sf_dir, True), "conv_id")
    return rows.select("conv_id", "total_char_count", F.aggregate("character_mask", F.lit(0).cast("long"), lambda acc, m: acc + m).alias("mask_sum"))


@query(f"""select conv_id, cast(row_number() over w - 1 as bigint) as place, kind, cast(sum(length(segment)) over w - length(segment) as bigint) as start, cast(sum(length(segment)) over w as bigint) as "end", trainable
from ({PARTS}) window w as (partition by conv_id order by part, place rows unbounded preceding)""")
def op_p18_builders(spark, sf_dir):
    rows = M.prepared_samples(_segments(spark, sf_dir, True), "conv_id").select("conv_id", F.posexplode(F.arrays_zip("segments", "spans")).alias("place", "x"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), "x.segments.kind", "x.spans.start", "x.spans.end", "x.spans.trainable")


SAMPLE_FAULTS = ["blank_task_id", "mask_length", "mask_values", "trainable_count", "span_count", "segment_kind", "trainable_kind", "span_bounds", "text_segments", "outcome"]


@query("select conv_id, case conv_id % 12 " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(SAMPLE_FAULTS)) + " end as fault from conversations group by conv_id")
def op_v09_prepared(spark, sf_dir):
    """The first broken invariant of each sample; ten kinds of fault are planted, one in each sample but every sixth."""
    k = F.col("conv_id") % 12
    first = lambda kind, flag: F.concat(F.array(F.struct(kind.alias("kind"), F.col("segments")[0]["text"].alias("text"), flag.alias("trainable"))), F.slice("segments", F.lit(2), F.size("segments")))
    last = F.element_at("spans", -1)
    rows = M.prepared_samples(_segments(spark, sf_dir, True), "conv_id")
    rows = rows.select(
        "conv_id", F.concat(F.lit("s"), "conv_id").alias("sample_id"), *(F.lit("x").alias(c) for c in ("sample_type", "source_type", "split", "tool_profile_id")), F.when(k == 0, " ").otherwise("t").alias("task_id"),
        F.when(k == 8, F.concat(F.expr("left(text, length(text) - 1)"), F.lit("?"))).otherwise(F.col("text")).alias("text"),
        F.when(k == 5, first(F.lit(""), F.lit(False))).when(k == 6, first(F.lit("user"), F.lit(True))).otherwise(F.col("segments")).alias("segments"),
        F.when(k == 4, F.slice("spans", F.lit(1), F.size("spans") - 1)).when(k == 7, F.concat(F.slice("spans", F.lit(1), F.size("spans") - 1), F.array(F.struct(last["start"].alias("start"), (last["end"] + 1).alias("end"), last["trainable"].alias("trainable"))))).otherwise(F.col("spans")).alias("spans"),
        F.when(k == 1, F.slice("character_mask", F.lit(1), F.size("character_mask") - 1)).when(k == 2, F.concat(F.array(F.lit(2)), F.slice("character_mask", F.lit(2), F.size("character_mask")))).otherwise(F.col("character_mask")).alias("character_mask"),
        (F.col("trainable_char_count") + F.when(k == 3, 1).otherwise(0)).alias("trainable_char_count"),
        F.lit(1.0).alias("reward"), F.when(k != 9, "completed").alias("status"), F.lit(True).alias("verifier_passed"), F.lit(1.0).alias("verifier_score"),
    )
    return rows.select("conv_id", F.get(C.sample_faults(), F.lit(0)).alias("fault"))


@query("""with s as (select doc_id as index, case when doc_id % 97 = 0 then 'doc-0' else 'doc-' || doc_id end as sample_id, source as task_id, lang as tool_profile_id, 'documents' as source_type from documents),
t as (select index, sample_id, case when index % 50 = 1 then 'x' else task_id end as task_id, tool_profile_id, case when index % 64 <> 3 then source_type end as source_type from s where index % 101 <> 5),
p as (select index // 40 as sequence, count(*) as spans, count(*) - case when (index // 40) % 7 = 2 then 1 else 0 end as unpacked from s group by index // 40),
n as (select (select count(*) from s) as ns, (select count(*) from t) as nt, (select sum(spans) from p) as np, (select sum(unpacked) from p) as nu),
lost as (select t.index, case when s.task_id is distinct from t.task_id then 'prepared_task_id_not_preserved' end as a, case when s.source_type is distinct from t.source_type then 'prepared_source_type_not_preserved' end as b from s join t using (index))
select code, cast(n as bigint) as n, first from (
select 'prepared_duplicate_sample_id' as code, count(*) as n, min(sample_id) as first from (select sample_id from s group by sample_id having count(*) > 1)
union all select 'prepared_tokenized_count_mismatch', 1, ns || ' / ' || nt from n where ns <> nt
union all select a, count(*), lpad(cast(min(index) as varchar), 12, '0') from lost where a is not null group by a
union all select b, count(*), lpad(cast(min(index) as varchar), 12, '0') from lost where b is not null group by b
union all select 'prepared_packed_example_count_mismatch', 1, nt || ' / ' || cast(np as bigint) from n where nt <> np
union all select 'prepared_packed_source_count_mismatch', count(*), lpad(cast(min(sequence) as varchar), 12, '0') from p where unpacked <> spans
union all select 'prepared_unpack_count_mismatch', 1, nt || ' / ' || cast(nu as bigint) from n where nt <> nu) where n > 0""")
def op_v01_bundle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = docs.select(F.col("doc_id").alias("index"), F.concat(F.lit("doc-"), F.when(F.col("doc_id") % 97 == 0, 0).otherwise(F.col("doc_id"))).alias("sample_id"), F.col("source").alias("task_id"), F.col("lang").alias("tool_profile_id"), F.lit("documents").alias("source_type"))
    tokenized = samples.where("index % 101 <> 5").withColumns({"task_id": F.when(F.col("index") % 50 == 1, "x").otherwise(F.col("task_id")), "source_type": F.when(F.col("index") % 64 != 3, F.col("source_type"))})
    packed = samples.groupBy(F.floor(F.col("index") / 40).alias("sequence")).agg(F.collect_list(F.struct("index")).alias("source_spans")).withColumn("unpacked", F.size("source_spans") - F.when(F.col("sequence") % 7 == 2, 1).otherwise(0))
    return C.bundle_issues(samples, tokenized, packed).where("n > 0")


@query("""with a as (select event_id, event_type, user_id from events), b as (select * from a where event_id % 1000 <> 7)
select 'roundtrip_count_mismatch' as code, cast(1 as bigint) as n, (select count(*) from a) || ' / ' || (select count(*) from b) as first
union all select 'roundtrip_content_mismatch', count(*), lpad(cast(min(event_id) as varchar), 12, '0') from b where event_id % 500 = 3""")
def op_v02_roundtrip(spark, sf_dir):
    """Records written as JSON lines and read again; some are lost and some changed on purpose on the way."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    path = fresh_path(spark, "v02") + ".jsonl"
    S.append_records(rows.where("event_id % 1000 <> 7").withColumn("user_id", F.col("user_id") + F.when(F.col("event_id") % 500 == 3, 1).otherwise(0)), path)
    return C.roundtrip_issues(rows, S.read_records(spark, path, "event_id long, event_type string, user_id long"), "event_id")


@query("""with n as (select count(*) as s, count(*) filter (doc_id % 10 <> 3) as r from documents)
select 'manifest_sample_count_mismatch' as code, cast(1 as bigint) as n, (s + 1) || ' / ' || s as first from n union all select 'sample_rollout_count_mismatch', cast(1 as bigint), s || ' / ' || r from n where s <> r""")
def op_v03_rolloutsource(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rollouts = docs.where("doc_id % 10 <> 3")
    manifest = docs.agg(F.count_if(F.col("doc_id") % 10 != 3).alias("rollout_count"), (F.count("*") + 1).alias("sample_count"))
    return C.manifest_issues(manifest, docs, rollouts)


@query("""with a as (select lang as split, count(*) as n from documents group by lang)
select 'schema_following_split_count_mismatch' as code, cast(count(*) + 1 as bigint) as n, least(min(split), 'none_at_all') as first from a where split in ('de', 'fr') union all select 'schema_following_loss_mask_policy_mismatch', cast(1 as bigint), 'all'""")
def op_v04_schemasource(spark, sf_dir):
    """Two splits' stated counts are off by one, one split has no samples, and the policy is another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"))
    stated = docs.groupBy("split").agg(F.count("*").alias("n")).select("split", (F.col("n") + F.when(F.col("split").isin("de", "fr"), 1).otherwise(0)).alias("expected"))
    return C.split_issues(stated.union(spark.createDataFrame([("none_at_all", 4)], "split string, expected long")), docs, "all")


CONTEXT_FAULTS = {0: "missing_selected", 1: "missing_omitted", 2: "message_count", 3: "stray_record_id", 4: "summary_kind", 5: "summary_sources", 6: "carried_selected", 7: "no_carried_id", 8: "carried_record"}


@query(f"""select conv_id as run_id, turn as turn_index, case (conv_id + turn) % 11 {' '.join(f"when {i} then '{f}'" for i, f in CONTEXT_FAULTS.items())} else '' end as faults from conversations where role = 'assistant' and turn > 1""")
def op_v11_context(spark, sf_dir):
    """Requests of assistant messages over their conversation's last messages; a fault of nine kinds is planted in most."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    k = (F.col("conv_id") + F.col("turn")) % 11
    own = rows.where("role = 'assistant' and turn > 1").withColumn("k", k)
    name = lambda kind, at: F.concat(F.lit(kind), at.cast("string"))
    active = F.col("k") >= 4
    messages = rows.select(F.col("conv_id").alias("run_id"), name("m", F.col("turn")).alias("entry_id"), F.lit("source_message").alias("source_kind"), F.lit(None).cast("string").alias("record_id"), F.lit(None).cast("array<string>").alias("sources"))
    before = F.array(name("m", F.col("turn") - 2))
    summaries = own.where(active).select(F.col("conv_id"), name("s", F.col("turn")), F.when(F.col("k") == 4, "note").otherwise("replacement_summary"), name("r", F.col("turn")), F.when(F.col("k") == 5, F.array().cast("array<string>")).otherwise(before))
    carried = own.where(active & (F.col("k") != 7)).select(F.col("conv_id"), name("c", F.col("turn")), F.lit("carry_forward_state"), F.when(F.col("k") == 8, "another").otherwise(name("r", F.col("turn"))), F.lit(None).cast("array<string>"))
    retained = messages.union(summaries).union(carried)
    plain = F.array(name("m", F.col("turn") - 1))
    selected = F.when(F.col("k") == 0, F.array(F.lit("m-1"))).when(F.col("k") == 6, F.concat(plain, F.array(name("s", F.col("turn")), name("c", F.col("turn"))))).when(active, F.concat(plain, F.array(name("s", F.col("turn"))))).otherwise(plain)
    entries = own.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("turn_index"), selected.alias("selected"), F.when(F.col("k") == 1, F.array(F.lit("m-2"))).otherwise(before).alias("omitted"), (F.size(selected) + F.when(F.col("k") == 2, 1).otherwise(0)).alias("request_message_count"),
        active.alias("replacement_active"), F.when(active, name("s", F.col("turn"))).alias("summary_id"), F.when(active & (F.col("k") != 7), name("c", F.col("turn"))).alias("carried_id"), F.when(active | (F.col("k") == 3), name("r", F.col("turn"))).alias("record_id"),
    )
    return C.context_faults(entries, retained).select("run_id", "turn_index", F.array_join("faults", ",").alias("faults"))


@query("""with o as (select o_custkey as run_id, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)
select run_id, id as turn_index, lag(id) over w as previous_turn, case when rn = 1 then 'initial_' else '' end || case when id % 6 = 0 then case when rn = 1 then 'compaction_snapshot' else 'replacement_compaction' end else case when rn = 1 then 'snapshot' else 'append_only' end end as kind,
rn = 1 or id % 10 <> 3 as prefix_ok, id % 10 <> 7 as suffix_ok, cast(1 as bigint) as n_appended from o window w as (partition by run_id order by rn)""")
def op_w08_evolution(spark, sf_dir):
    """Customers' orders as snapshots: each holds what the one before selected (its last two, or one after a compaction) and one new order; some prefixes and suffixes are falsified."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("turn_index"), F.lag("o_orderkey").over(w).alias("a"), F.lag("o_orderkey", 2).over(w).alias("b"))
    compacted = lambda c: F.col(c) % 6 == 0
    chosen = lambda now, old: F.when(compacted(now), F.array(F.col(now))).otherwise(F.array_compact(F.array(F.col(old), F.col(now))))
    last = F.when(F.col("a").isNull(), F.array().cast("array<long>")).otherwise(chosen("a", "b"))
    kept = F.when(F.col("turn_index") % 10 == 3, F.transform(last, lambda x: -x)).otherwise(last)
    new = F.when(F.col("turn_index") % 10 == 7, -F.col("turn_index")).otherwise(F.col("turn_index"))
    snapshots = orders.select("run_id", "turn_index", chosen("turn_index", "a").alias("selected"), F.concat(kept, F.array("turn_index")).alias("before"), F.array(new).alias("new_sources"), compacted("turn_index").alias("compacted"))
    return C.history_transitions(snapshots)


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) as n_tokens from documents where ceil(length(text) / 4.0) <= 300")
def op_f02_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n_tokens", F.ceil(F.length("text") / 4).cast("long"))
    return C.within_length(docs, "text", F.col("n_tokens"), 300).select("doc_id", "n_tokens")


@query("""select coalesce(reason, 'sample') as reason, count(*) as n from (select case when event_type = 'error' then 'not_extracted' when user_id % 5 = 0 then 'no_tools' when event_type = 'view' then 'no_tool_use' when value < 10 then 'no_catalog' end as reason from events) group by 1""")
def op_f12_skips(spark, sf_dir):
    e = F.col("event_type")
    reason = C.skip_reason(F.when(e != "error", True), F.when(F.col("user_id") % 5 != 0, F.col("user_id")), e != "view", F.col("value") >= 10)
    return table(spark, sf_dir, "events").groupBy(F.coalesce(reason, F.lit("sample")).alias("reason")).agg(F.count("*").alias("n"))


_TREE = """with recursive e as (select user_id as trace_id, event_id as span_id, event_type, row_number() over (partition by user_id order by event_id) as rn from events),
p as (select e.*, up.span_id as parent, case when e.event_type = 'purchase' then null else 10 * e.rn + case when e.rn % 3 = 0 then 45 else 7 end end as closed, 10 * e.rn as start from e left join e up on up.trace_id = e.trace_id and up.rn = case when e.rn = 6 then 12 else e.rn // 2 end),
s as (select * from p where event_type <> 'error'),
walk as (select trace_id, span_id, parent as at, [span_id] as seen, cast(0 as bigint) as depth, cast(null as bigint) as near, false as ring from s
union all select w.trace_id, w.span_id, u.parent, list_append(w.seen, u.span_id), w.depth + 1, coalesce(w.near, u.closed), list_contains(w.seen, u.span_id) from walk w join s u on u.trace_id = w.trace_id and u.span_id = w.at where not w.ring),
top as (select trace_id, span_id, bool_or(ring) as ring, max(depth) as depth, max_by(near, depth) as near from walk group by trace_id, span_id),
ends as (select trace_id, max(t) as last from (select trace_id, start as t from s union all select trace_id, closed from p where closed is not null) group by trace_id),
nxt as (select a.trace_id, a.span_id, min(b.start) as next from s a left join s b on b.trace_id = a.trace_id and b.parent is not distinct from a.parent and b.start > a.start group by a.trace_id, a.span_id)"""


@query(_TREE + """
select s.trace_id, s.span_id, case when closed is null then 'open' else 'closed' end as kind, cast(start as bigint) as start,
cast(coalesce(closed, least(case when last > start then last end, next, case when near > start then near end), start) as bigint) as "end",
case when closed is null then case when least(case when last > start then last end, next, case when near > start then near end) is null then 'self' when last > start and last <= coalesce(least(next, case when near > start then near end), last) then 'row_end' when next <= coalesce(case when near > start then near end, next) then 'next_sibling_start' else 'ancestor_end' end end as clipped_by,
case when ring then 0 else depth end as depth
from s join top using (trace_id, span_id) join ends using (trace_id) join nxt using (trace_id, span_id)
union all select p.trace_id, p.span_id, 'orphan', null, cast(p.closed as bigint), null, case when t.depth is null or t.ring then 0 else t.depth end from p left join top t on t.trace_id = p.trace_id and t.span_id = p.parent where event_type = 'error' and closed is not null""")
def op_w17_spans(spark, sf_dir):
    """Users' events as nested spans: the parent of the n-th is the half of it; purchases stay open, errors end without a start, and the sixth has the twelfth as its parent, a ring."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), "event_type", rn.alias("rn"))
    up = rows.select("trace_id", F.col("rn").alias("up"), F.col("span_id").alias("parent_span_id"))
    spans = rows.withColumn("up", F.when(F.col("rn") == 6, 12).otherwise(F.floor(F.col("rn") / 2)).cast("int")).join(up, ["trace_id", "up"], "left")
    event = lambda kind, ts: F.struct(F.lit(kind).alias("type"), ts.cast("long").alias("ts"))
    start = F.when(F.col("event_type") != "error", event("span_start", F.col("rn") * 10))
    end = F.when(F.col("event_type") != "purchase", event("span_end", F.col("rn") * 10 + F.when(F.col("rn") % 3 == 0, 45).otherwise(7)))
    events = spans.select("trace_id", "span_id", "parent_span_id", F.explode(F.array_compact(F.array(start, end))).alias("x")).select("trace_id", "span_id", "parent_span_id", "x.type", "x.ts")
    return W.span_tree(events).drop("parent_span_id")
