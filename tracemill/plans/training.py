"""Queries on conversations and documents as training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import global_row_number
from ..operators import chatmask as C
from ..operators import messages as M
from ..operators import tokens as T
from .registry import query, table

SEGMENTS = """select conv_id, turn, role, '<' || role || '>' || chr(10) || coalesce(text, '') || chr(10) || '</' || role || '>' || chr(10) as segment, role = 'assistant' as trainable
from conversations where not (role = 'assistant' and coalesce(text, '') = '')"""
SPANS = f"""select *, sum(length(segment)) over (partition by conv_id order by turn rows unbounded preceding) as e from ({SEGMENTS})"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.segments(table(spark, sf_dir, "conversations"))


@query(f"select conv_id, turn, role, segment, trainable from ({SEGMENTS})")
def op_p01_serialize(spark, sf_dir):
    return _segments(spark, sf_dir).select("conv_id", "turn", "role", "segment", "trainable")


@query(f"select conv_id, turn, cast(e - length(segment) as bigint) as start, cast(e as bigint) as \"end\", trainable from ({SPANS})")
def op_w01_spans(spark, sf_dir):
    return M.char_spans(_segments(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "start", "end", "trainable")


@query(f"select conv_id, cast(sum(length(segment)) as bigint) as total_chars, cast(sum(case when trainable then length(segment) else 0 end) as bigint) as trainable_chars from ({SEGMENTS}) group by conv_id")
def op_a01_maskcount(spark, sf_dir):
    return M.mask_counts(_segments(spark, sf_dir), "conv_id")


@query(f"select conv_id, string_agg(case when not trainable then segment else '' end, '' order by turn) as context, string_agg(case when trainable then segment else '' end, '' order by turn) as target from ({SEGMENTS}) group by conv_id")
def op_p06_split(spark, sf_dir):
    return M.split_context(_segments(spark, sf_dir), "conv_id", "turn").select("conv_id", "context", "target")


@query(f"select conv_id, turn, cast(e - length(segment) as bigint) as start, cast(e as bigint) as \"end\", segment from ({SPANS}) where trainable")
def op_p07_trainable(spark, sf_dir):
    return M.char_spans(_segments(spark, sf_dir), "conv_id", "turn").where("trainable").select("conv_id", "turn", "start", "end", "segment")


@query("""select conv_id, turn, coalesce(list_aggregate(ctx, 'string_agg', chr(10)), '') as context, cast(coalesce(len(ctx), 0) as bigint) as n_context from (
select conv_id, turn, role, list(role || ': ' || text) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as ctx from conversations) where role = 'assistant'""")
def op_w02_context(spark, sf_dir):
    rows = M.context_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.array_join("context", "\n").alias("context"), F.size("context").cast("long").alias("n_context"))


@query("select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) as bigint) as step from conversations where role = 'assistant'")
def op_w03_step(spark, sf_dir):
    return M.step_index(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("step").cast("long").alias("step"))


@query("""select conv_id, cast(turn_no as bigint) as turn_no, count(*) as n_messages, min(turn) as first, max(turn) as last from (
select *, sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as turn_no from conversations) where turn_no > 0 and role in ('assistant', 'user') group by conv_id, turn_no""")
def op_w04_turns(spark, sf_dir):
    return M.turn_ranges(table(spark, sf_dir, "conversations"), "conv_id", "turn", follows=("user",))


@query("select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as predecessor, lead(turn) over (partition by conv_id order by turn) as successor from conversations")
def op_w05_chain(spark, sf_dir):
    return M.chain(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "predecessor", "successor")


@query("select conv_id, cast(sum(greatest(1, cast(ceil(strlen(role || ' ' || coalesce(text, '')) / 4.0) as bigint))) as bigint) as n_tokens from conversations group by conv_id")
def op_x32_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(M.token_estimate(F.col("role"), F.col("text"))).alias("n_tokens"))


CHUNKS = "select conv_id, turn, role, text, unnest(range(0, length(text), 4)) as start from conversations where length(text) > 0"
CHUNK_ID = "cast(cast('0x' || substr(sha256(substr(text, cast(start as bigint) + 1, 4)), 1, 16) as ubigint) % 31996 + 4 as bigint)"


@query(f"select conv_id, turn, cast(start as bigint) as start, {CHUNK_ID} as token_id from ({CHUNKS})")
def op_a05_tokens(spark, sf_dir):
    return T.chunk_tokens(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("start").cast("long").alias("start"), "token_id")


@query(f"""with spans as ({SPANS}), whole as (select conv_id, string_agg(segment, '' order by turn) as text from spans group by conv_id),
chunks as (select conv_id, text, unnest(range(0, length(text), 4)) as start from whole)
select c.conv_id, cast(start as bigint) as start, {CHUNK_ID} as token_id, cast(max(case when s.trainable and s.e - length(s.segment) < least(start + 4, length(text)) and s.e > start then 1 else 0 end) as int) as trained
from chunks c join spans s on s.conv_id = c.conv_id group by c.conv_id, start, text""")
def op_a02_tokenmask(spark, sf_dir):
    spans = M.char_spans(_segments(spark, sf_dir), "conv_id", "turn")
    texts = M.char_mask(_segments(spark, sf_dir), "conv_id", "turn").select("conv_id", "text")
    return T.token_mask(T.chunk_tokens(texts), spans.select("conv_id", "trainable", "start", "end"), "conv_id").select("conv_id", F.col("start").cast("long").alias("start"), "token_id", "trained")


#: Shards of a source: bounded ranges of doc_id, so that no task holds more than _SHARD rows, whatever a source's share of them.
_SHARD = 2_000
SHARD = f"source || ':' || doc_id // {_SHARD}"


def _shards(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("shard", F.concat_ws(":", "source", F.floor(F.col("doc_id") / _SHARD)))


@query(f"""with recursive rows as (select {SHARD} as shard, doc_id, n_chars as n, row_number() over (partition by {SHARD} order by doc_id) as rn from documents),
walk as (
select shard, doc_id, n, rn, n > 8192 as oversized, cast(0 as bigint) as pack, case when n > 8192 then cast(0 as bigint) else n end as used, n <= 8192 as held from rows where rn = 1
union all
select r.shard, r.doc_id, r.n, r.rn, r.n > 8192, case when r.n <= 8192 and w.held and w.used + r.n > 8192 then w.pack + 1 else w.pack end,
 case when r.n > 8192 then w.used when w.held and w.used + r.n > 8192 then r.n else w.used + r.n end, w.held or r.n <= 8192
from walk w join rows r on r.shard = w.shard and r.rn = w.rn + 1)
select shard, doc_id, least(n, 8192) as n_chars, oversized, case when oversized then null else pack end as pack, case when oversized then 0 else used - n end as start from walk""")
def op_a07_pack(spark, sf_dir):
    return T.next_fit(_shards(spark, sf_dir), "shard", "doc_id", "n_chars", 8192).drop("emitted")


@query(f"""with recursive rows as (select {SHARD} as shard, doc_id, n_chars as n, row_number() over (partition by {SHARD} order by doc_id) as rn from documents),
walk as (select shard, doc_id, n, rn, cast(0 as bigint) as chunk, n as used from rows where rn = 1
union all select r.shard, r.doc_id, r.n, r.rn, case when w.used + r.n >= 20000 then w.chunk + 1 else w.chunk end, case when w.used + r.n >= 20000 then r.n else w.used + r.n end from walk w join rows r on r.shard = w.shard and r.rn = w.rn + 1)
select shard, doc_id, n as n_chars, chunk from walk""")
def op_a19_chunks(spark, sf_dir):
    return T.size_chunks(_shards(spark, sf_dir), "shard", "doc_id", "n_chars", 20_000)


@query(f"""with recursive rows as (select {SHARD} as shard, n_chars as n, row_number() over (partition by {SHARD} order by doc_id) as rn from documents),
walk as (select shard, rn, [n] as bins from rows where rn = 1
union all select r.shard, r.rn, case when len([b for b in w.bins if b + r.n <= 16384]) = 0 then list_append(w.bins, r.n)
 else [case when i = list_position([b + r.n <= 16384 for b in w.bins], true) then b + r.n else b end for b, i in w.bins] end from walk w join rows r on r.shard = w.shard and r.rn = w.rn + 1)
select shard, cast(len(bins) as int) as n_bins from walk qualify row_number() over (partition by shard order by rn desc) = 1""")
def op_a10_firstfit(spark, sf_dir):
    lengths = _shards(spark, sf_dir).groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "n_chars"))), lambda x: x["n_chars"]).alias("lengths"))
    return lengths.select("shard", T.first_fit_count(F.col("lengths"), 16_384).alias("n_bins"))


@query(f"""with recursive rows as (select {SHARD} as shard, doc_id, n_chars as n, row_number() over (partition by {SHARD} order by doc_id) - 1 as i from documents),
walk as (select shard, count(*) as left_over, list({{'k': -n, 'h': -n, 'i': i, 'b': [{{'n': -n, 'm': [i]}}, {{'n': 0, 'm': cast([] as bigint[])}}, {{'n': 0, 'm': cast([] as bigint[])}}, {{'n': 0, 'm': cast([] as bigint[])}}]}}) as st from rows group by shard
union all select shard, left_over - 1, list_append(st[3:], {{'k': b[1].n - b[4].n, 'h': b[1].n, 'i': i, 'b': b}}) from (
 select shard, left_over, st, st[1].i as i, list_sort([{{'n': st[1].b[j].n + st[2].b[5 - j].n, 'm': list_concat(st[1].b[j].m, st[2].b[5 - j].m)}} for j in [1, 2, 3, 4]]) as b from (select shard, left_over, list_sort(st) as st from walk where left_over > 1))),
bins as (select shard, unnest(st[1].b).m as m, unnest([0, 1, 2, 3]) as bin from walk where left_over = 1),
placed as (select shard, unnest(m) as i, bin from bins)
select rows.shard, doc_id, n as n_chars, cast(bin as int) as bin from rows join placed using (shard, i)""")
def op_a11_kk(spark, sf_dir):
    return T.differencing(_shards(spark, sf_dir), "shard", "doc_id", "n_chars", 4)


@query("""with recursive rows as (select event_id // 40 as shard, event_id, cast(floor(value * 100) as bigint) as n, row_number() over (partition by event_id // 40 order by event_id) - 1 as i from events),
ranked as (select *, (row_number() over (partition by shard order by n, i) - 1) // 4 as part from rows),
parts as (select shard, part, list_sort(list({'n': -n, 'm': [i]})) as b, arg_min(i, (n, i)) as i from ranked group by shard, part),
walk as (select shard, count(*) as left_over, list({'k': b[1].n - b[4].n, 'h': b[1].n, 'i': i, 'b': b}) as st from parts group by shard
union all select shard, left_over - 1, list_append(st[3:], {'k': b[1].n - b[4].n, 'h': b[1].n, 'i': i, 'b': b}) from (
 select shard, left_over, st, st[1].i as i, list_sort([{'n': st[1].b[j].n + st[2].b[5 - j].n, 'm': list_concat(st[1].b[j].m, st[2].b[5 - j].m)} for j in [1, 2, 3, 4]]) as b from (select shard, left_over, list_sort(st) as st from walk where left_over > 1))),
placed as (select shard, unnest(m) as i, bin from (select shard, unnest(st[1].b).m as m, unnest([0, 1, 2, 3]) as bin from walk where left_over = 1))
select cast(rows.shard as bigint) as shard, event_id, n, cast(bin as int) as bin from rows join placed using (shard, i)""")
def op_a11_equal(spark, sf_dir):
    """Forty events at a time dealt to four bins of ten, of near-equal sums."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 40).alias("shard"), "event_id", F.floor(F.col("value") * 100).cast("long").alias("n"))
    return T.differencing(rows, "shard", "event_id", "n", 4, equal_size=True)


@query(f"""with recursive rows as (select {SHARD} as shard, doc_id, n_chars as n, row_number() over (partition by {SHARD} order by doc_id) as rn from documents),
walk as (select shard, doc_id, n, rn, 0 as bin, [n, 0, 0, 0] as sums from rows where rn = 1
union all select shard, doc_id, n, rn, p - 1, [case when i = p then s + n else s end for s, i in sums] from (select r.shard, r.doc_id, r.n, r.rn, w.sums, list_position(w.sums, list_min(w.sums)) as p from walk w join rows r on r.shard = w.shard and r.rn = w.rn + 1))
select shard, doc_id, n as n_chars, cast(bin as int) as bin from walk""")
def op_a12_greedy(spark, sf_dir):
    return T.least_loaded(_shards(spark, sf_dir), "shard", "doc_id", "n_chars", 4)


@query("select cast((row_number() over (order by doc_id) - 1) % 8 as int) as rank, n_chars, doc_id from documents qualify true")
def op_a14_rank(spark, sf_dir):
    # The i-th document goes to rank i mod 8; the number comes from counts of key ranges, not from one sorted partition.
    return global_row_number(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "rn").select(F.pmod(F.col("rn") - 1, F.lit(8)).cast("int").alias("rank"), "n_chars", "doc_id")


@query(f"""with chunks as (select conv_id, turn, text, unnest(range(0, length(text), 4)) as start from ({CHUNKS.replace(', unnest(range(0, length(text), 4)) as start', '')}) where role = 'assistant')
select conv_id, turn, count(*) as n_tokens, cast(sum({CHUNK_ID}) as bigint) as id_sum from chunks group by conv_id, turn""")
def op_a04_tensorize(spark, sf_dir):
    rows = T.chunk_tokens(table(spark, sf_dir, "conversations").where("role = 'assistant'"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_tokens"), F.sum("token_id").alias("id_sum"))


@query("""select conv_id, turn, cast(longest as bigint) as padded, cast(longest - n as bigint) as n_pad from (
select conv_id, turn, cast(ceil(length(text) / 4.0) as bigint) as n, max(cast(ceil(length(text) / 4.0) as bigint)) over (partition by conv_id) as longest from conversations where length(text) > 0)""")
def op_a09_collate(spark, sf_dir):
    ids = T.chunk_tokens(table(spark, sf_dir, "conversations")).groupBy("conv_id", "turn").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token_id"))), lambda x: x["token_id"]).alias("ids"))
    padded = T.right_pad(ids, "conv_id", {"ids": 0})
    return padded.select("conv_id", "turn", F.size("ids").cast("long").alias("padded"), F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("n_pad"))


@query("""with s as (select conv_id, turn, role, text, case when role = 'assistant' then 1 else 0 end as f, lag(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn) as p from conversations),
r as (select *, sum(case when f = 1 and coalesce(p, 0) <> 1 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as run from s)
select conv_id, cast(run as bigint) as run, min(turn) as first, max(turn) as last, string_agg(text, '' order by turn) as text from r where f = 1 group by conv_id, run""")
def op_a18_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("flag", (F.col("role") == "assistant").cast("int"))
    return T.mask_runs(rows, "conv_id", "turn", "flag", "text")


@query("""select conv_id, cast(max(turn) - min(case when role = 'assistant' then turn end) + 1 as bigint) as response_rows from conversations group by conv_id having count(*) filter (role = 'assistant') > 0""")
def op_a16_response(spark, sf_dir):
    mask = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: (x["role"] == "assistant").cast("int")).alias("mask"))
    first = F.array_position("mask", 1)
    return mask.where(first > 0).select("conv_id", (F.size("mask") - first + 1).cast("long").alias("response_rows"))


@query("""select l_orderkey, l_linenumber, batch, count(*) over (partition by l_orderkey, batch) as batch_size from (
select l_orderkey, l_linenumber, cast(floor((row_number() over (partition by l_orderkey order by l_linenumber) - 1) / 3) as bigint) as batch from lineitem)""")
def op_o05_batches(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").withColumn("batch", F.floor((F.row_number().over(w) - 1) / 3))
    return rows.select("l_orderkey", "l_linenumber", "batch", F.count("*").over(Window.partitionBy("l_orderkey", "batch")).alias("batch_size"))


@query("""with recursive rows as (select doc_id // 250 as step, doc_id % 4 as rank, doc_id, cast(n_chars as bigint) as n, row_number() over (partition by doc_id // 250, doc_id % 4 order by doc_id) as rn from documents),
walk as (select step, rank, rn, [n] as bins from rows where rn = 1
union all select r.step, r.rank, r.rn, case when len([b for b in w.bins if b + r.n <= 40000]) = 0 then list_append(w.bins, r.n) else [case when i = list_position([b + r.n <= 40000 for b in w.bins], true) then b + r.n else b end for b, i in w.bins] end from walk w join rows r on r.step = w.step and r.rank = w.rank and r.rn = w.rn + 1),
needed as (select step, greatest(max(len(bins)) // 2 * 2, 1) as k from walk group by step),
kk as (select step, rank, any_value(k) as k, count(*) as left_over, list({'k': case when k = 1 then 0 else -n end, 'h': -n, 'i': rn - 1, 'b': list_concat([{'n': -n, 'm': [rn - 1]}], list_transform(range(k - 1), lambda z: {'n': cast(0 as bigint), 'm': cast([] as bigint[])}))}) as st from rows join needed using (step) group by step, rank
union all select step, rank, k, left_over - 1, list_append(st[3:], {'k': b[1].n - b[k].n, 'h': b[1].n, 'i': i, 'b': b}) from (
 select step, rank, k, left_over, st, st[1].i as i, list_sort([{'n': st[1].b[j].n + st[2].b[k + 1 - j].n, 'm': list_concat(st[1].b[j].m, st[2].b[k + 1 - j].m)} for j in range(1, k + 1)]) as b from (select step, rank, k, left_over, list_sort(st) as st from kk where left_over > 1))),
placed as (select step, rank, k, unnest(m) as i, bin from (select step, rank, k, unnest(st[1].b).m as m, unnest(range(k)) as bin from kk where left_over = 1))
select rows.step, rows.rank, doc_id, n as n_chars, cast(bin as int) as bin, cast(k as int) as n_micro from rows join placed on placed.step = rows.step and placed.rank = rows.rank and placed.i = rows.rn - 1""")
def op_a15_schedule(spark, sf_dir):
    """Documents as the batches of four ranks: as many micro-batches as the fullest rank of a step needs, an even number, of near-equal sums."""
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 250).alias("step"), (F.col("doc_id") % 4).alias("rank"), "doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    return T.microbatch_schedule(rows, "step", "rank", "doc_id", "n_chars", 40_000, multiple=2)


def _masks(spark, sf_dir, method: str):
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").withColumn("step", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 0))
    path = public_tokenizers.path("byte_bpe_50k.json")
    if method == "response":
        return C.response_masks(rows, "conv_id", "turn", path, step="step")
    return C.message_masks(rows, "conv_id", "turn", path, method, C.Template(system="You are to help."), step="step")


@query()
def op_a17_alone(spark, sf_dir):
    """Token masks of every message, each block cut by itself."""
    return _masks(spark, sf_dir, "alone")


@query()
def op_a17_prefix(spark, sf_dir):
    """Token masks of every message, by what its block adds to another message's tokens."""
    return _masks(spark, sf_dir, "prefix")


@query()
def op_a17_offsets(spark, sf_dir):
    """Token masks of every message, by the characters that its tokens hold."""
    return _masks(spark, sf_dir, "offsets")


@query()
def op_a17_response(spark, sf_dir):
    """Tokens of every conversation's first message as a prompt and of its last text as the response that is trained."""
    return _masks(spark, sf_dir, "response")
