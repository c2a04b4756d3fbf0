"""Queries that look up, reconcile, score and validate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as G
from ..operators import rl as R
from ..operators import rules as V
from ..operators import text as X
from .registry import query, table


@query("""select e.event_id, l.event_id as last_id, l.value as last_value from events e left join (select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events where event_type = 'purchase' group by user_id) l on l.user_id = e.user_id and e.event_type = 'error' where e.event_type = 'error'""")
def op_j01_lastwins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    return J.last_wins(events.where("event_type = 'error'").select("event_id", "user_id"), last, ["user_id"], "last_id", ["last_id", "last_value"]).drop("user_id")


@query("""select user_id, coalesce(e, p) as event_id, case when e is not null then 'failed' else 'completed' end as kind from (select user_id, max(event_id) filter (event_type = 'error') as e, max(event_id) filter (event_type = 'purchase') as p from events where event_type in ('error', 'purchase') group by user_id)""")
def op_j02_failedwins(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").withColumn("kind", F.when(F.col("event_type") == "error", "failed").otherwise("completed"))
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "kind"), F.struct((F.col("kind") == "failed").cast("int").alias("f"), "event_id")).alias("x"))
    return last.select("user_id", "x.event_id", "x.kind")


@query("""select o_orderkey, array_to_string(list_filter([case when n is null then 'no_lines' end, case when o_orderstatus = 'F' and open > 0 then 'open_line' end, case when n > 6 then 'many_lines' end], lambda x: x is not null), ',') as mismatches from orders left join (select l_orderkey, count(*) as n, count(*) filter (l_linestatus = 'O') as open from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def op_j03_reconcile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    found = J.mismatches(rows, {"no_lines": F.col("n").isNull(), "open_line": (F.col("o_orderstatus") == "F") & (F.col("open") > 0), "many_lines": F.col("n") > 6})
    return found.select("o_orderkey", F.array_join("mismatches", ",").alias("mismatches"))


@query("select d.doc_id, cast((d.lang is not distinct from p.lang)::int + (d.source is not distinct from p.source)::int + (l.quality is not distinct from pl.quality)::int as int) as n_equal from documents d join documents p on p.doc_id = d.doc_id - 1 left join labels l on l.doc_id = d.doc_id left join labels pl on pl.doc_id = p.doc_id")
def op_j04_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), *(F.col(c).alias(f"p_{c}") for c in ("lang", "source", "quality")))
    return rows.join(before, "doc_id").select("doc_id", J.equal_columns([(c, f"p_{c}") for c in ("lang", "source", "quality")]).cast("int").alias("n_equal"))


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def op_j05_semi(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("select s_suppkey, n_name, r_name from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def op_j06_resolve(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    named = J.first_match(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nation, ["s_nationkey"], "n_name", ["n_name", "n_regionkey"])
    return J.first_match(named, region, ["n_regionkey"], "r_name", ["r_name"]).select("s_suppkey", "n_name", "r_name")


@query("""select status, count(*) as n from (select case when e.event_type = 'signup' then 'dropped' when m.name is null then 'unmapped' else 'mapped' end as status from events e left join (values ('view', 'look'), ('click', 'press'), ('purchase', 'buy')) m(event_type, name) using (event_type)) group by status""")
def op_j07_remap(spark, sf_dir):
    names = spark.createDataFrame([("view", "look"), ("click", "press"), ("purchase", "buy")], "event_type string, name string")
    status = F.when(F.col("event_type") == "signup", "dropped").when(F.col("name").isNull(), "unmapped").otherwise("mapped")
    return table(spark, sf_dir, "events").join(F.broadcast(names), "event_type", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("select v.user_id, v.event_id, min(p.event_id) as later from events v join events p on p.user_id = v.user_id and p.event_id > v.event_id and p.event_type = 'purchase' where v.event_type = 'view' group by v.user_id, v.event_id")
def op_j08_later(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return J.later_matches(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), ["user_id"], "event_id")


@query("""select l_orderkey, l_linenumber, p_name, s_name from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where p_size = 10 and s_acctbal > 0""")
def op_j09_lineage(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size = 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part, "l_partkey").join(supplier, "l_suppkey").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("""with a as (select event_type, count(*) as n, median(value) as m from events where user_id < 75 group by event_type), b as (select event_type, count(*) as n, median(value) as m from events where user_id >= 75 and event_type <> 'signup' group by event_type) select coalesce(a.event_type, b.event_type) as event_type, b.n - a.n as n, round(b.m - a.m, 6) as m from a full join b on a.event_type = b.event_type""")
def op_j11_delta(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    side = lambda c: G.quantiles(events.where(c), "value", {"m": 0.5}, "event_type")
    d = J.deltas(side("user_id < 75"), side("user_id >= 75 and event_type <> 'signup'"), "event_type", ["n", "m"])
    return d.select("event_type", "n", F.round("m", 6).alias("m"))


@query("""with e as (select user_id, event_id, epoch_us(ts) as s, epoch_us(ts) + cast(round(value * 100) as bigint) * 600000 as t from events),
g as (select user_id, s as gap_start, t as gap_end from e join events using (user_id, event_id) where event_type = 'error'), m as (select g.user_id, gap_start, gap_end, arg_min(event_id, (s, event_id)) as op_id from g join e on e.user_id = g.user_id and s < gap_end and t > gap_start and e.event_id in (select event_id from events where event_type = 'click') group by g.user_id, gap_start, gap_end) select * from m""")
def op_j12_overlap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("t", F.col("s") + F.round(F.col("value") * 100).cast("long") * 600_000)
    gaps = e.where("event_type = 'error'").select("user_id", F.col("s").alias("gap_start"), F.col("t").alias("gap_end"))
    ops = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("op_id"), F.col("s").alias("op_start"), F.col("t").alias("op_end"))
    return J.overlapping(gaps, ops, "user_id", 3_600_000_000)


@query("select o.o_orderkey from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def op_j13_orphans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("select d.doc_id, case when l.quality is null then 'pending' when l.quality = 1 then 'completed' else 'failed' end as status from documents d left join labels l using (doc_id)")
def op_j16_runplan(spark, sf_dir):
    records = table(spark, sf_dir, "labels").withColumn("status", F.when(F.col("quality") == 1, "completed").otherwise("failed"))
    return J.pending(table(spark, sf_dir, "documents").select("doc_id"), records, "doc_id")


@query("""select p_partkey, rule, n = 1 as "unique" from (select p_partkey, arg_min(rule, (priority, rule)) as rule, count(*) filter (priority = lowest) as n from (select p_partkey, rule, priority, min(priority) over (partition by p_partkey) as lowest from part join (values ('small', 1), ('cheap', 2), ('economy', 2)) r(rule, priority) on (rule = 'small' and p_size < 10) or (rule = 'cheap' and p_retailprice < 1000) or (rule = 'economy' and p_type = 'ECONOMY')) group by p_partkey)""")
def op_j17_rules(spark, sf_dir):
    rules = [("small", 1, F.col("p_size") < 10), ("cheap", 2, F.col("p_retailprice") < 1000), ("economy", 2, F.col("p_type") == "ECONOMY")]
    return J.first_rule(table(spark, sf_dir, "part"), "p_partkey", rules).where(F.col("rule").isNotNull()).select("p_partkey", "rule", "unique")


@query("""select n_name, r_name, substr(sha256('{"n_name":"' || n_name || '","r_name":"' || r_name || '"}'), 1, 20) as run_id from region cross join nation""")
def op_j18_matrix(spark, sf_dir):
    return J.matrix(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"))


@query("""with a as (select doc_id, unnest(string_split(lower(text), ' ')) as token from documents), b as (select item_id, unnest(string_split(lower(text), ' ')) as token from benchmark),
ca as (select doc_id, token, count(*) as n from a group by doc_id, token), cb as (select item_id, token, count(*) as n from b group by item_id, token)
select doc_id, item_id, cast(sum(least(ca.n, cb.n)) as bigint) as common from ca join cb using (token) group by doc_id, item_id""")
def op_o10_multiset(spark, sf_dir):
    words = lambda df, key: df.select(key, F.explode(F.split(F.lower("text"), " ", -1)).alias("token"))
    return J.multiset_overlap(words(table(spark, sf_dir, "documents"), "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id"), "doc_id", "item_id", "token")


@query("""with a as (select doc_id, unnest(string_split(lower(text), ' ')) as token from documents), b as (select item_id, unnest(string_split(lower(text), ' ')) as token from benchmark),
ca as (select doc_id, token, count(*) as n from a group by doc_id, token), cb as (select item_id, token, count(*) as n from b group by item_id, token)
select doc_id, item_id, cast(sum(least(ca.n, cb.n)) as bigint) as common from ca join cb using (token) group by doc_id, item_id having sum(least(ca.n, cb.n)) >= 12""")
def op_o10_atleast(spark, sf_dir):
    """Documents and items with twelve words or more in common; pairs that share only frequent words do not meet."""
    words = lambda df, key: df.select(key, F.explode(F.split(F.lower("text"), " ", -1)).alias("token"))
    return J.overlaps_of_least(words(table(spark, sf_dir, "documents"), "doc_id"), words(table(spark, sf_dir, "benchmark"), "item_id"), "doc_id", "item_id", "token", 12)


@query("select event_id, attempt from (select e.event_id, 1 as attempt from events e where event_type = 'view' and user_id not in (select user_id from events where event_type = 'purchase' and value > 100))")
def op_t06_resume(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = events.where("event_type = 'purchase' and value > 100").select("user_id", F.lit("done").alias("status"))
    return J.still_to_run(events.where("event_type = 'view'").select("event_id", "user_id"), done, "user_id", ("done",)).select("event_id", F.col("attempt").cast("int").alias("attempt"))


# ---- text, hashes and scores


@query("select event_id, cast(cast('0x' || substr(sha256(cast(event_id as varchar)), 1, 8) as ubigint) % 5 as bigint) as bucket from events")
def op_x08_bucket(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.hash_bucket(F.col("event_id").cast("string"), 5).alias("bucket"))


@query("select doc_id, case when lang = 'es' then 'eval_unseen' when cast('0x' || substr(sha256(source || ':' || doc_id), 1, 8) as ubigint) % 5 = 0 then 'eval_seen' else 'train' end as split from documents")
def op_x09_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.split_name(F.concat_ws(":", "source", "doc_id"), F.col("lang") == "es").alias("split"))


@query("select p_partkey, cast(1 + cast('0x' || substr(sha256('7:' || p_name || ':desc:mut'), 1, 8) as ubigint) % 4 as bigint) as variant from part")
def op_x10_variant(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.variant_index(F.lit("7"), F.col("p_name"), "desc", 5).alias("variant"))


@query("""select p_partkey, array_to_string(list_distinct_keep, ',') as names from (select p_partkey, [s, lower(p[1]) || p[2:], p, s || '_tool', 'use_' || s] as list_distinct_keep from (select p_partkey, replace(p_name, ' ', '_') as s, array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], '') as p from part))""")
def op_x11_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.name_candidates(F.col("p_name")), ",").alias("names"))


@query("""select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') as fingerprint from events""")
def op_x14_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.fingerprint("event_type", "event_id", "user_id").alias("fingerprint"))


@query("select source, sha256(string_agg(p || chr(1) || n_chars || chr(1) || sha256(text) || chr(10), '' order by p)) as digest from (select *, lpad(cast(doc_id as varchar), 8, '0') as p from documents) group by source")
def op_x15_treedigest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("p"), "n_chars", F.sha2("text", 256).alias("h"))
    return X.tree_digests(rows, "source", "p", "n_chars", "h", "\x01")


#: Documents with a secret of each kind planted in every fifth one, in forms that differ in case, spelling and layout.
SECRETS = [
    "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F-1E\n\nMIIB-x+/=\n-----END RSA PRIVATE KEY-----",
    "Authorization: Basic dXNlcjpwYXNz; API-Key: k-123, apikey=zz9",
    "BEARER abc.def-ghi and bearer x~y",
    "write to Some.One+tag@Mail.Example.ORG or look in /Users/some.one/notes",
    "Secret_Key = s3 and ACCESS-TOKEN:t0k",
]
PLANTED = "(select doc_id, lang, text || chr(10) || case doc_id % 5 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(SECRETS)) + " end as text from documents)"


def _planted(spark, sf_dir):
    kinds = F.lit(None).cast("string")
    for i, s in enumerate(SECRETS):
        kinds = F.when(F.col("doc_id") % 5 == i, F.lit(s)).otherwise(kinds)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat("text", F.lit("\n"), kinds).alias("text"))


def _re2(pattern: str) -> str:
    """The pattern without its look-ahead, which RE2 lacks; the documents hold no placeholders, so nothing is different."""
    return pattern.replace("(?!<redacted>)", "")


def _scrub_sql() -> str:
    text, parts = "text", []
    for name, pattern, new in X.SCRUB_PATTERNS:
        parts.append((name, text, _re2(pattern)))
        new = new.replace("$1", "\\1").replace("\\$", "$")
        text = f"regexp_replace({text}, '{_re2(pattern)}', '{new}', 'g')"
    counts = ", ".join(f"cast(len(regexp_extract_all({t}, '{p}')) as bigint) as {n}" for n, t, p in parts)
    return f"select doc_id, {text} as scrubbed, {counts} from {PLANTED}"


@query(_scrub_sql())
def op_x16_scrub(spark, sf_dir):
    text, counts = X.scrubbed(F.col("text"))
    return _planted(spark, sf_dir).select("doc_id", text.alias("scrubbed"), *(c.alias(n) for n, c in counts))


ARTIFACT_CLASS = "case lang when 'en' then 'trace' when 'de' then 'log' when 'fr' then 'raw_provider_payload' else 'report' end"


@query("select doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in X.RISK_PATTERNS) + ", " + ", ".join(f"case when {ARTIFACT_CLASS} = '{c}' then '{r}' end" for c, r in X.CLASS_RISKS.items()) + f"], lambda x: x is not null)), ',') as risks from {PLANTED}")
def op_x17_risk(spark, sf_dir):
    return _planted(spark, sf_dir).select("doc_id", F.array_join(X.risk_labels(F.col("text"), F.expr(ARTIFACT_CLASS)), ",").alias("risks"))


@query("select page_id, case when url like '%casino%' then 'spam' when url like '%//blog.%' then 'blog' when regexp_matches(url, '\\?.*utm_') then 'tracked' when url like 'https:%' then 'secure' else 'plain' end as class from pages")
def op_x18_class(spark, sf_dir):
    u = F.col("url")
    kind = F.when(u.contains("casino"), "spam").when(u.contains("//blog."), "blog").when(u.rlike(r"\?.*utm_"), "tracked").when(u.startswith("https:"), "secure").otherwise("plain")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("class"))


@query("select page_id, case when regexp_matches(url, '^https?://[a-z.]+/en/[0-9]+$') then url else 'sha256:' || sha256(url) end as safe from pages")
def op_x19_sanitise(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(u.rlike("^https?://[a-z.]+/en/[0-9]+$"), u).otherwise(F.concat(F.lit("sha256:"), F.sha2(u, 256))).alias("safe"))


@query()
def op_x21_repeat(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.repetition("text").alias("r")).select("doc_id", "r.ratio", "r.repeated")


#: RE2's word boundary knows ASCII only, so articles are told by what stands beside them, in two passes as neighbours share it.
_ARTICLE = "'(^|[^\\pL\\pN_])(a|an|the)([^\\pL\\pN_]|$)', '\\1 \\3', 'g'"
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g'), " + _ARTICLE + "), " + _ARTICLE + "), '\\s+', ' ', 'g'))"


@query(f"""with p as (select d.doc_id, b.item_id, {NORM.format('d.text')} as p, {NORM.format('b.text')} as t from documents d join benchmark b on b.item_id = d.doc_id % 40),
w as (select doc_id, item_id, p, t, [x for x in string_split(p, ' ') if x <> ''] as pw, [x for x in string_split(t, ' ') if x <> ''] as tw from p),
c as (select *, coalesce(list_sum([least(len([y for y in pw if y = x]), len([y for y in tw if y = x])) for x in list_distinct(list_intersect(pw, tw))]), 0) as common from w)
select doc_id, item_id, round(case when common = 0 then 0.0 else 2.0 * (common / len(pw)) * (common / len(tw)) / (common / len(pw) + common / len(tw)) end, 9) as f1 from c""")
def op_x22_f1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), X.normalized_answer(F.col("text")).alias("p"))
    items = table(spark, sf_dir, "benchmark").select("item_id", X.normalized_answer(F.col("text")).alias("t"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(X.token_f1(F.col("p"), F.col("t"))["f1"], 9).alias("f1"))


@query("select event_id, round(least(1.0, (0.1 + case when event_type = 'click' then 0.4 else 0 end + case when value > 50 then 0.4 else 0 end) / 0.9), 9) as reward from events")
def op_x03_reward(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(X.call_reward(F.col("event_type") == "click", F.col("value") > 50), 9).alias("reward"))


@query("""select event_id, error, name from (select event_id, case event_id % 5 when 0 then null when 1 then 'no_block' when 2 then 'not_closed' when 3 then 'missing_name' else 'invalid_json' end as error, case event_id % 5 when 0 then event_type when 2 then event_type when 3 then '' end as name from events)""")
def op_x01_parse(spark, sf_dir):
    body = F.concat(F.lit('{"name": "'), F.when(F.col("event_id") % 5 == 3, "").otherwise(F.col("event_type")), F.lit('", "arguments": '), "props", F.lit("}"))
    kind = F.col("event_id") % 5
    text = F.when(kind == 1, "plain text").when(kind == 2, F.concat(F.lit("<|tool|>\n"), body)).when(kind == 4, "<|tool|>\n{broken\n<|end|>").otherwise(F.concat(F.lit("so: <|tool|>\n"), body, F.lit("\n<|end|>\n")))
    call = table(spark, sf_dir, "events").select("event_id", X.tool_call_block(text).alias("c"))
    return call.select("event_id", "c.error", "c.name")


@query("""select event_id, case event_id % 7 when 1 then '$.k' when 2 then '$.z' when 3 then '$.k' when 4 then '$' when 5 then '$.k' else case when cast(json_extract_string(props, '$.k') as bigint) >= 50 then '$.k' end end as fault from events""")
def op_x05_schema(spark, sf_dir):
    """Events' properties against a schema; a flag for a number, a stray and a missing property, broken text and another type are planted."""
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "enum": list(range(50))}}, "additionalProperties": False}
    k = F.col("event_id") % 7
    text = F.when(k == 1, '{"k": true}').when(k == 2, '{"k": 3, "z": 1}').when(k == 3, "{}").when(k == 4, '{"k": ').when(k == 5, '{"k": "3"}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", X.schema_check(text, schema).alias("fault"))


@query("""select event_id, case event_id % 4 when 0 then event_type when 1 then event_type || '{' || user_id || '}' when 2 then null else 'a' || user_id end as answer from events""")
def op_x25_boxed(spark, sf_dir):
    k = F.col("event_id") % 4
    tail = F.when(k == 0, F.concat(F.lit(r" and \boxed{"), "event_type", F.lit("} done"))).when(k == 1, F.concat(F.lit(r" then \boxed{"), "event_type", F.lit("{"), "user_id", F.lit("}} done"))).when(k == 2, r" but \boxed{never closed").otherwise(F.concat(F.lit(r"\boxed{a"), "user_id", F.lit("} end")))
    text = F.concat(F.lit(r"so \boxed{"), F.col("props"), F.lit("}"), tail)
    return table(spark, sf_dir, "events").select("event_id", X.boxed_answer(text).alias("answer"))


@query("select conv_id, turn, coalesce(cast(len(string_split(regexp_replace(text, chr(10) || '+', chr(10), 'g'), chr(10))) as bigint), 0) as n_blocks from conversations where trim(text) <> ''")
def op_x29_sse(spark, sf_dir):
    lines = F.concat(F.lit("data: "), F.regexp_replace("text", "\n+", "\r\n\r\ndata: "))
    return table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.size(X.sse_blocks(lines)).cast("long").alias("n_blocks"))


@query("select o_orderkey, case when o_orderdate + interval 90 day < timestamp '1998-01-01' then 'expired' else 'kept' end as disposition from orders")
def op_x31_retention(spark, sf_dir):
    cutoff = F.col("o_orderdate") + F.expr("interval 90 days")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(cutoff < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), "expired").otherwise("kept").alias("disposition"))


@query("select event_id from events where event_id = (select max(event_id) from events) or (event_id + 1) % 100 = 0")
def op_x34_periodic(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    last = events.agg(F.max("event_id").alias("last"))
    return events.crossJoin(F.broadcast(last)).where((F.col("event_id") == F.col("last")) | (F.pmod(F.col("event_id") + 1, F.lit(100)) == 0)).select("event_id")


@query("select p_partkey, substr(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24) as slug from part")
def op_x35_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


# ---- numbers of training batches


def _orders_arrays(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_returnflag"))).alias("s"))
    return rows.select("l_orderkey", F.transform("s", lambda x: x["l_quantity"]).alias("r"), F.transform("s", lambda x: x["l_discount"]).alias("v"), F.transform("s", lambda x: (x["l_returnflag"] == "N").cast("double")).alias("m"))


ARRAYS = "(select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_discount, l_returnflag) as r, list(l_discount order by l_linenumber, l_quantity, l_discount, l_returnflag) as v, list(case when l_returnflag = 'N' then 1.0 else 0.0 end order by l_linenumber, l_quantity, l_discount, l_returnflag) as m from lineitem group by l_orderkey)"


@query(f"select l_orderkey, round(list_sum([x * power(0.9, i - 1) for x, i in r]), 9) as first_return, cast(len(r) as bigint) as n from {ARRAYS}")
def op_w11_returns(spark, sf_dir):
    g = R.discounted_returns(F.col("r"), 0.9)
    return _orders_arrays(spark, sf_dir).select("l_orderkey", F.round(F.element_at(g, 1), 9).alias("first_return"), F.size("r").cast("long").alias("n"))


@query(f"select l_orderkey, round(list_sum([power(0.25, i - 1) * (r[i] + 0.5 * coalesce(r[i + 1], 0) / 8 - r[i] / 8) for x, i in r]), 9) as advantage from {ARRAYS}")
def op_w12_gae(spark, sf_dir):
    a = R.gae(F.col("r"), F.transform("r", lambda x: x / 8), 0.5, 0.5)
    return _orders_arrays(spark, sf_dir).select("l_orderkey", F.round(F.element_at(a, 1)["advantage"], 9).alias("advantage"))


@query("select event_id, round(x * x / 2, 9) as k2, round(exp(-x) - 1 + x, 9) as k3, round(greatest(-10, least(10, exp(-x) - 1 + x)), 9) as low_var from (select event_id, (value - 50) / 20 as x from events)")
def op_a20_kl(spark, sf_dir):
    x = (F.col("value") - 50) / 20
    return table(spark, sf_dir, "events").select("event_id", *(F.round(R.kl(x, k), 9).alias(k) for k in ("k2", "k3", "low_var")))


@query("select event_id, round(case when a < 0 then least(greatest(-w * a, -greatest(0.8, least(1.2, w)) * a), -3.0 * a) else greatest(-w * a, -greatest(0.8, least(1.2, w)) * a) end, 9) as loss, -greatest(0.8, least(1.2, w)) * a > -w * a as clipped from (select event_id, value / 50 as w, case when event_type = 'error' then -1.0 else 0.5 end as a from events)")
def op_a21_ppo(spark, sf_dir):
    loss, clipped = R.clipped_loss(F.col("value") / 50, F.when(F.col("event_type") == "error", -1.0).otherwise(0.5), 0.2, 0.2, dual=3.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(loss, 9).alias("loss"), clipped.alias("clipped"))


@query(f"select l_orderkey, round(list_sum([v[i] * m[i] for x, i in v]) / greatest(list_sum(m), 1), 9) as seq_kl from {ARRAYS}")
def op_a22_seqkl(spark, sf_dir):
    return _orders_arrays(spark, sf_dir).select("l_orderkey", F.round(R.masked_array_mean(F.col("v"), F.col("m")), 9).alias("seq_kl"))


@query("select event_id, round(least(w, 2.0), 9) as truncated, round(greatest(0.5, least(w, 2.0)), 9) as clipped, round(case when w >= 0.5 and w <= 2.0 then w else 0.0 end, 9) as masked from (select event_id, exp(greatest(-20, least(20, (value - 50) / 40))) as w from events)")
def op_a23_importance(spark, sf_dir):
    x = (F.col("value") - 50) / 40
    return table(spark, sf_dir, "events").select("event_id", *(F.round(R.importance_weight(x, mode, 0.5, 2.0), 9).alias(name) for mode, name in (("truncate", "truncated"), ("clip", "clipped"), ("mask", "masked"))))


@query(f"select l_orderkey, array_to_string([cast(x as bigint) for x in r[2:][greatest(len(r) - 2, 1):]], ',') as tail from {ARRAYS}")
def op_a27_teacher(spark, sf_dir):
    return _orders_arrays(spark, sf_dir).select("l_orderkey", F.array_join(F.transform(R.last_n(F.col("r"), F.lit(2)), lambda x: x.cast("long").cast("string")), ",").alias("tail"))


_TOKENS = "(select l_orderkey as s, case when l_linestatus = 'O' then 1.0 else 0.0 end as m, -l_discount * 8 as new, -l_tax * 8 as old, case l_returnflag when 'R' then -1.0 when 'A' then 0.5 else 1.0 end as a from lineitem)"
_CLIPPED = "greatest(-r * a, -greatest(0.8, least(1.28, r)) * a)"


def _batch_tokens(spark, sf_dir):
    advantage = F.when(F.col("l_returnflag") == "R", -1.0).when(F.col("l_returnflag") == "A", 0.5).otherwise(1.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_linestatus") == "O").cast("int").alias("m"), (F.col("l_discount") * -8).alias("new"), (F.col("l_tax") * -8).alias("old"), advantage.alias("a"))


@query(f"""with t as (select *, exp(new - old) as r from {_TOKENS}), p as (select s, sum(m) as m, sum({_CLIPPED} * m) as l, sum(case when -greatest(0.8, least(1.28, r)) * a > -r * a then m else 0 end) as c, sum((old - new) * m) as k from t group by s)
select count(*) as n_samples, cast(sum(m) as bigint) as n_tokens, round(sum(l / greatest(m, 1)), 6) as pg_loss, round(sum(c / greatest(m, 1)), 6) as pg_clipfrac, round(sum(k / greatest(m, 1)), 6) as ppo_kl from p""")
def op_a26_policy(spark, sf_dir):
    report = R.policy_report(_batch_tokens(spark, sf_dir), "s", F.col("m"), F.col("new"), F.col("old"), F.col("a"), 0.2, 0.28)
    return report.select("n_samples", "n_tokens", *(F.round(c, 6).alias(c) for c in ("pg_loss", "pg_clipfrac", "ppo_kl")))


@query(f"""with p as (select s, sum(m) as m, sum(-new * m) as l from {_TOKENS} group by s)
select count(*) as n_samples, cast(sum(m) as bigint) as n_tokens, round(sum(l / greatest(m, 1)), 6) as mean_loss, round(sum(l), 6) as token_loss from p""")
def op_a26_sft(spark, sf_dir):
    """The supervised loss of a batch as the sum of its samples' means, and as the sum of its tokens."""
    rows = _batch_tokens(spark, sf_dir)
    means, tokens = R.sft_report(rows, "s", F.col("m"), F.col("new")), R.sft_report(rows, "s", F.col("m"), F.col("new"), per_token=True)
    return means.select("n_samples", "n_tokens", F.round("loss", 6).alias("mean_loss")).crossJoin(tokens.select(F.round("loss", 6).alias("token_loss")))


# ---- rules


@query("""with s as (select user_id, event_id as start, event_id + cast(floor(value) as bigint) % 40 as "end", 9990 as len from events)
select user_id, start, "end", code from (select user_id, start, "end", unnest(list_filter([case when "end" > len then 'beyond_text' end, case when start < reach then 'overlap' end], lambda x: x is not null)) as code from (
select *, max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding) as reach from s))""")
def op_v06_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value") % 40).alias("end"), F.lit(9990).alias("len"))
    return V.checked_spans(rows, "user_id", "start", "end", "len")


@query("""with k as (select conv_id, turn, (conv_id + turn) % 6 as k, turn % 2 = 1 as trained, ceil(length(text) / 4.0) as n from conversations where length(text) > 0)
select conv_id, turn, case k when 0 then 'length_mismatch' when 1 then 'mask_not_binary' when 2 then 'label_not_ignored' when 3 then 'label_not_id' end as code from k where k in (0, 1) or (k = 2 and not trained) or (k = 3 and trained)""")
def op_v07_tokenized(spark, sf_dir):
    """Messages as tokenized examples, odd turns trained; a missing entry, a mask of 2, a label under a mask of 0 and one that is another id are planted."""
    from ..operators import tokens as T

    ids = T.chunk_tokens(table(spark, sf_dir, "conversations")).groupBy("conv_id", "turn").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token_id"))), lambda x: x["token_id"]).alias("ids"))
    k, n = (F.col("conv_id") + F.col("turn")) % 6, F.size("ids")
    flag = F.col("turn") % 2
    head = lambda first, rest: F.concat(F.array(first), F.slice(rest, F.lit(2), n))
    rows = ids.withColumns({"att": F.array_repeat(F.lit(1), n), "mask": F.array_repeat(flag.cast("int"), n), "labels": F.transform("ids", lambda x: F.when(flag == 1, x).otherwise(-100))})
    rows = rows.withColumns({"att": F.when(k == 0, F.slice("att", F.lit(2), n)).otherwise(F.col("att")), "mask": F.when(k == 1, head(F.lit(2), F.col("mask"))).otherwise(F.col("mask")), "labels": F.when(k == 2, F.when(flag == 0, head(F.lit(7).cast("long"), F.col("labels"))).otherwise(F.col("labels"))).when(k == 3, F.when(flag == 1, head(F.lit(-5).cast("long"), F.col("labels"))).otherwise(F.col("labels"))).otherwise(F.col("labels"))})
    return V.violations(rows, ["conv_id", "turn"], V.tokenized_rules("ids", "att", "labels", "mask"))


@query("select code, count(*) as n from (select unnest(list_filter([case when coalesce(trim(text), '') = '' then 'empty_text' end, case when n_chars <> length(text) then 'length' end, case when lang not in ('en', 'de') then 'language' end, case when n_chars > 10000 then 'too_long' end], lambda x: x is not null)) as code from documents) group by code")
def op_v10_shape(spark, sf_dir):
    rules = [("empty_text", F.coalesce(F.trim("text"), F.lit("")) == ""), ("length", F.col("n_chars") != F.length("text")), ("language", ~F.col("lang").isin("en", "de")), ("too_long", F.col("n_chars") > 10_000)]
    return V.violations(table(spark, sf_dir, "documents"), ["doc_id"], rules).groupBy("code").agg(F.count("*").alias("n"))


@query("select count(*) as n_rows, count(*) filter (n_chars > 10000) as n_issues, count(*) filter (n_chars > 10000) = 0 as ok from documents")
def op_v08_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return V.report(V.violations(docs, ["doc_id"], [("too_long", F.col("n_chars") > 10_000)]), docs)
