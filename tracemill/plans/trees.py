"""Queries on trees of run files, logs, manifests and reports: each writes the files that it reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbering import global_row_number
from ..functions.storage import fresh_path
from ..operators import messages as M
from ..operators import metrics as G
from ..operators import text as X
from ..sources import records as S
from .registry import query, table


def _tree(rows, path: str, *folders: str) -> str:
    """One JSON file in a folder for each value of `folders`."""
    S.write_tree(rows, path, list(folders))
    return path


def _conversations(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    return said.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first")).withColumn("run", F.col("conv_id"))


@query("select distinct 'run=' || conv_id as run, 0 as priority from conversations")
def op_s04_runpaths(spark, sf_dir):
    path = _tree(_conversations(spark, sf_dir), fresh_path(spark, "s04"), "run")
    return S.discover_runs(spark, path, "part-*.json").select("run", "priority")


@query("select distinct 'run=' || conv_id as run, 0 as priority from conversations where conv_id % 2 = 0")
def op_s05_layouts(spark, sf_dir):
    """Runs in two layouts, of which only the better one is read."""
    path, rows = fresh_path(spark, "s05"), _conversations(spark, sf_dir)
    _tree(rows.where("conv_id % 2 = 0"), path, "run")
    _tree(rows.where("conv_id % 2 = 1"), f"{path}/runs", "run")
    return S.discover_runs(spark, path, "part-*.json").select("run", "priority")


@query("select o_orderkey as run, 'runs/' || o_orderkey || '/trajectory.json' as path from orders where o_orderstatus = 'F'")
def op_s06_terminal(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("runs/"), "o_orderkey", F.lit("/trajectory.json"))
    records = orders.select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "F", "trajectory_recorded").otherwise("aborted").alias("outcome"), F.when(F.col("o_orderstatus") == "F", path).otherwise("../outside").alias("path"))
    return S.terminal_runs(records, orders.select(path.alias("path")))


@query("select distinct 'experiment=' || conv_id % 3 as experiment, 'run=' || conv_id as run from conversations")
def op_s07_study(spark, sf_dir):
    path = fresh_path(spark, "s07")
    _tree(_conversations(spark, sf_dir).withColumn("experiment", F.col("conv_id") % 3), f"{path}/experiments", "experiment", "run")
    return S.discover_study(spark, path, "part-*.json").select("experiment", "run")


@query("select conv_id, count(*) as n, min(turn) as first from conversations group by conv_id")
def op_s08_trajectories(spark, sf_dir):
    path = _tree(_conversations(spark, sf_dir), fresh_path(spark, "s08"), "run")
    return S.load_trajectories(spark, path, "conv_id long, n long, first long")


@query("select distinct 'user=' || user_id % 50 as session from events")
def op_s09_sessions(spark, sf_dir):
    """Session logs by their suffix; other files of the folder are not listed."""
    path = _tree(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("user")), fresh_path(spark, "s09"), "user")
    table(spark, sf_dir, "region").select("r_name").coalesce(1).write.mode("append").text(f"{path}/notes")
    return S.list_files(spark, path, "*.json").select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("session"))


@query("select 'key=' || r_regionkey as folder, cast(octet_length(encode(r_name)) + 1 as bigint) as size, sha256(r_name || chr(10)) as digest from region")
def op_s10_artifacts(spark, sf_dir):
    path = fresh_path(spark, "s10")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), "r_name").repartition(1, "key").write.partitionBy("key").text(path)
    found = S.artifacts(spark, path).where(F.col("path").contains("/key="))
    return found.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "size", "digest")


@query("select o_orderkey as task_id, o_orderpriority as prompt, case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 9 as int) end as max_turns from orders")
def op_s11_tasks(spark, sf_dir):
    """Typed tasks from JSON lines, blank and broken lines between them."""
    orders, path = table(spark, sf_dir, "orders"), fresh_path(spark, "s11") + ".jsonl"
    line = F.to_json(F.struct(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("prompt"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 9).alias("max_turns")))
    noise = F.when(F.col("o_orderkey") % 5 == 0, "{broken").when(F.col("o_orderkey") % 5 == 1, "")
    orders.select(F.explode(F.array_compact(F.array(line, noise))).alias("value")).write.text(path)
    return S.read_records(spark, path, "task_id long, prompt string, max_turns int").where("task_id is not null")


@query("select event_type as name, count(*) as n, cast(sum(user_id) as bigint) as dur from events group by event_type")
def op_s12_trace(spark, sf_dir):
    """Profiler traces, one a user, gzipped; the time of their events by name."""
    path = fresh_path(spark, "s12")
    traces = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("dur"))).alias("traceEvents"))
    traces.select("traceEvents").write.option("compression", "gzip").json(path)
    return S.read_trace(spark, path, "name:string,dur:long").groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("dur"))


@query("select cast(epoch as int) as epoch, count(*) as n, count(*) as n_places, cast(1 as bigint) as lowest, count(*) as highest, true as again, true as moved from customer, (select unnest([0, 1]) as epoch) group by epoch")
def op_s14_shuffle(spark, sf_dir):
    """Two epochs' orders of the customers: each a permutation, the same when made again, and not the keys' own order."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")

    def order(epoch: int):
        one, two = S.shuffled(rows, "c_custkey", 7, epoch), S.shuffled(rows, "c_custkey", 7, epoch).withColumnRenamed("place", "other")
        both = one.join(two, "c_custkey").join(global_row_number(rows, ["c_custkey"], "own"), "c_custkey")
        return both.agg(
            F.lit(epoch).alias("epoch"), F.count("*").alias("n"), F.count_distinct("place").alias("n_places"), F.min("place").alias("lowest"), F.max("place").alias("highest"),
            F.bool_and(F.col("place") == F.col("other")).alias("again"), (F.count_if(F.col("place") != F.col("own")) > F.count("*") / 2).alias("moved"),
        )

    return order(0).union(order(1))


@query("select c_custkey, place from (select c_custkey, cast(row_number() over (order by case when c_acctbal < 0 then 0 else 1 end, c_custkey) as bigint) as place, count(*) over () as n from customer) where place <= 100")
def op_s15_buffer(spark, sf_dir):
    """Buffered groups go out before the dataset's."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return S.buffered_first(rows.where("c_acctbal < 0"), rows.where("c_acctbal >= 0"), "c_custkey", 100).select("c_custkey", "place")


@query("select r_name as profile, n_name as tool, cast(n_nationkey as int) as version from nation join region on r_regionkey = n_regionkey")
def op_s17_profiles(spark, sf_dir):
    """A manifest of profiles with their tools, as rows."""
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    text = both.groupBy("r_name").agg(F.to_json(F.struct(F.col("r_name").alias("profile"), F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("version"))).alias("tools"))).alias("value"))
    path = fresh_path(spark, "s17") + ".json"
    text.select("value").write.text(path)
    found = S.read_records(spark, path, "profile string, tools array<struct<name:string,version:int>>")
    return found.select("profile", F.explode("tools").alias("t")).select("profile", F.col("t.name").alias("tool"), "t.version")


@query("""select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","note":' || case when doc_id % 3 = 0 then 'null' else '"n"' end || '}' as line from documents""")
def op_k01_jsonl(spark, sf_dir):
    path = fresh_path(spark, "k01")
    S.append_records(table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, "n").alias("note")), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("line"))


@query("select event_type, count(*) as n, min(event_id) as first from events group by event_type")
def op_k03_append(spark, sf_dir):
    """Rollouts exported type by type to one path, and read back."""
    events, path = table(spark, sf_dir, "events").select("event_id", "event_type"), fresh_path(spark, "k03") + ".jsonl"
    S.append_records(events.where("event_type = 'click'"), path)
    S.append_records(events.where("event_type <> 'click'"), path)
    return S.read_records(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("select user_id, count(*) as n, cast(0 as bigint) as out_of_order, cast(1 as bigint) as n_files from events group by user_id")
def op_k04_inorder(spark, sf_dir):
    """Event logs written by key and order: each key lies in one file, in order."""
    from pyspark.sql import Window

    path = fresh_path(spark, "k04")
    S.write_in_order(table(spark, sf_dir, "events").select("user_id", "event_id"), path, "user_id", "event_id")
    lines = spark.read.schema("user_id long, event_id long").json(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("event_id").over(Window.partitionBy("file", "user_id").orderBy("at"))
    return lines.withColumn("late", (before > F.col("event_id")).cast("long")).groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("late"), F.lit(0)).alias("out_of_order"), F.count_distinct("file").alias("n_files"))


@query("select count(*) as sample_count, count(distinct source) as n_sources, cast(sum(n_chars) as bigint) as total_chars from documents")
def op_k05_manifest(spark, sf_dir):
    path = fresh_path(spark, "k05") + ".json"
    S.write_canonical(table(spark, sf_dir, "documents").agg(F.count("*").alias("sample_count"), F.count_distinct("source").alias("n_sources"), F.sum("n_chars").alias("total_chars")), path)
    return S.read_records(spark, path, "sample_count long, n_sources long, total_chars long")


@query("select '| ' || event_type || ' | ' || count(*) || ' | ' || printf('%.3f', count(*) filter (value > 50) / count(*)) || ' |' as line from events group by event_type")
def op_k09_report(spark, sf_dir):
    """The rows of a report in Markdown, rates with three decimals."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"))
    return rows.select(G.markdown_row("event_type", "n", decimals={"rate": 3}).alias("line"))


@query("select p_partkey, coalesce(case when p_size > 25 then p_size end, case when p_partkey % 3 = 0 then 10 end, case when p_brand is not null then 1 end) as n_samples from part")
def op_p14_options(spark, sf_dir):
    """An evaluation set's own option, else the default of its kind, else the general one."""
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size")), F.when(F.col("p_partkey") % 3 == 0, 10), F.when(F.col("p_brand").isNotNull(), 1)).alias("n_samples"))


@query("select 'runs/' || o_orderpriority || '/' || o_orderkey as path, cast(row_number() over (order by 'runs/' || o_orderpriority || '/' || o_orderkey) as bigint) as place from orders")
def op_o02_runsort(spark, sf_dir):
    return global_row_number(table(spark, sf_dir, "orders").select(F.concat_ws("/", F.lit("runs"), "o_orderpriority", "o_orderkey").alias("path")), ["path"], "place")


@query("select user_id, min(event_id) as first, cast(row_number() over (order by min(event_id)) as bigint) as place from events group by user_id")
def op_o04_groupsort(spark, sf_dir):
    return global_row_number(table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first")), ["first"], "place")


@query("""select conv_id, turn, case when role = 'assistant' and (conv_id + turn) % 4 <> 0 then 1 else 0 end as every, case when role = 'assistant' and (conv_id + turn) % 4 <> 0 and turn > coalesce(max(case when role = 'user' then turn end) over (partition by conv_id), -1) then 1 else 0 end as last from conversations""")
def op_a17_turnmask(spark, sf_dir):
    """Which messages are trained: every assistant step that is not opted out, or those after the last user message."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 0).alias("step"))
    every = M.turn_mask(rows, "conv_id", "turn", step_mask="step").withColumnRenamed("trained", "every")
    return M.turn_mask(every, "conv_id", "turn", step_mask="step", last_only=True).select("conv_id", "turn", "every", F.col("trained").alias("last"))


@query("""select r_regionkey, sha256(string_agg(p || chr(1) || c || chr(1), '' order by p)) as digest from (select n_regionkey as r_regionkey, n_name as p, '<dir>' as c from nation union all select n_regionkey, n_name || '/key', cast(n_nationkey as varchar) from nation) group by r_regionkey union all select -1, sha256('<missing>')""")
def op_x36_workspace(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    entries = nations.select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_name").alias("path"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("folder"))
    entries = entries.union(nations.select("n_regionkey", F.concat("n_name", F.lit("/key")), F.col("n_nationkey").cast("string"), F.lit(False)))
    entries = entries.union(spark.createDataFrame([(-1, None, None, None)], "r_regionkey int, path string, content string, folder boolean"))
    return X.workspace_digests(entries, "r_regionkey", "path", "content", "folder", "\x01")


@query("select event_type as name, count(*) as n, cast(sum(user_id) as bigint) as dur, cast(min(event_id) as bigint) as first, cast(sum(event_id) as bigint) as places from events group by event_type")
def op_s12_document(spark, sf_dir):
    """Profiler traces of one gzipped document a file, with other members before and after their events, pulled event by event."""
    e = table(spark, sf_dir, "events")
    path = fresh_path(spark, "s12d")
    lines = e.select((F.col("user_id") % 5).alias("trace"), F.col("event_id").alias("at"), F.to_json(F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("dur"), F.col("event_id").alias("id"), F.struct(F.lit("}]").alias("s"), F.array(F.struct(F.lit(1).alias("x"))).alias("l")).alias("args"))).alias("text"))
    # The members around the events stand in their first and last lines: rows of their own would come in by a union, whose parts Spark
    # takes to lie together by trace already, and so leaves the repartition out and a trace in three files.
    along = Window.partitionBy("trace").orderBy("at")
    head = F.when(F.row_number().over(along) == 1, '{"deviceProperties": [{"name": "}"}], "traceEvents": [').otherwise(",")
    tail = F.when(F.lead("at").over(along).isNull(), '], "displayTimeUnit": "ms"}').otherwise("")
    body = lines.select("trace", "at", F.concat(head, "text", tail).alias("text"))
    body.repartition("trace").sortWithinPartitions("trace", "at").select("trace", "text").write.partitionBy("trace").option("compression", "gzip").text(path)
    found = S.read_document_events(spark, path, "name string, dur long, id long", pattern="*.txt.gz").select("event.*")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("dur"), F.min("id").alias("first"), F.sum("id").alias("places"))


@query("select cast(epoch as bigint) as epoch, count(*) as n, count(*) as n_items, min(c_custkey) as lowest, max(c_custkey) as highest, true as moved, count(*) * 2 as n_samples from customer, (select unnest([1000, 1001]) as epoch) group by epoch")
def op_s13_cursor(spark, sf_dir):
    """Two whole epochs of the customers from the thousandth on, by two cursors that go on from a saved one: each a permutation of its own."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    n = rows.count()
    one, after = S.take_epochs(rows, "c_custkey", S.Cursor(epoch=1000), n // 2, seed=7, copies=2)
    path = fresh_path(spark, "cursor")
    after.save(spark, path)
    two, _ = S.take_epochs(rows, "c_custkey", S.Cursor.load(spark, path), 2 * n - n // 2, seed=7, copies=2)
    both = one.union(two)
    # A permutation hardly follows the keys: next to each other in it are keys far apart.
    near = F.abs(F.col("c_custkey") - F.lag("c_custkey").over(Window.partitionBy("epoch", "copy").orderBy("group"))) <= 1
    return both.withColumn("near", near).groupBy("epoch").agg((F.count("*") / 2).cast("long").alias("n"), F.count_distinct("c_custkey").alias("n_items"), F.min("c_custkey").alias("lowest"), F.max("c_custkey").alias("highest"), (F.count_if("near") < F.count("*") / 4).alias("moved"), F.count_distinct("sample").alias("n_samples"))
