"""Readers and writers of run records: JSON lines, Parquet, run trees, checksummed bundles."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import global_row_number

_SLICE = re.compile(r"@\[(-?\d*):(-?\d*)\]$")


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a .jsonl or .parquet path. Blank and malformed lines of JSON are skipped; another suffix raises."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json", ".jsonl.gz")):
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    raise ValueError(f"unknown suffix: {path}")


def read_slice(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """read_records() of path@[a:b]: the rows from a up to b in the order of an integer column; negative bounds raise."""
    found = _SLICE.search(path)
    if not found:
        return read_records(spark, path, schema)
    low, high = (int(x) if x else None for x in found.groups())
    if (low or 0) < 0 or (high or 0) < 0:
        raise ValueError(f"negative slice: {path}")
    rows = global_row_number(read_records(spark, path[: found.start()], schema), [order], "_rn")
    keep = F.col("_rn") > (low or 0)
    return rows.where(keep if high is None else keep & (F.col("_rn") <= high)).drop("_rn")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, of which none may be malformed: the first bad one (file and line number) raises when its rows are read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # Lines are numbered from counts of the blocks before theirs, so no file's lines meet in one task.
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    before = blocks.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("block")) - F.col("_n")).drop("_n")
    rows = lines.join(before, ["file", "block"]).withColumn("line", F.col("at") - F.col("_first") + F.col("_before") + 1).where(F.trim("value") != "")
    parsed = rows.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("value").isNotNull())
    fault = F.raise_error(F.concat(F.lit("malformed line "), F.col("line").cast("string"), F.lit(" of "), F.col("file")))
    return parsed.select(F.when(F.col("ok"), F.col("row")).otherwise(fault).alias("row")).select("row.*")


def write_canonical(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys and nulls kept; one line a row."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_in_order(rows: DataFrame, path: str, key: str, order: str) -> None:
    """Event logs, each key in one file and in order."""
    rows.repartition(key).sortWithinPartitions(key, order).write.json(path)


def discover_runs(spark: SparkSession, root: str, pattern: str = "trajectory.json") -> DataFrame:
    """(path, run, priority) of run records below root, files that the glob `pattern` names: directly in a run folder (0) or under runs/ (1); only the best layout stays."""
    ranked = list_files(spark, root, pattern).select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("run"), F.when(F.col("path").contains("/runs/"), 1).otherwise(0).alias("priority"))
    best = ranked.agg(F.min("priority").alias("best"))
    return ranked.crossJoin(F.broadcast(best)).where("priority = best").drop("best")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, size) of the files below root that the glob names; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"))


def discover_study(spark: SparkSession, root: str, pattern: str = "trajectory.json") -> DataFrame:
    """(experiment, run, path) of the runs of every experiment of a study, which lie in experiments/<experiment>/<run>."""
    part = lambda i: F.regexp_extract("path", "/experiments/([^/]+)/(?:runs/)?([^/]+)/[^/]+$", i)
    return list_files(spark, root, pattern).select(part(1).alias("experiment"), part(2).alias("run"), "path").where("experiment <> ''")


def terminal_runs(records: DataFrame, files: DataFrame) -> DataFrame:
    """(run, path) of campaign records (run, outcome, path) whose trajectory is recorded; a path that leaves the root, or that files (path) lack, raises when it is read."""
    ended = records.where(F.col("outcome") == "trajectory_recorded").select("run", "path")
    found = ended.join(files.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    escapes = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    fault = F.when(F.coalesce(F.trim("path"), F.lit("")) == "", "no path of ").when(escapes, "path leaves the root: ").when(F.col("_there").isNull(), "no such file: ")
    return found.select("run", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("run").cast("string"))).cast("string")).otherwise(F.col("path")).alias("path"))


def load_trajectories(spark: SparkSession, root: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """The JSON documents below root, one a file; runs without one are not there, a malformed one raises when it is read."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)


class EventPuller:
    """Pulls the objects of a top-level array out of one JSON document that comes in pieces; what it holds is one object and one piece.

    Other members are passed over. feed() gives the texts of the objects that a piece completes.
    """

    _TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|(?P<open>"(?:[^"\\]|\\.)*\\?\Z)', re.S)
    _PLAIN = re.compile(r"[^\s,\[\]{}\":]+(?=[\s,\]}])")
    _GAP = re.compile(r"[\s,:]*")

    def __init__(self, member: str):
        self.member, self.state, self.wanted = member, "document", False
        self.text, self.at, self.scan, self.depth = "", 0, 0, 0

    def _value_end(self) -> int | None:
        """Where the value at self.at ends; None if it goes on beyond the text."""
        if self.depth == 0 and self.scan == self.at and self.text[self.at] not in '"[{':
            found = self._PLAIN.match(self.text, self.at)
            return found.end() if found else None
        while found := self._TOKEN.search(self.text, self.scan):
            if found["open"] is not None:
                self.scan = found.start()
                return None
            self.scan = found.end()
            mark = found[0][0]
            self.depth += (mark in "[{") - (mark in "]}")
            if self.depth == 0:
                return self.scan
        self.scan = len(self.text)
        return None

    def feed(self, piece: str) -> Iterator[str]:
        if self.state == "passed":  # inside of a value that nobody wants, so what has been scanned can go
            self.text, self.at, self.scan = self.text[self.scan :] + piece, 0, 0
        else:
            self.text, self.scan, self.at = self.text[self.at :] + piece, self.scan - self.at, 0
        while self.state != "end":
            if self.state != "passed" and self.scan == self.at and self.depth == 0:
                self.at = self.scan = self._GAP.match(self.text, self.at).end()
                if self.at == len(self.text):
                    return
            mark = self.text[self.at] if self.at < len(self.text) else ""
            if self.state == "document":
                if mark != "{":
                    raise ValueError("the document is no object")
                self.at = self.scan = self.at + 1
                self.state = "name"
            elif self.state in ("name", "events") and self.depth == 0 and self.scan == self.at and mark in "]}":
                self.at = self.scan = self.at + 1
                self.state = "name" if self.state == "events" else "end"
            else:
                if self.state == "value" and self.wanted and mark == "[" and self.scan == self.at:
                    self.at = self.scan = self.at + 1
                    self.state = "events"
                    continue
                if self.state == "value":
                    self.state = "passed"
                end = self._value_end()
                if end is None:
                    return
                if self.state == "name":
                    self.wanted = json.loads(self.text[self.at : end]) == self.member
                    self.state = "value"
                elif self.state == "events":
                    if mark == "{":
                        yield self.text[self.at : end]
                else:
                    self.state = "name"
                self.at = self.scan = end
                self.depth = 0

    def close(self) -> None:
        if self.state != "end":
            raise ValueError("the document ends too early")


def read_document_events(spark: SparkSession, root: str, event_schema: str, member: str = "traceEvents", pattern: str = "*.json.gz") -> DataFrame:
    """(path, at, event) of profiler traces that are one gzipped JSON document a file, of any size.

    Spark's text reader cuts the stream of a file at every closing brace and a parser pulls one event after the other from these
    pieces, so a task holds some pieces and one event, never the document. A gzipped file is one task, as it cannot be
    split; a file that was split raises, and so does a broken document.
    """
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    taken = pieces.select("value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, puller, n = None, None, 0
        for batch in batches:
            texts, paths, at = [], [], []
            for value, path, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not whole:
                    raise ValueError(f"{path} was split")
                if path != now:
                    if puller:
                        puller.close()
                    now, puller, n = path, EventPuller(member), 0
                for text in puller.feed(value + "}") if puller.state != "end" else ():
                    texts.append(text)
                    paths.append(path)
                    at.append(n)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(texts, pa.string())], names=["path", "at", "text"])
        if puller:
            puller.close()

    events = taken.mapInArrow(run, "path string, at long, text string")
    return events.select("path", "at", F.from_json("text", event_schema, {"mode": "FAILFAST"}).alias("event"))


def read_trace(spark: SparkSession, path: str, event_schema: str) -> DataFrame:
    """The traceEvents of profiler traces, one JSON document a line, plain or gzipped. read_document_events() reads one document a file."""
    return spark.read.schema(f"traceEvents array<struct<{event_schema}>>").json(path).select(F.explode("traceEvents").alias("e")).select("e.*")


def buffered_first(buffer: DataFrame, dataset: DataFrame, order: str, n: int) -> DataFrame:
    """The next n rows: those of the buffer in their order, then the dataset's, with `place` from 1."""
    both = buffer.withColumn("_later", F.lit(0)).unionByName(dataset.withColumn("_later", F.lit(1)))
    return global_row_number(both, ["_later", order], "place").where(F.col("place") <= n).drop("_later")


#: Stores whose files tasks can read as streams; files of others are read whole by Spark, 2 GB at most.
STREAMED = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _store(path: str):
    """The file system of a path and the path within it; path is as Spark lists it, without escapes."""
    from pyarrow import fs

    scheme = path.partition(":")[0] if re.match(r"[a-z][a-z0-9]*:", path) else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/*", "/", path)
    store, root = fs.FileSystem.from_uri(re.match(r"[^:]+://[^/]*/", path)[0].replace("s3a://", "s3://", 1))
    return store, f"{root.rstrip('/')}/{path.split('/', 3)[3]}"


def _stream(path: str):
    """The bytes of a file as a stream."""
    store, at = _store(path)
    return store.open_input_stream(at, compression=None)


def write_tree(rows: DataFrame, root: str, folders: list[str]) -> None:
    """One file of JSON lines in a folder (name=value/...) for each value of `folders`, made anew.

    Tasks write the files as streams, in place; a task that is run again writes the same ones. Spark's own writer, which other stores than STREAMED
    get, moves each file and sets its rights by a process of its own where the native library of Hadoop is missing.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if root.partition("://")[0] not in STREAMED and "://" in root:
        rows.repartition(n, *folders).write.partitionBy(*folders).mode("append").json(root)
        return
    folder = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in folders))
    line = F.to_json(F.struct(*(c for c in rows.columns if c not in folders)))
    lines = rows.select(folder.alias("_folder"), line.alias("_line")).repartition(n, "_folder").sortWithinPartitions("_folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, files = None, None, 0
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if out:
                        out.close()
                    store, at = _store(f"{root.rstrip('/')}/{name}")
                    store.create_dir(at, recursive=True)
                    now, out, files = name, store.open_output_stream(f"{at}/part-00000.json", compression=None), files + 1
                out.write(text.encode() + b"\n")
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    lines.mapInArrow(run, "files long").agg(F.sum("files")).first()


def stream_digest(path: str, slice_bytes: int = 8 << 20) -> str:
    """SHA-256 of a file of any size, read slice_bytes at a time."""
    digest = hashlib.sha256()
    with _stream(path) as f:
        while part := f.read(slice_bytes):
            digest.update(part)
    return digest.hexdigest()


def artifacts(spark: SparkSession, root: str, slice_bytes: int = 8 << 20) -> DataFrame:
    """(path, size, modified, digest) of every file below root.

    The listing reads no contents; tasks hash the files in slices of slice_bytes, so a file may have any size and needs
    no more memory than a slice. Files of a store that only Spark can read are loaded whole. Spark's readers pass over
    files without bytes, so these are not there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if root.partition("://")[0] not in STREAMED and "://" in root:
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([stream_digest(path, slice_bytes)])], names=[*batch.schema.names, "digest"])

    return listed.mapInArrow(run, "path string, size long, modified timestamp, digest string")


def bundle_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, fault) of a bundle's files (name, size, digest): unsafe names, missing, unexpected or changed files."""
    f = found.select("name", F.col("size").alias("f_size"), F.col("digest").alias("f_digest"), F.lit(True).alias("is_found"))
    e = expected.select("name", "size", "digest", F.lit(True).alias("is_expected"))
    both = e.join(f, "name", "full")
    fault = F.when(F.col("name").contains("/") | F.col("name").isin("", ".", ".."), "unsafe_name").when(F.col("is_found").isNull(), "missing").when(F.col("is_expected").isNull(), "unexpected").when((F.col("size") != F.col("f_size")) | (F.col("digest") != F.col("f_digest")), "changed")
    return both.select("name", fault.alias("fault")).where("fault is not null")


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """rows with `place` (from 1) in the order of a hash of key, seed and epoch: the same for the same three, another permutation in each epoch."""
    return global_row_number(rows.withColumn("_mix", F.xxhash64(F.col(key), F.lit(seed + epoch))), ["_mix", key], "place").drop("_mix")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(places: np.ndarray, n: int, seed: int, epochs: np.ndarray, rounds: int = 6) -> np.ndarray:
    """The item (0 to n - 1) at each place of each epoch: one permutation for a seed and epoch, computed place by place.

    A Feistel network permutes the numbers of twice as many bits as half of n's need; what falls beyond n - 1 goes through it again until it does not.
    """
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    key = _mixed(np.uint64(seed & (1 << 64) - 1) + _mixed(epochs.astype(np.uint64)))
    out = places.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        x, k = out[left], key[left]
        a, b = x >> half, x & low
        for r in range(rounds):
            a, b = b, a ^ (_mixed(b + _mixed(k + np.uint64(r))) & low)
        out[left] = (a << half) | b
        left = left[out[left] >= n]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Cursor:
    """Where an endless pass over epochs stands: the epoch, the place in it, and the numbers of the next group and sample."""

    epoch: int = 0
    offset: int = 0
    group: int = 0
    sample: int = 0

    def after(self, count: int, n: int, copies: int) -> Cursor:
        at = self.epoch * n + self.offset + count
        return Cursor(at // n, at % n, self.group + count, self.sample + count * copies)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.epoch, self.offset, self.group, self.sample)], "epoch long, offset long, group long, sample long").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cursor:
        return Cursor(*spark.read.schema("epoch long, offset long, group long, sample long").json(path).first())


def take_epochs(prompts: DataFrame, key: str, cursor: Cursor, count: int, seed: int = 0, copies: int = 1) -> tuple[DataFrame, Cursor]:
    """The next `count` prompts from the cursor on, with epoch, group, copy and sample, and the cursor after them.

    The prompt at a place of an epoch is computed from the place alone, so only `count` places are made and joined to the prompts,
    which are numbered once by key; a slice far into a late epoch costs as much as the first. key tells the prompts apart.
    """
    n = prompts.count()
    if not n:
        raise ValueError("no prompts")
    first = cursor.epoch * n + cursor.offset
    names = ["epoch", "group", "_item"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at - first + cursor.group), pa.array(permuted(at % n, n, seed, at // n))], names=names)

    places = prompts.sparkSession.range(first, first + count).mapInArrow(place, "epoch long, group long, _item long")
    numbered = global_row_number(prompts, [key], "_rn").withColumn("_item", F.col("_rn") - 1).drop("_rn")
    taken = places.join(numbered, "_item").drop("_item").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return taken.withColumn("sample", F.lit(cursor.sample) + (F.col("group") - cursor.group) * copies + F.col("copy")), cursor.after(count, n, copies)


def epoch_slice(prompts: DataFrame, key: str, offset: int, count: int, seed: int = 0, copies: int = 1) -> DataFrame:
    """The next `count` prompts from `offset` on over endless epochs, each in its own shuffled order, n copies of each.

    Returns epoch, group (its place in the whole sequence), copy and the prompt's columns. The order within an
    epoch is a hash of key, seed and epoch: a permutation that is stable for a seed.
    """
    n = prompts.count()
    if not n:
        raise ValueError("no prompts")
    first, last = offset // n, (offset + count - 1) // n
    epochs = prompts.sparkSession.range(first, last + 1).select(F.col("id").alias("epoch"))
    mixed = prompts.crossJoin(F.broadcast(epochs)).withColumn("_mix", F.xxhash64(F.col(key), F.lit(seed) + F.col("epoch")))
    keyed = mixed.withColumn("_order", F.shiftrightunsigned("_mix", 24)).withColumn("_order", F.col("epoch") * F.lit(1 << 41) + F.col("_order"))
    placed = global_row_number(keyed, ["_order", "_mix", key], "_rn").withColumn("group", F.col("_rn") - 1 + F.lit(first * n))
    taken = placed.where((F.col("group") >= offset) & (F.col("group") < offset + count)).drop("_mix", "_order", "_rn")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
