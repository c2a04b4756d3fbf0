"""Documents and files of any size, and passes over endless epochs."""

import gzip
import hashlib
import json
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.plans import QUERIES
from tracemill.sources import records as S


def pulled(document, size, member="traceEvents"):
    puller, out = S.EventPuller(member), []
    for at in range(0, len(document), size):
        if puller.state != "end":
            out += puller.feed(document[at : at + size])
    puller.close()
    return [json.loads(x) for x in out]


DOCUMENT = {
    "schema": 1, "name": "a \"quoted\" } ] string \\", "props": [{"x": [1, {"y": "}"}]}, []], "none": None, "nested": {"traceEvents": [{"not": "this"}]},
    "traceEvents": [{"name": "k[0]{}", "args": {"deep": [{"a": "]}"}], "e": {}}}, {}, {"dur": 1.5e-3, "ph": "X", "t": "\\"}, 7, "stray", None, [1], {"u": "ü☃😀 "}], "after": {"b": True}, "n": -12.5,
}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_events_are_pulled_from_any_pieces(size, indent):
    for ascii_only in (True, False):
        text = json.dumps(DOCUMENT, indent=indent, ensure_ascii=ascii_only)
        assert pulled(text, size) == [e for e in DOCUMENT["traceEvents"] if isinstance(e, dict)]
    assert pulled("{}", size) == [] and pulled(' {"traceEvents" : [ ] } \n', size) == [] and pulled('{"traceEvents": 3, "x": "y"}', size) == []


@pytest.mark.parametrize("text", ["[1]", '{"traceEvents": [{"a": 1}', '{"a": "open', "", "{"])
def test_broken_documents_raise(text):
    with pytest.raises(ValueError):
        pulled(text, 5)


def test_traces_of_one_document_a_file(spark, tmp_path):
    rng, want = random.Random(1), {}
    for i in range(4):
        events = [{"name": f"k{rng.randrange(5)}", "cat": "kernel", "dur": rng.random(), "args": {"s": "}" * rng.randrange(3)}} for _ in range(rng.randrange(2000))]
        want[f"{i}.json.gz"] = [(e["name"], e["dur"]) for e in events]
        (tmp_path / "t").mkdir(exist_ok=True)
        with gzip.open(tmp_path / "t" / f"{i}.json.gz", "wt") as f:
            json.dump({"deviceProperties": [{"name": "d"}], "traceEvents": events, "end": 1}, f, indent=i % 2 or None)
    rows = S.read_document_events(spark, str(tmp_path / "t"), "name string, dur double").collect()
    got = {name: [(r.event.name, r.event.dur) for r in sorted(rows, key=lambda r: r.at) if r.path.endswith(name)] for name in want}
    assert got == want
    (tmp_path / "t" / "x.json.gz").write_bytes(gzip.compress(b'{"traceEvents": ['))
    with pytest.raises(Exception, match="too early"):
        S.read_document_events(spark, str(tmp_path / "t"), "name string").collect()


def test_a_long_document_needs_little_memory():
    """Forty megabytes, a third of them in a member that nobody wants, pass through a parser that holds some kilobytes."""
    event = json.dumps({"name": "x" * 50, "args": {"y": [1, 2, 3]}})

    def pieces():
        yield '{"skipped": [' + "{}"
        for _ in range(150_000):
            yield ',{"z": "' + "s" * 80 + '"}'
        yield '], "traceEvents": ['
        for i in range(200_000):
            yield ("," if i else "") + event
        yield "]}"

    puller, n, longest = S.EventPuller("traceEvents"), 0, 0
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for piece in pieces():
        n += sum(1 for _ in puller.feed(piece))
        longest = max(longest, len(puller.text))
    puller.close()
    assert n == 200_000 and longest < 1000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000


def test_digests_of_files_in_slices(spark, tmp_path):
    root = tmp_path / "a b"
    (root / "deep").mkdir(parents=True)
    contents = {"x.bin": bytes(range(256)) * 5000, "empty": b"", "deep/é ü%20.txt": b"text\n", "deep/packed.gz": gzip.compress(b"abc" * 1000)}
    for name, content in contents.items():
        (root / name).write_bytes(content)
    got = {(r["size"], r.digest) for r in S.artifacts(spark, str(root), slice_bytes=1000).collect()}
    assert got == {(len(c), hashlib.sha256(c).hexdigest()) for c in contents.values() if c}
    sparse = tmp_path / "large"
    with sparse.open("wb") as f:
        f.truncate(300 << 20)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    zeros = hashlib.sha256()
    for _ in range(300):
        zeros.update(bytes(1 << 20))
    assert S.stream_digest(str(sparse)) == zeros.hexdigest()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_every_epoch_is_a_permutation(n):
    seen = set()
    for seed in (0, 7, -3):
        for epoch in (0, 1, 1000, 10**9):
            order = S.permuted(np.arange(n), n, seed, np.full(n, epoch))
            assert sorted(order.tolist()) == list(range(n))
            seen.add(tuple(order.tolist()))
    if n >= 16:
        assert len(seen) == 12 and all(sum(i == x for i, x in enumerate(o)) < n / 4 + 5 for o in seen)


def test_a_cursor_goes_on_over_epochs(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "id long, text string")
    whole, end = S.take_epochs(prompts, "id", S.Cursor(), 21, seed=3, copies=2)
    rows = sorted((r.group, r.copy, r.sample, r.epoch, r.id, r.text) for r in whole.collect())
    assert end == S.Cursor(3, 0, 21, 42) and [r[2] for r in rows] == list(range(42)) and all(r[5] == f"p{r[4]}" for r in rows)
    for epoch in range(3):
        assert sorted(r[4] for r in rows if r[3] == epoch and r[1] == 0) == list(range(7))
    parts, cursor = [], S.Cursor()
    for count in (5, 9, 7):
        part, after = S.take_epochs(prompts, "id", cursor, count, seed=3, copies=2)
        parts += [(r.group, r.copy, r.sample, r.epoch, r.id, r.text) for r in part.collect()]
        after.save(spark, str(tmp_path / "state"))
        cursor = S.Cursor.load(spark, str(tmp_path / "state"))
        assert cursor == after
    assert sorted(parts) == rows
    far, _ = S.take_epochs(prompts, "id", S.Cursor(epoch=1000, offset=3), 8, seed=3)
    assert sorted(r.epoch for r in far.collect()) == [1000] * 4 + [1001] * 4
    with pytest.raises(ValueError, match="no prompts"):
        S.take_epochs(prompts.where("false"), "id", S.Cursor(), 1)


def test_a_trace_document_lies_in_one_file_however_partitions_are_joined(spark):
    sf, joined = "/root/testdata/sf0.001", {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    before = {k: spark.conf.get(k) for k in joined}
    try:
        for k, v in joined.items():
            spark.conf.set(k, v)
        got = {r.name: (r.n, r.dur) for r in QUERIES["op_s12_document"](spark, sf).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    events = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("dur"))
    assert got == {r.event_type: (r.n, r.dur) for r in events.collect()}
