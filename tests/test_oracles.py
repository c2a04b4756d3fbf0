"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
import zlib

import duckdb
import pytest

from tracemill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, float):
        return repr(x)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    rows = duck.execute(ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in rows.fetchall())
    assert got == want


def test_queries_without_sql_are_these():
    """Compression, the hash order of epochs and tokens of a tokenizer have no SQL; tests hold them against plain Python."""
    assert set(QUERIES) - set(ORACLES) == {"op_x21_repeat", "op_s13_epochs", "op_a17_alone", "op_a17_prefix", "op_a17_offsets", "op_a17_response", "op_g21_samples"}


def test_compression_ratios(spark):
    texts = dict(duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: (r.ratio, r.repeated) for r in QUERIES["op_x21_repeat"](spark, SF).collect()}
    for i, t in texts.items():
        tail = (t or "")[-10_000:].encode()
        ratio = len(tail) / len(zlib.compress(tail, 9)) if tail else 0.0
        assert got[i] == (ratio, len(t or "") > 10_000 and ratio > 10)
    assert got.keys() == texts.keys()


def test_epochs_pass_over_all_prompts(spark):
    rows = QUERIES["op_s13_epochs"](spark, SF).collect()
    items = {i for (i,) in duckdb.connect().execute(f"select item_id from '{SF}/benchmark.parquet'").fetchall()}
    assert len(rows) == 200 and {(r.group, r.copy) for r in rows} == {(g, c) for g in range(30, 130) for c in range(2)}
    n = len(items)
    by_group = {r.group: r.item_id for r in rows}
    for epoch in range(30 // n + 1, 130 // n):
        assert {by_group[g] for g in range(epoch * n, (epoch + 1) * n)} == items
    assert all(r.epoch == r.group // n for r in rows)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    total = duckdb.connect().execute(f"select sum(length('<assistant>' || chr(10) || text || chr(10) || '</assistant>' || chr(10))) from '{SF}/conversations.parquet' where role = 'assistant' and text <> ''").fetchall()[0][0]
    assert rows.agg({"trainable_chars": "sum"}).first()[0] == total


def test_rollout_metrics(spark):
    got = {r.lang: r for r in QUERIES["op_g21_samples"](spark, SF).collect()}
    rows = duckdb.connect().execute(f"select lang, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    assert got.keys() == {lang for lang, _ in rows}
    for lang, r in got.items():
        texts = [t for other, t in rows if other == lang]
        sizes = sorted(map(len, texts))
        tails = [t[-10_000:].encode() for t in texts]
        loops = [len(t) > 10_000 and len(b) / len(zlib.compress(b, 9)) > 10 for t, b in zip(texts, tails, strict=True)]
        middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
        assert (r.n, r.max, r.min, r.median) == (len(texts), sizes[-1], sizes[0], middle)
        assert abs(r["mean"] - sum(sizes) / len(sizes)) < 1e-9 and abs(r.repetition_frac - sum(loops) / len(texts)) < 1e-9 and abs(r.truncated_ratio - sum(s >= 8000 for s in sizes) / len(texts)) < 1e-9
