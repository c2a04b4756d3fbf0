"""Scripts without spaces, documents of very many lines, hot contents, and folders of one run."""

import random
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import common, decontam, lines, spans, token_counts
from tracemill.llm import queries as Q
from tracemill.llm.common import utf8_slices
from tracemill.llm.wordhash import unspaced, words

CHINESE = "春天的早晨，小镇的居民们聚集在河边的旧桥旁。他们已经等待了两年，希望这座桥能够重新开放！工程师们说，所有的石头都会保留下来。冬天到来之前，道路就会再次通车，商人们也会把货物送到对岸的市场去。你觉得这座桥还能用多少年？"
JAPANESE = "春の朝、町の人々は川のそばの古い橋に集まりました。二年のあいだ待っていた人たちは、橋がまた開くことを願っています。石はすべて残されると技師は言いました。冬が来る前に、道はまた通れるようになります。"
THAI = "ในตอนเช้าของฤดูใบไม้ผลิ ชาวเมืองมารวมตัวกันที่ริมแม่น้ำใกล้สะพานเก่า พวกเขารอมาสองปีแล้วและหวังว่าสะพานจะเปิดอีกครั้ง วิศวกรบอกว่าจะเก็บหินทั้งหมดไว้ ก่อนฤดูหนาวถนนจะกลับมาใช้ได้"
PASSAGES = {"zh": CHINESE, "ja": JAPANESE, "th": THAI}


def test_characters_of_unspaced_scripts_are_words():
    import pyarrow as pa

    texts = ["ab 日本語x。ไทย", "", None, "𠀀b日", "한국 é", "日"]
    got = []
    for limit in (1, 1 << 18):
        got = []
        for at, _, raw, offsets in utf8_slices(pa.array(texts), limit):
            _, s, e, r = words(raw, offsets, scripts=unspaced(raw))
            got += [(at + int(i), raw[x:y].tobytes().decode()) for x, y, i in zip(s, e, r, strict=True)]
        assert got == [(0, w) for w in ["ab", "日", "本", "語", "x", "。", "ไ", "ท", "ย"]] + [(3, "𠀀"), (3, "b"), (3, "日"), (4, "한국"), (4, "é"), (5, "日")]
    assert unspaced(np.frombuffer("plain é".encode(), np.uint8)) is None


@pytest.mark.parametrize("script", PASSAGES)
def test_copies_in_unspaced_scripts_lose_their_spans(spark, script):
    passage = PASSAGES[script]
    rows = [(1, passage), (2, "Some other text stands here first.\n" + passage + "\nAnd after it."), (3, "nothing of it"), (4, passage)]
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), grow=True).collect()}
    assert got[1][1] == 0 and got[3][1] == 0 and got[4][0] == "" and got[2][0] == "Some other text stands here first.\nAnd after it."


@pytest.mark.parametrize("script", PASSAGES)
def test_items_in_unspaced_scripts_are_found(spark, script):
    item = PASSAGES[script]
    rows = [(1, item), (2, "before it " + item + " after it"), (3, item[5:] + item[:5]), (4, item[::-1]), (5, CHINESE[:4])]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "an item in another script which has ten words or so"), (3, "今天天气")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "verbatim", (3, 1): "verbatim"}


def test_a_short_item_of_few_characters_is_a_whole_text_only(spark):
    docs = spark.createDataFrame([(1, "我说今天天气很好吗"), (2, "今天天气很好"), (3, "so the cat sat on it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "今天天气很好"), (2, "the cat sat on it also")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(2, 1)}


def test_new_numbers_in_an_unspaced_script_are_found(spark):
    item = "小明买了12个苹果，又买了30个梨，一共花了84元，请问他平均每个水果花了多少元？"
    docs = spark.createDataFrame([(1, item.replace("12", "15").replace("30", "77").replace("84", "99"))], "doc_id long, text string")
    assert [r.kind for r in decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == ["reparameterised"]


def test_documents_of_very_many_lines(spark):
    """Dropping forty thousand lines of each of some documents takes about as long as counting them."""
    rng = random.Random(4)
    body = [f"line {w} of the recurring list of names" for w in ("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(40_000))]
    rows = [(i, "\n".join([f"own {'abcdefghijk'[i]}", *body, f"end {'abcdefghijk'[i]}"])) for i in range(11)]
    got = lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    began = time.time()
    counts = {r.doc_id: r.n_dropped for r in got.select("doc_id", "n_dropped").collect()}
    counted = time.time() - began
    assert counts == {i: 0 if not i else 40_000 for i in range(11)}
    began = time.time()
    sizes = {r.doc_id: r.n for r in got.select("doc_id", F.length("text").alias("n")).collect()}
    assert time.time() - began < 3 * counted + 10
    assert all(sizes[i] == (len(rows[0][1]) if not i else len("own a\nend a")) for i in sizes)


def test_first_last_and_neighbouring_lines_go(spark):
    same, word = "the same line in all", "abcdefghijkl"
    rows = [(i, f"{same}\nkept {word[i]} a\n{same}\n\n{same}\n{same}\nlast {word[i]} b" + (f"\n{same}" if i % 2 else "")) for i in range(12)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (rows[0][1], 0)} | {i: (f"kept {word[i]} a\n\nlast {word[i]} b", 4 + i % 2) for i in range(1, 12)}


def test_counts_leave_no_folder_and_split_a_hot_content(spark):
    docs = spark.createDataFrame([(i, None if i % 3 else "some words here") for i in range(30)], "doc_id long, text string")
    root = Path(common.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in root.iterdir() if p.name.startswith("token-cache")}
    found = token_counts.token_counts(docs, Q.tokenizer_file("byte_bpe_50k.json"))
    assert {p.name for p in root.iterdir() if p.name.startswith("token-cache")} == before
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == [(i, 0 if i % 3 else 3) for i in range(30)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_a_run_deletes_its_own_folders_only(spark, tmp_path):
    """What another thread stores while a pipeline runs, and a table that is still read, stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30)
    for name, df in {"documents": docs, "labels": spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "benchmark": spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stop, others = threading.Event(), []

    def store():
        while not stop.is_set() and len(others) < 200:
            others.append(common.stored(spark.range(3), "other"))
            time.sleep(0.2)

    thread = threading.Thread(target=store)
    thread.start()
    before = set(common.written())
    try:
        rows = corpus_pipeline.run(spark, str(tmp_path)).count()
    finally:
        stop.set()
        thread.join()
    assert rows > 0 and len(others) > 3 and all(df.count() == 3 for df in others)
    left = [p for p in common.written() if p not in before and "/other-" not in p]
    assert len(left) == 1  # the last stage's input, which its lazy result reads
