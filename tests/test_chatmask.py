"""Token masks of chat messages against plain loops over whole conversations, and micro-batch schedules."""

import random
import time
from collections import defaultdict

import duckdb
import pytest

from tracemill.operators import chatmask as C
from tracemill.operators import tokens as T
from tracemill.plans import QUERIES

SF = "/root/testdata/sf0.001"
SYSTEM = "You are to help."


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def conversations():
    found = defaultdict(list)
    for c, t, r, x in duckdb.connect().execute(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' order by 1, 2").fetchall():
        found[c].append((t, r, x))
    return found


def block(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def whole(messages):
    first = "" if messages[0][0] == "system" else block("system", SYSTEM)
    return first + "".join(block(r, t) for r, t in messages)


def joined(spark, name):
    found = defaultdict(lambda: ([], []))
    for r in sorted(QUERIES[name](spark, SF).collect(), key=lambda r: (r.conv_id, r.turn)):
        found[r.conv_id][0].extend(r.token_ids)
        found[r.conv_id][1].extend(r.loss_mask)
    return found


def test_offsets_equal_a_loop_over_whole_texts(spark, tokenizer, conversations):
    got = joined(spark, "op_a17_offsets")
    for c, rows in conversations.items():
        text = whole([(r, t) for _, r, t in rows])
        on, at = [0] * len(text), 0
        for turn, role, said in rows:
            if role != "assistant":
                continue
            start = text.index("<|im_start|>assistant\n", at) + len("<|im_start|>assistant\n")
            at = start + len(said) + len("<|im_end|>\n")
            if (c + turn) % 4:
                on[start:at] = [1] * (at - start)
        tokens = tokenizer.encode(text, add_special_tokens=False)
        assert got[c] == (tokens.ids, [int(any(on[a:b])) for a, b in tokens.offsets])


@pytest.mark.parametrize("name", ["op_a17_alone", "op_a17_prefix"])
def test_messages_apart_equal_a_loop(spark, tokenizer, conversations, name):
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    header = len(ids(whole([("user", "q")]) + "<|im_start|>assistant\n")) - len(ids(whole([("user", "q")])))
    got = joined(spark, name)
    for c, rows in conversations.items():
        tokens, mask = [], []
        for i, (turn, role, said) in enumerate(rows):
            if name.endswith("alone"):
                own = ids(whole([(role, said)]))[len(ids(block("system", SYSTEM))) if i and role != "system" else 0 :]
            elif i:
                own = ids(whole([("user", "q"), (role, said)]))[len(ids(whole([("user", "q")]))) :]
            else:
                own = ids(whole([(role, said), ("user", "q")]))[: -len(ids(block("user", "q")))]
            tokens += own
            trained = role == "assistant" and (c + turn) % 4
            mask += [0] * header + [1] * (len(own) - header) if trained else [0] * len(own)
        assert got[c] == (tokens, mask)
        assert tokens == ids(whole([(r, t) for _, r, t in rows]))


def test_responses_equal_a_loop(spark, tokenizer, conversations):
    got = {r.conv_id: (r.token_ids, r.loss_mask) for r in QUERIES["op_a17_response"](spark, SF).collect()}
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for c, rows in conversations.items():
        prompt, answer = ids(block(rows[0][1], rows[0][2]) + "<|im_start|>assistant\n"), ids(rows[-1][2])
        assert got[c] == (prompt + answer, [0] * len(prompt) + [int((c + rows[-1][0]) % 4 != 0)] * len(answer))


def test_masks_of_odd_messages(spark, path):
    rows = [(1, 0, "assistant", "<think>\nwhy"), (1, 1, "assistant", None), (1, 2, None, ""), (2, 0, "system", "s"), (2, 1, "assistant", "é日本\n\n  x <|im_end|> y")]
    df = spark.createDataFrame(rows, "conv int, at int, role string, text string")
    texts = {}
    for method in C.METHODS:
        found = {(r.conv, r.at): r for r in C.message_masks(df, "conv", "at", path, method, C.Template(system="s")).collect()}
        assert all(len(r.token_ids) == len(r.loss_mask) for r in found.values()) and len(found) == 5
        texts[method] = {k: r.token_ids for k, r in found.items()}
        assert sum(found[1, 2].loss_mask) == 0 and sum(found[2, 0].loss_mask) == 0 and sum(found[2, 1].loss_mask) > 5
    assert texts["alone"] == texts["prefix"] == texts["offsets"]
    thought = {(r.conv, r.at): sum(r.loss_mask) for m in ("offsets", "alone") for r in C.message_masks(df, "conv", "at", path, m).collect() for _ in [0] if m == "offsets"}
    plain = {(r.conv, r.at): sum(r.loss_mask) for r in C.message_masks(df, "conv", "at", path, "alone").collect()}
    assert 0 < thought[1, 0] < plain[1, 0]
    assert C.message_masks(df.where("false"), "conv", "at", path, "prefix").count() == 0
    with pytest.raises(ValueError, match="other"):
        C.Masker(path, C.Template(), "other")


def test_first_fit_by_its_definition():
    rng = random.Random(1)
    for _ in range(200):
        limit = rng.randint(1, 50)
        lengths = [rng.randint(0, 60) for _ in range(rng.randint(0, 40))]
        bins = []
        for x in lengths:
            place = next((i for i, b in enumerate(bins) if b + x <= limit), None)
            if place is None:
                bins.append(x)
            else:
                bins[place] += x
        assert T._first_fit(lengths, limit) == len(bins)


def test_first_fit_of_many_lengths_takes_seconds():
    rng = random.Random(2)
    lengths = [rng.randint(1, 8000) for _ in range(100_000)]
    began = time.process_time()
    assert T._first_fit(lengths, 8192) > 40_000
    assert time.process_time() - began < 10


def test_a_rank_with_fewer_rows_than_micro_batches_raises(spark):
    rows = spark.createDataFrame([(0, 0, i, 10) for i in range(4)] + [(0, 1, 9, 1)], "step int, rank int, id int, n long")
    assert {r.n_micro for r in T.microbatch_schedule(rows.where("rank = 0"), "step", "rank", "id", "n", 10).collect()} == {4}
    assert {r.n_micro for r in T.microbatch_schedule(rows.where("rank = 0"), "step", "rank", "id", "n", 10, multiple=3).collect()} == {3}
    with pytest.raises(Exception, match="rows for 4 bins"):
        T.microbatch_schedule(rows, "step", "rank", "id", "n", 10).collect()


def test_masks_come_in_small_batches():
    import pyarrow as pa

    from tracemill.operators.chatmask import _small

    parts = list(_small(iter([pa.RecordBatch.from_arrays([pa.array(range(250))], names=["x"])])))
    assert [p.num_rows for p in parts] == [100, 100, 50] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(250))
