"""The training-data operators against brute force, the libraries and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import ann, decontam, gbt, jaccard, lines, pages, piece_codec, quality, sharding, spans, token_counts
from tracemill.llm import queries as Q
from tracemill.llm.common import utf8_slices
from tracemill.llm.components import components
from tracemill.llm.wordhash import runs, words

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet. " * 4000
ODD = [(1, "A b c d e f g h. I j k l m n o p."), (1, "A b c d e f g h. I j k l m n o p."), (1, "q r s"), (2, None), (3, ""), (None, "a b c d e f g h. I j k l m n o p."), (4, " \t\n"), (5, LONG), (6, LONG), (7, "é 日本 　 x\x00y 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and other columns whose names operators use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("size", "before", "shard", "n_tokens", "content", "body", "_text", "line", "node", "log_weight", "n_lines", "removed", "label", "list", "hash", "slots", "_id", "_body", "_cut", "_cuts", "_key", "_key_id", "_key_null", "_key_body", "_bad_id", "_bad_body", "_pid", "_draw", "key", "row_before"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def clean(text):
    return text or ""


# ---- hashes of words


def test_word_hashes_are_those_of_words():
    texts = ["Ab cD\tab", "", None, "x", " y  z ", "ab cd\x0bé É"]
    for limit in (1, 1 << 18):
        got = []
        for a, b, raw, offsets in utf8_slices(pa.array(texts), limit):
            h, s, e, r = words(raw, offsets)
            got += [(a + int(i), raw[x:y].tobytes(), int(v)) for v, x, y, i in zip(h, s, e, r)]
        assert [(i, w) for i, w, _ in got] == [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", clean(t))]
        by = defaultdict(set)
        for _, w, v in got:
            by[bytes(c + 32 if 65 <= c <= 90 else c for c in w)].add(v)
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_runs_of_short_rows_are_whole():
    h = np.arange(1, 9, dtype=np.uint64)
    out, owner, at = runs(h, np.array([0, 0, 0, 1, 3, 3, 3, 3]), 4, 3)
    assert owner.tolist() == [0, 1, 3, 3] and at.tolist() == [0, 3, 4, 5] and len(set(out.tolist())) == 4


# ---- 1


def test_shards(spark, odd, none):
    got = sharding.byte_shards(odd, n_shards=3).collect()
    want = sorted((len(clean(t).encode()) + 1, zlib.crc32(clean(t).encode())) for _, t in ODD)
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.byte_shards(none).count() == 0
    docs = Q.op1_sharding(spark, SF).collect()
    sums = defaultdict(int)
    for r in docs:
        sums[r.shard] += r["size"]
    mean, most = sum(sums.values()) / 16, max(r["size"] for r in docs)
    assert set(sums) <= set(range(16)) and all(abs(v - mean) <= most for v in sums.values())
    order = [r.shard for r in sorted(docs, key=lambda r: r.doc_id)]
    assert order == sorted(order)


# ---- 2


def test_reparameterised_questions(spark):
    docs = spark.createDataFrame(
        [(1, "Bob sold 13 clips to her friends in June and then Bob sold 77 clips in July for 1,200.5 pounds, how many clips?"), (2, "Bob sold 13 clips to her friends in June and then Alice sold 13 clips in July for 3 miles, how many clips?"), (3, None), (4, "quite other words that have nothing to do with any of it at all"), (5, "once THE CAT SAT ON THE MAT TODAY now")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, "Natalia sold 48 clips to her friends in April and then Natalia sold 24 clips in May for 5 kg, how many clips?"), (8, "the cat sat on the mat today"), (9, None), (10, "")], "item_id long, text string").withColumn("hash", F.lit(1))
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 7): "reparameterised", (5, 8): "verbatim"}
    low = docs.withColumn("text", F.lower("text"))
    assert (5, 8) in {(r.doc_id, r.item_id) for r in decontam.contaminated(low, items).collect()}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [2, 3, 4]


def test_letter_case_and_line_breaks_hide_no_passage(spark):
    item = "the old clerk in Paris wrote that Doctor Brown had lost every key of the house, and that nobody would open it again"
    wrapped = item.replace(" Doctor", "\nDoctor").replace(" Paris", "\nParis")
    renamed = wrapped.replace("Paris", "London").replace("Doctor Brown", "Captain Green")
    conflict = item + ". " + item.replace("Paris", "Brown")
    texts = [item, item.upper(), item.title(), item.lower(), wrapped, renamed, conflict, "nothing of it: " + item[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.coverage) for r in decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {i: k for i, (k, _) in got.items()} == dict.fromkeys(range(7), "verbatim") | {5: "reparameterised"}
    assert all(got[i][1] == 1 for i in range(6))


def test_every_form_of_every_item_is_found(spark):
    """Copies of all items in other letter case, wrapped anew, renumbered and renamed are found inside other texts; the other texts are clean."""
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()
    rng = random.Random(4)
    asked = [(1000 + i, t) for i, t in enumerate([
        "A farmer named Peter has 12 cows and buys 30 more for 450 dollars each. How many cows does Peter own after he sells 7 of them?",
        "In the town of Salem a train leaves at 9 and drives 60 miles to Dover. At which hour does it reach Dover if it rests for 15 minutes on the way?",
        "each box holds 24 jars and a van can carry 18 boxes, so how many jars does Maria bring to the market with two vans?",
    ])]
    items = [(r.item_id, r.text) for r in benchmark] + asked
    names = {"Peter": "Zo", "Salem": "Quill", "Dover": "Harrow", "Maria": "Ines"}
    other = lambda t: re.sub(r"[A-Z][a-z]+", lambda m: names.get(m[0], m[0]), re.sub(r"\d+", lambda m: str(int(m[0]) * 7 + 1001), t))
    wrap = lambda t: "".join("\n" if c == " " and rng.random() < 0.3 else c for c in t)
    forms = {"lower": str.lower, "upper": lambda t: t.replace("ß", "SS") if "ß" in t else t.upper(), "title": str.title, "wrapped": wrap, "exchanged": other, "exchanged upper": lambda t: other(t).upper()}
    filler = "quite another sentence that stands around it, written for this test only"
    rows, want = [], {}
    for i, t in items:
        for form in forms.values():
            want[len(rows)] = i
            rows.append((len(rows), f"{filler} {form(t)} {filler}"))
    rows.append((len(rows), filler))
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(want.items())
    changed = {i for i, (d, t) in enumerate(rows[:-1]) if i % 6 > 3 and want[i] >= 1000}
    plain = {i for i, t in items if "ß" not in t}  # in capitals it is two other letters
    assert {r.doc_id for r in found if r.kind == "reparameterised" and r.item_id in plain} == changed


def test_one_conflicting_slot_leaves_what_is_as_written(spark):
    item = "Anna gave Paul a red box with " + " ".join(f"word{c}" for c in "abcdefghijklmnopq") + " and then Anna took it back"
    docs = spark.createDataFrame([(1, item.replace("then Anna", "then Carol"))], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "verbatim")] and 0.5 <= got[0].coverage < 1


def test_every_planted_passage_is_found(spark, odd, none):
    import duckdb

    found = {(r.doc_id, r.item_id) for r in Q.op2_decontamination(spark, "/root/testdata/sf0.01").collect()}
    texts = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    assert found == {(d, i) for d, t in texts for i, b in items if b in t}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contaminated(none, benchmark).count() == 0 and decontam.contaminated(odd, benchmark.where("false")).count() == 0
    assert decontam.drop_contaminated(odd, benchmark).count() == len(ODD)


# ---- 3 and 5


def fuzz(n):
    rng = random.Random(3)
    alphabet = "ab the  \n\t ▁é日😀<s></s>​\xa0\x00.'s1 23\x1f\x85\x01"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "\n", "▁", "x<|endoftext|> y", LONG[:3000]]


def test_counts_are_the_librarys():
    path = Q.tokenizer_file("byte_bpe_50k.json")
    texts = fuzz(4000)
    tok = token_counts._load(path)["tok"]
    assert token_counts.count_tokens(texts, path) == [len(x) for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_cache_is_joined_and_appended(spark, odd, none, tmp_path):
    path, cache = Q.tokenizer_file("byte_bpe_50k.json"), str(tmp_path / "cache")
    got = token_counts.token_counts(odd, path, cache).collect()
    tok = token_counts._load(path)["tok"]
    want = sorted((str(i), len(clean(t).encode()), len(tok.encode(clean(t), add_special_tokens=False))) for i, t in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({clean(t) for _, t in ODD})
    # What the cache says is used; only the new text is encoded.
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(9, "quite new")], "doc_id long, text string"))
    assert token_counts.token_counts(more, path, cache).count() == len(ODD) + 1
    assert spark.read.parquet(cache).count() == len({clean(t) for _, t in ODD}) + 1
    assert token_counts.token_counts(none, path).count() == 0


def test_a_repeated_cache_row_counts_once(spark, tmp_path):
    path, cache = Q.tokenizer_file("byte_bpe_50k.json"), str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string")
    first = sorted(tuple(r) for r in token_counts.token_counts(docs, path, cache).collect())
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert sorted(tuple(r) for r in token_counts.token_counts(docs, path, cache).collect()) == first


def test_a_text_on_which_the_library_differs_is_the_librarys(monkeypatch):
    c = piece_codec.codec(Q.tokenizer_file("piece_bpe_32k.model"))
    c.forget()
    plain = c.merge
    monkeypatch.setattr(c, "merge", lambda s: (5,) if s == "▁odd" else plain(s))
    texts = ["an odd text", "a plain text", "odd", ""]
    packed, decoded, own = c.round_trip(texts)
    want = c.lib.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == want and decoded == c.lib.decode(want) and own == [False, True, False, True]
    c.forget()


def test_models_of_another_kind_raise():
    with open(Q.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    piece_codec.check_model(raw)
    with pytest.raises(ValueError, match="merge type"):
        piece_codec.check_model(raw + bytes([18, 2, 24, 1]))  # settings of the trainer with type 1
    with pytest.raises(ValueError, match="normalises"):
        piece_codec.check_model(raw + bytes([26, 2, 32, 1]))  # the normaliser removes spaces


def test_agenda_equals_the_library():
    c = piece_codec.codec(Q.tokenizer_file("piece_bpe_32k.model"))
    texts = fuzz(4000)
    want = c.lib.encode(texts, add_bos=True, add_eos=True)
    got = [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)]
    assert got == want
    assert [c.decode(x) for x in want] == c.lib.decode(want) == c.round_trip(texts)[1]
    assert all(c.round_trip(texts)[2])


def test_forgotten_segments_are_learned_again(monkeypatch):
    monkeypatch.setattr(piece_codec, "_MEMO_LIMIT", 50)
    c = piece_codec.codec(Q.tokenizer_file("piece_bpe_32k.model"))
    c.forget()
    texts = fuzz(300)
    want = c.lib.encode(texts, add_bos=True, add_eos=True)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 7) for x in c.encode(texts[at : at + 7])]
        assert got == want
    c.forget()
    assert not c.memo and not c.older


def test_piece_round_trip(spark, odd, none):
    path = Q.tokenizer_file("piece_bpe_32k.model")
    lib = piece_codec.codec(path).lib
    got = piece_codec.piece_round_trip(odd, path).collect()

    def row(i, t):
        ids = lib.encode(clean(t), add_bos=True, add_eos=True)
        return (str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())

    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(row(i, t) for i, t in ODD)
    assert piece_codec.piece_round_trip(none, path).count() == 0


# ---- 4


def test_quality_keeps_clean_and_drops_bad(spark):
    rng = random.Random(5)
    good = ["river", "stone", "walk", "green", "house", "paper", "light", "small"]
    text = lambda bad: " ".join(rng.choice(good) + rng.choice(good) for _ in range(60)) + (" vile filth" if bad else "")
    rows = [(i, text(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 800, 1) if i % 3], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    assert len([i for i in kept if i % 4 == 0]) <= 4 and len([i for i in kept if i % 4]) >= 595
    assert {r.doc_id for r in quality.resample(docs, labels).collect()} == kept


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality.resample(odd, labels).count() == len(ODD)
    assert quality.resample(odd, labels.where("false")).count() == len(ODD)
    assert quality.resample(none, labels).count() == 0


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("doc_id % 2 = 0")
    kept = quality.resample(docs.select("doc_id", "text"), fit).select("doc_id").withColumn("kept", F.lit(True))
    rest = labels.where("doc_id % 2 = 1").join(kept, "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)).cast("int"))
    rate = {(r.quality, r.toxic): r.rate for r in rest.groupBy("quality", "toxic").agg(F.avg("kept").alias("rate")).collect()}
    assert rate[(1, 0)] > 0.97 and rate[(1, 1)] < 0.4 and rate[(0, 0)] < 0.12 and rate[(0, 1)] < 0.12


def test_the_sample_follows_the_weights(spark):
    """A row of weight 1/e is drawn as often as e rows of weight 1; the same rows come again for the same seed."""
    raw = np.frombuffer(b"rare", np.uint8)
    gram = quality._grams(raw, np.array([0, 4]))[1]
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("text "), "id")).otherwise(F.concat(F.lit("Rare text "), "id")).alias("text"))
    weighed = quality.weigh(docs, gram, np.array([-1.0]), carry=["doc_id"]).orderBy(F.desc("gumbel_key")).limit(800).collect()
    odd = sum(r.doc_id % 2 for r in weighed)
    assert all(r.log_weight == -(r.doc_id % 2) for r in weighed) and 0.8 < (800 - odd) / odd / np.e < 1.25
    other = quality.weigh(docs, gram, np.array([-1.0]), carry=["doc_id"], seed=1).orderBy(F.desc("gumbel_key")).limit(800).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in weighed}


def brute_grams(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text)
    tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x09-\x0D\x20]+", low)
    runs, at = set(), 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and tokens[end] == tokens[at]:
            end += 1
        if end - at >= 4:
            runs.add(("run", min(3, (end - at).bit_length() - 1)))
        at = end
    return {(t,) for t in tokens} | set(zip(tokens, tokens[1:], strict=False)) | runs


def test_weights_equal_brute_force(spark):
    import duckdb

    rows = duckdb.connect().execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    labels = duckdb.connect().execute("select doc_id, quality = 1 and toxic = 0 from '/root/testdata/sf0.01/labels.parquet'").fetchall()
    good, grams = dict(labels), {i: brute_grams(clean(t)) for i, t in rows}
    t, n, raw = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, own in grams.items():
        for g in own:
            raw[g] += 1
            if i in good:
                n[g] += 1
                t[g] += good[i]
    share = np.mean(list(good.values()))
    weight = {}
    for g in n:
        z = (t[g] - n[g] * share) / np.sqrt(n[g] * share * (1 - share) + 0.5)
        gate = z**4 / (z**4 + 6.0**4)
        a = np.log((t[g] + share) / (n[g] + 1) / share)
        b = np.log((t[g] + 1) / (raw[g] * sum(good.values()) / len(rows) + 1))
        least = min(a, b, key=abs) if a * b > 0 else 0
        shrink = lambda x, gate=gate: np.sign(x) * max(abs(x) - 1, 0) * gate
        if abs(shrink(a)) > 0.02:
            weight[g] = shrink(least)
    want = {i: sum(weight.get(g, 0) for g in own) for i, own in grams.items()}
    docs, table = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, table)
    got = {r.doc_id: r.log_weight for r in quality.weigh(docs.select("doc_id", "text"), *model[:2], carry=["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want) and min(want.values()) < -1
    # The query keeps the k rows with the largest keys.
    kept = Q.op4_quality(spark, "/root/testdata/sf0.01").collect()
    k = max(round(share * len(rows)), int(sum(min(1, np.exp(w)) for w in want.values())))
    keys = sorted((r.gumbel_key for r in quality.weigh(docs.select("doc_id", "text"), *model[:2], carry=["doc_id"]).collect()), reverse=True)
    assert sorted((r.gumbel_key for r in kept), reverse=True) == keys[:k]


# ---- 6


def brute_spans(rows, run=2, min_words=10, lone=30):
    cut = {i: [s.split() for s in re.split(r"(?<=[.!?])\s+|\n", clean(t)) if s.split()] for i, t in rows}
    seen, gone = {}, defaultdict(set)
    for i in sorted(cut):
        s = [tuple(w.lower() for w in x) for x in cut[i]]
        found = [((1, s[k]), k, 1) for k in range(len(s)) if len(s[k]) >= lone] + [((2, *s[k : k + run]), k, run) for k in range(len(s) - run + 1) if sum(map(len, s[k : k + run])) >= min_words]
        for key, k, n in sorted(found, key=lambda x: x[1]):
            if seen.setdefault(key, (i, k)) != (i, k):
                gone[i] |= set(range(k, k + n))
    return {i: len(g) for i, g in gone.items()}


def test_spans_equal_brute_force(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' where doc_id < 400").fetchall()
    ascii_rows = [(i, t) for i, t in rows if t.isascii()]
    docs = spark.createDataFrame(ascii_rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in spans.drop_repeated_spans(docs, changed_only=True).collect()}
    assert got == brute_spans(ascii_rows) and got


def test_first_span_stays(spark, odd, none):
    got = spans.drop_repeated_spans(odd).select("doc_id", "text", "n_removed", "first_doc_ids").collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.n_removed) for r in got}
    assert {(6, 4000), (5, 3999), (2, 0), (3, 0), (1, 2)} <= by  # a null doc_id comes first
    assert {r.text for r in got if r.doc_id == 2} == {None}
    assert spans.drop_repeated_spans(none).count() == 0
    two = spark.createDataFrame([(1, "Keep this. One two three four five six. Seven eight nine ten eleven."), (2, "Other.\nOne two three four five six.  Seven eight nine ten eleven. End of it.")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.removed, r.first_doc_ids) for r in spans.drop_repeated_spans(two).collect()}
    assert got[1][0].startswith("Keep this. One") and got[2][0] == "Other.\nEnd of it." and got[2][2] == [1] and len(got[2][1]) == 2


def brute_grown_spans(rows, min_words=10, lone=30):
    cut = {i: [s.split() for s in re.split(r"(?<=[.!?])\s+|\n", clean(t)) if s.split()] for i, t in rows}
    seen, gone = {}, defaultdict(set)
    for i in sorted(cut):
        s = [tuple(w.lower() for w in x) for x in cut[i]]
        found = {(k, k + 1) for k in range(len(s)) if len(s[k]) >= lone}
        for k in range(len(s)):
            found |= set([(k, e) for e in range(k + 2, len(s) + 1) if sum(map(len, s[k:e])) >= min_words][:1])
            found |= set([(b, k + 1) for b in range(k - 1, -1, -1) if sum(map(len, s[b : k + 1])) >= min_words][:1])
        for b, e in sorted(found):
            if seen.setdefault((e - b, *s[b:e]), (i, b)) != (i, b):
                gone[i] |= set(range(b, e))
    return {i: len(g) for i, g in gone.items()}


def brute_span_texts(rows, min_words=10, lone=30):
    """The texts that stay, of any script: words are cut at ASCII white space and compare with A-Z as a-z."""
    low = lambda w: "".join(c.lower() if c < "\x80" else c for c in w)
    cut, seen, gone = {}, {}, defaultdict(set)
    for i, t in rows:
        found, begin, own = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)], None, []
        cut[i] = []
        for k, (a, b, w) in enumerate(found):
            begin = a if begin is None else begin
            own.append(low(w))
            following = found[k + 1][0] if k + 1 < len(found) else len(t)
            if re.search(r"[.!?][\"')\]]?$", w) or "\n" in t[b:following] or k + 1 == len(found):
                cut[i].append((begin, tuple(own)))
                begin, own = None, []
    for i in sorted(cut):
        s = [w for _, w in cut[i]]
        found = {(k, k + 1) for k in range(len(s)) if len(s[k]) >= lone}
        for k in range(len(s)):
            found |= set([(k, e) for e in range(k + 2, len(s) + 1) if sum(map(len, s[k:e])) >= min_words][:1])
            found |= set([(b, k + 1) for b in range(k - 1, -1, -1) if sum(map(len, s[b : k + 1])) >= min_words][:1])
        for b, e in sorted(found):
            if seen.setdefault((e - b, *s[b:e]), (i, b)) != (i, b):
                gone[i] |= set(range(b, e))
    out = {}
    for i, t in rows:
        if gone[i]:
            starts = [a for a, _ in cut[i]] + [len(t)]
            out[i] = t[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(cut[i])) if k not in gone[i])
    return out


def test_texts_without_spans_equal_brute_force(spark):
    import duckdb

    rows = duckdb.connect().execute("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' where doc_id < 500 and text is not null").fetchall()
    rows += [(1000, "Ἄνδρα μοι ἔννεπε, Μοῦσα, πολύτροπον, ὃς μάλα πολλὰ πλάγχθη. Ἐπεὶ Τροίης ἱερὸν πτολίεθρον ἔπερσε!"), (1001, "«Oui» (là.) Ἄνδρα μοι ἔννεπε, Μοῦσα, πολύτροπον, ὃς μάλα πολλὰ πλάγχθη. Ἐπεὶ Τροίης ἱερὸν πτολίεθρον ἔπερσε! Fin\u3000 (là.) et")]
    got = spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), changed_only=True, grow=True).collect()
    want = brute_span_texts(rows)
    assert {r.doc_id: r.text for r in got} == want and 1001 in want and any(not t.isascii() for t in want.values())


def test_passages_of_short_sentences_go(spark, tmp_path):
    import duckdb

    verse = "\n".join(f"line{c} of the song" for c in "abcdefghijklmno")
    edges = "Yes.\nNo.\nthis one has quite a few more words than nine or ten of them\nSo.\nWell."
    rows = [(1, f"First of all\n{verse}\nend one"), (2, f"Then\n{verse}\nend two"), (3, f"A word\n{edges}\nto three"), (4, f"Word\n{edges}\nto four"), (5, "a b c\nd e f"), (6, "a b c\nd e f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in Q.op6_spans(spark, str(tmp_path)).collect()}
    assert got == {2: ("Then\nend two", 15), 4: ("Word\nto four", 5)}
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet' where doc_id < 400").fetchall()
    ascii_rows = [(i, t) for i, t in rows if t.isascii()]
    got = {r.doc_id: r.n_removed for r in spans.drop_repeated_spans(spark.createDataFrame(ascii_rows, "doc_id long, text string"), changed_only=True, grow=True).collect()}
    assert got == brute_grown_spans(ascii_rows) and got != brute_spans(ascii_rows)


# ---- 7


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(dict)
    for r in Q.op7_neighbours(spark, "/root/testdata/sf0.01").collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        best = set(ids[np.lexsort((ids, far))[:10]])
        mine = got[ids[i]]
        assert sorted(mine) == list(range(1, 11)) and [v[1] for _, v in sorted(mine.items())] == sorted(v[1] for v in mine.values())
        assert all(abs(far[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in mine.values())
        hits.append(len(best & {v for v, _ in mine.values()}) / 10)
    assert np.mean(hits) >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [5.0, 5.0]), (None, [1.0, 1.0]), (10, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(v, v.where("vec_id = 0"), k=10).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 0.0), (0, 2, 8, 0.0), (0, 3, 9, round(41**0.5, 6))]
    assert ann.nearest(v.where("false"), v).count() == 0 and ann.nearest(v, v.where("false")).count() == 0


# ---- 8


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), clean(t)))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common = defaultdict(int)
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                common[members[b], members[a]] += 1
    for (a, b), o in common.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(n, words_each, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words_each)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("rounds", "short"), [(0, 0), (1, 0), (1, 20), (1, 64), (2, 64)])
def test_components_equal_brute_force(spark, rounds, short, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK_SETS", 40)
    monkeypatch.setattr(jaccard, "_SHORT_LIST", short)
    rows = near_copies(260, 150, 1) + [(1000 + i, t) for i, t in near_copies(60, 40, 2)] + [(2000 + i, f"lone {i} text of a few words") for i in range(50)] + [(3000, "Lone 3 text of a few words"), (3001, "x"), (3002, "X"), (3003, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=rounds).collect()}
    assert got == brute_components(rows)


def test_shared_ngrams_of_a_block_without_lone_ones_count(spark, monkeypatch):
    """Two near copies fill one block and leave most fragments without a lone n-gram; their partner stands in another partition."""
    monkeypatch.setattr(jaccard, "_FRAGMENT", 1)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*base, "y"])), (2, " ".join([*base, "z"])), (3, " ".join([*base, "x"]))]
    parts = spark.createDataFrame(spark.sparkContext.parallelize([rows[:2], rows[2:]], 2).flatMap(lambda x: x), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(parts).collect()}
    assert got == brute_components(rows) and {c for _, c in got.values()} == {1}


def test_jaccard_on_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()), key=str)
    want = sorted(((i, len(shingles(t)), None if i is None else {6: 5}.get(i, i)) for i, t in ODD), key=str)
    assert got == want
    assert jaccard.jaccard_components(none).count() == 0
    kept = sorted((str(r.doc_id), clean(r.text)[:9]) for r in jaccard.keep_representatives(odd).collect())
    assert len(kept) == len(ODD) - 2 and ("6", LONG[:9]) not in kept and ("5", LONG[:9]) in kept
    whole = jaccard.keep_representatives(odd)
    assert whole.columns == odd.columns and {tuple(r)[2:] for r in whole.collect()} == {("x",) * (len(odd.columns) - 2)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    names = rng.sample(range(10**6), 300)
    links = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 300)] + [(5, 5), (None, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(names[:200]) for x in names[:200]} | {x: min(names[200:]) for x in names[200:]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_links_expect_no_endless_sizes(spark):
    """The size that Spark expects of the result: with more links than a broadcast takes, its digits doubled twice a round, so that a few calls filled the driver."""
    node = lambda i: F.xxhash64(i)
    links = spark.range(220_000).where("id % 20 < 19").select(node(F.col("id")).alias("a"), node(F.col("id") + 1).alias("b")).repartition(4)
    got = components(links)
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 120
    chains = spark.range(220_000).select(node(F.col("id")).alias("node"), F.floor(F.col("id") / 20).alias("chain"))
    found = got.join(chains, "node").groupBy("chain").agg(F.min("node").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    assert found.where("n = 20 and lo = least and hi = least").count() == 11_000 == found.count() and got.count() == 220_000


# ---- 9


def test_recurring_templates_go(spark):
    rows = [(i, f"own text number {i} is here\nUpdated on 2024-01-{i:02d} by staff\nread more stories about {w} in our big daily archive\n\nshared") for i, w in enumerate(["cats", "dogs", "cows", "hens", "bees", "bats", "rats", "owls", "elks", "yaks", "gnus"])]
    rows += [(50, "Unlike anything else\nunlike anything else"), (51, None), (52, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_recurring_lines(docs, min_docs=10).collect()}
    assert got[0][0] == rows[0][1] and got[0][2] == 0
    assert got[3] == ("", 4, 4)
    assert got[50] == (rows[11][1], 2, 0) and got[51] == (None, 0, 0) and got[52] == ("", 0, 0)


def test_an_unlike_line_undoes_no_template(spark):
    """A leaf holds several templates and lines that fit none."""
    pets, towns = ["cats", "dogs", "cows", "hens", "bees", "bats", "rats", "owls", "elks", "yaks", "gnus", "pigs"], ["Rome", "Oslo", "Bern", "Kiel", "Linz", "Graz", "Pisa", "Nice", "Lyon", "Metz", "Gent", "Cork"]
    rows = [(i, f"read more stories about {w} in our big daily archive") for i, w in enumerate(pets)]
    rows += [(100 + i, f"read more stories from people who have seen {w} once") for i, w in enumerate(towns)]
    rows += [(200, "read more stories while every other word differs from those"), (201, "read more stories about cats from some quite different paper")]
    for part in (rows[:12], rows[:12] + rows[-2:-1], rows):
        got = {r.doc_id: r.n_dropped for r in lines.drop_recurring_lines(spark.createDataFrame(part, "doc_id long, text string")).collect()}
        assert {i for i, n in got.items() if n} == {i for i, _ in part} - {0, 100, 200, 201}


def test_lines_on_odd_rows(odd, none):
    got = lines.drop_recurring_lines(odd, min_docs=2).collect()
    assert len(got) == len(ODD) and {r.text for r in got if r.doc_id == 2} == {None}
    assert [r.n_dropped for r in got if r.doc_id == 6] == [1] and [r.n_dropped for r in got if r.doc_id == 5] == [0]
    assert lines.drop_recurring_lines(none).count() == 0


def test_lines_have_no_python_in_their_plans(spark, monkeypatch):
    """The whole of the operator is native: no plan, those cut by checkpoints included, runs a Python worker."""
    plans = []
    plain = lines.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().toString())
        return plain(df)

    monkeypatch.setattr(lines, "checkpointed", seen)
    plans.append(Q.op9_lines(spark, SF)._jdf.queryExecution().toString())
    assert len(plans) > 4 and not [p for p in plans if re.search(r"Python|Arrow|Pandas|SerializeFromObject", p)]


def test_lines_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, text, n_lines, n_dropped from ({lines.ORACLE})").fetchall())
    got = sorted(tuple(r) for r in Q.op9_lines(spark, "/root/testdata/sf0.01").select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == want


# ---- 10


@pytest.fixture(scope="module")
def trees():
    return pages.fit()


def test_held_out_pages(trees):
    rng, scores = random.Random(99), []
    for _ in range(150):
        source, kept = pages._training_page(rng)
        want = [t for t in pages.Page(source).block_texts if t in kept]
        got = pages.extract([source], trees)[0].split("\n\n")
        scores.append(2 * len(set(want) & set(got)) / max(1, len(set(want)) + len(set(got))))
    assert np.mean(scores) > 0.95
    html = '<html><body><nav><a href="/">home</a></nav><div id="main"><h1>Title &amp; more</h1><p>This is real text, with\n a sentence. And <b>more</b> of it.<p>Second one, which is long enough to be read.</div><div class="comments"><p>nice post, thanks a lot. I liked it.</p></div><script>x("<p>no</p>")</script></body></html>'
    assert pages.extract([html], trees) == ["Title & more\n\nThis is real text, with a sentence. And more of it.\n\nSecond one, which is long enough to be read."]


def test_the_articles_of_the_table(spark):
    """Precision and recall of words over the whole table, against the <article> of each page without the blocks in it that are no article."""
    import html as entities

    import duckdb

    other = re.compile(r'<(nav|aside|footer|form|script|style)\b.*?</\1>|<(div|section|p|ul) (?:class|id)="[^"]*(?:ad|notice|comment|share|related|newsletter|subscribe|promo|sponsor)[^"]*".*?</\2>|<!--.*?-->', re.S)
    block = re.compile(r"</?(?:article|h[1-6]|p|ul|ol|li|div|section|table|tr|td|th|blockquote|pre|figure|figcaption|header)\b[^>]*>")
    shown = dict(duckdb.connect().execute("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall())
    got = {r.page_id: r.text for r in Q.op10_pages(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == shown.keys()
    hit = n_got = n_want = exact = 0
    for i, h in shown.items():
        inner = re.search(r"<article.*</article>", h or "", re.S)
        inner = other.sub("", inner[0]) if inner else ""
        want = [t for t in (" ".join(entities.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0][:3] == "<br" else "", x)).split()) for x in block.split(inner)) if t]
        a, b = got[i].split(), " ".join(want).split()
        left = defaultdict(int)
        for w in b:
            left[w] += 1
        for w in a:
            hit += left[w] > 0
            left[w] -= 1
        n_got, n_want, exact = n_got + len(a), n_want + len(b), exact + (got[i] == "\n\n".join(want))
    assert hit / n_got > 0.99 and hit / n_want > 0.99 and exact / len(got) > 0.9


#: Layouts that the generator does not make, with their main text by hand.
LAYOUTS = [
    ("<p>One paragraph that is the whole of this page and says all there is to say.</p>", ["One paragraph that is the whole of this page and says all there is to say."]),
    ("<body>Text straight in the body, which goes on for a while and ends here. It has two sentences.</body>", ["Text straight in the body, which goes on for a while and ends here. It has two sentences."]),
    ("Skip<html><body><article><h1>Heading of it</h1><p>The article begins after a stray word, and it is long enough to be one.</p></article></body></html>", ["Heading of it", "The article begins after a stray word, and it is long enough to be one."]),
    (
        '<html><body><table><tr><td><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Mail</a></td></tr><tr><td><h2>On the old bridge</h2><p>The bridge was built long ago by the people of the town, who paid for each stone of it.</p><p>It stands to this day, and carts go over it every morning.</p></td></tr></table><div class="footer">Copyright of the town</div></body></html>',
        ["On the old bridge", "The bridge was built long ago by the people of the town, who paid for each stone of it.", "It stands to this day, and carts go over it every morning."],
    ),
    (
        '<html><body><div id="wrap"><div class="topbar"><ul><li><a href="/x">Start</a></li><li><a href="/y">About</a></li></ul></div><div class="entry"><h1>Baking bread</h1><ol><li>Mix the flour with water and let it rest for an hour.</li><li>Bake it until the crust is brown and sounds hollow.</li></ol></div><div id="disqus_thread" class="comments"><p>Worked well for me, thanks!</p></div></div></body></html>',
        ["Baking bread", "Mix the flour with water and let it rest for an hour.", "Bake it until the crust is brown and sounds hollow."],
    ),
    (
        "<div>" * 600 + "<article><p>A page whose article lies six hundred elements deep, and is still read to its end.</p><p>And a second paragraph of it, below the first.</p></article>" + "</div>" * 600 + '<footer><a href="/z">Imprint</a></footer>',
        ["A page whose article lies six hundred elements deep, and is still read to its end.", "And a second paragraph of it, below the first."],
    ),
]


def test_layouts_that_are_not_generated(trees):
    hit = n_got = n_want = 0
    for source, want in LAYOUTS:
        got = [t for t in pages.extract([source], trees)[0].split("\n\n") if t]
        hit, n_got, n_want = hit + len(set(got) & set(want)), n_got + len(got), n_want + len(want)
    assert hit / n_got >= 0.9 and hit / n_want >= 0.9


def test_end_tags_of_deep_elements_close_their_own():
    page = pages.Page("<div>" * 300 + "<p>a</p>" + "</div>" * 299 + "<p>b</p></div><p>c</p>")
    depth = {t: page.depths[n] for n, t in zip(page.block_nodes, page.block_texts, strict=True)}
    assert depth == {"a": 301, "b": 2, "c": 1}


def test_decoding_never_keeps_a_child_of_a_dropped_node():
    page = pages.Page("<div><div><p>a</p></div></div><div><p>b</p></div>")
    kept = pages.decode(page, np.array([0, -5, 9, -1, 2, 1.0]))
    assert all(kept[page.parents[i]] for i in range(1, len(kept)) if kept[i]) and kept[1:4] == [True, True, False] and kept[4:] == [True, True]


def test_pages_on_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<"), (None, "u", "<div" * 3000), (3, "u", "<article>" + "<div>" * 500 + "<p>" + LONG + "</article>"), (4, "u", "<p>x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = pages.main_text(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 1] == ["", ""]
    assert pages.main_text(df.where("false")).count() == 0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = gbt.train(x[:1500], y[:1500], n_trees=30)
    assert ((trees.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.97


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is C.run
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = C.stored(stage(spark, docs, SF), "test")
        assert docs.columns == first, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty(), name
    kept = sorted((r.doc_id, r.text) for r in docs.collect())
    # After the third stage no two texts are near copies, and after the fourth none holds an item.
    groups = defaultdict(int)
    for i, (_, root) in brute_components(kept).items():
        groups[root] += 1
    assert max(groups.values()) == 1
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i, t in kept if any(b in clean(t) for b in items)]
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    lib = piece_codec.codec(Q.tokenizer_file("piece_bpe_32k.model")).lib
    assert sorted((r.doc_id, r.ids) for r in last) == [(i, lib.encode(clean(t), add_bos=True, add_eos=True)) for i, t in kept]
    assert sorted((r.doc_id, r.ids) for r in C.run(spark, SF).collect()) == sorted((r.doc_id, r.ids) for r in last)


def test_the_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline as C

    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "q r s"), (2, None), (3, "a passage of eight words or more that is nowhere")], "item_id long, text string")
    for name, docs, items in (("odd", odd, benchmark), ("none", none, benchmark), ("no items", odd, benchmark.where("false"))):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        items.write.parquet(f"{path}/benchmark.parquet")
        got = docs
        for _, stage in C.STAGES[:-1]:
            got = C.stored(stage(spark, got, path), "test")
            assert got.columns == docs.columns
            assert {tuple(r)[2:] for r in got.collect()} <= {("x",) * (len(docs.columns) - 2)}
        assert C.run(spark, path).count() == got.count()
        if name == "none":
            assert got.count() == 0


def test_stored_folders_are_deleted(spark):
    from tracemill.llm import common

    df = common.stored(spark.range(3), "test")
    path = common.written()[-1]
    assert df.count() == 3
    common.release(spark, [path])
    assert path not in common.written()
    with pytest.raises(Exception, match=r"(?i)exist|not found"):
        spark.read.parquet(path)


def test_other_columns_stay_as_they_are(odd):
    """Columns with names that the operators use themselves."""
    extra = len(odd.columns) - 2
    for out in (lines.drop_recurring_lines(odd), spans.drop_repeated_spans(odd), decontam.drop_contaminated(odd, odd.select(F.lit(1).alias("item_id"), F.lit("no such words in any of it").alias("text")).limit(1))):
        own = [c for c in odd.columns[2:] if c not in ("n_lines", "n_dropped", "removed")]
        assert {tuple(r) for r in out.select(*own).collect()} == {("x",) * len(own)} and len(own) >= extra - 2
