"""MinHash by tensored banding, token alignment and target resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import alignment, minhash, target_resampling
from tracemill.llm import queries as Q
from tracemill.llm.common import utf8_slices

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet. " * 4000
ODD = [(1, "A b c d e f g h. I j k l m n o p."), (1, "A b c d e f g h. I j k l m n o p."), (1, "q r s"), (2, None), (3, ""), (None, "a b c d e f g h. I j k l m n o p."), (4, " \t\n"), (5, LONG), (6, LONG), (7, "é 日本 　 x\x00y 😀"), (8, "a▁b <|endoftext|> <s> x")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("score", "rank", "weight", "n_words", "_key", "_row", "_out", "row_before", "row", "pairs", "times", "n_a", "node", "digest", "keys", "kept", "component_id", "body", "_text", "_id", "_body"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- 11


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def brute_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and None not in (sets[x][0], sets[y][0]) and 100 * len(a & b) >= percent * len(a | b):
                root[top(x)] = top(y)
    least = defaultdict(lambda: math.inf)
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[top(x)] = min(least[top(x)], i)
    return sorted(((i, len(s), None if i is None else least[top(x)]) for x, (i, s) in enumerate(sets)), key=repr)


def copies(n, seed):
    """Texts with n copies each whose similarity lies on either side of the threshold."""
    rng, rows = random.Random(seed), []
    for base in range(6):
        text = [f"w{rng.randrange(300)}" for _ in range(120)]
        for _ in range(n):
            own = list(text)
            for _ in range(rng.randrange(7)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_components_equal_brute_force(spark, rounds):
    rows = copies(12, 3)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), star_rounds=rounds, broadcast_rows=0 if rounds else 1000)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_long_lists_are_closed(spark):
    """More near copies than a short list holds, in chains: neighbours link, ends do not."""
    rng = random.Random(5)
    text, rows = [f"w{i}" for i in range(100)], []
    for i in range(150):
        text[rng.randrange(100)] = f"y{i}"
        rows.append((i, " ".join(text)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows)


def test_tables_combine_the_keys_of_both_collections():
    """Two sets meet in a table with the chance that the formula gives, and equal sets in all."""
    rng = np.random.default_rng(7)
    met, n = 0, 400
    for _ in range(n):
        both, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (40, 30, 30))
        one, two = (np.sort(np.concatenate([both, x])) for x in (a, b))
        keys = minhash.collection_keys(np.concatenate([one, two]), np.array([0, 70, 140]), 4, 2, 11)
        same = keys[0] == keys[1]
        met += bool(same[:4].any() and same[4:].any())
    s = 0.4
    assert abs(met / n - (1 - (1 - s**2) ** 4) ** 2) < 0.08
    again = minhash.collection_keys(np.concatenate([one, one]), np.array([0, 70, 70, 140]), 4, 2, 11)
    assert len(again) == 2 and (again[0] == again[1]).all() and len(set(again[0].tolist())) == 8


def test_minhash_on_odd_rows(spark, odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(ODD)
    assert {r.kept for r in got if r.doc_id is None} == {None}
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.select("doc_id").collect()) == [0, 1, 1, 1, 2, 3, 4, 5, 7, 8]
    assert minhash.drop_near_duplicates(odd, broadcast_rows=0).count() == 10


def test_minhash_equals_brute_force_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in Q.op11_minhash(spark, SF).collect()), key=repr) == brute_components(rows)


# ---- 12


def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))


def brute_alignment(rows):
    """By the byte offsets of whole texts encoded by the libraries."""
    a_lib, b_lib = libraries()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    found = []
    for i, t in rows:
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        byte_a = [bytes(letter[c] for c in a_lib.id_to_token(x)) for x in a]
        byte_b = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(byte_a) != b"".join(byte_b) or b"".join(byte_a) != (" " + t).encode():
            found.append((i, [], [], [], []))
            continue
        end_a, end_b = np.cumsum([len(x) for x in byte_a]).tolist(), np.cumsum([len(x) for x in byte_b]).tolist()
        at_a, at_b = {e: k for k, e in enumerate(end_a)}, {e: k for k, e in enumerate(end_b)}
        ends = [(at_a[e], at_b[e]) for e in end_a if e in at_b]
        links, groups, p, q = [(a[x], b[y]) for x, y in ends], [], 0, 0
        for x, y in ends:
            groups.append(",".join(map(str, a[p : x + 1])) + "|" + ",".join(map(str, b[q : y + 1])))
            p, q = x + 1, y + 1
        found.append((i, a, b, links, groups))
    count = Counter(x for f in found for x in f[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return sorted(((i, len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, x, g in found), key=repr)


def aligned(df, **more):
    got = alignment.align_tokens(df, Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model"), **more)
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got.collect()), key=repr)


def test_alignment_equals_brute_force_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in Q.op12_alignment(spark, SF).collect()), key=repr)
    assert got == brute_alignment(rows)


@pytest.mark.parametrize("broadcast_rows", [0, 4_000_000])
def test_alignment_of_odd_texts(spark, odd, none, broadcast_rows, monkeypatch):
    assert aligned(odd, broadcast_rows=broadcast_rows) == brute_alignment(ODD)
    assert aligned(none, broadcast_rows=broadcast_rows) == []
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "\x01", "\x1c", "\x85", "\xa0", "　", "'s", "don't", "Straße", "日本語", "한국", "ไทย", "🙂‍🙃", "123,4", "...", "<|endoftext|>", "<0x41>", "</s>", "é", "é", "aaaaaaaa", "﻿", "\x00", "x" * 60, "the", "of", "word.", "Wort!,", "ein?*b", "\nThe", "\r\nNot", "²x.", "ªb,", "µ.", "ǅ!", "a%b", ";a"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 40)))) for i in range(600)]
    assert aligned(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=broadcast_rows) == brute_alignment(rows)


def test_chunks_and_forgotten_pieces_change_nothing(monkeypatch):
    """A long text in many chunks, and a worker that forgets, come to what one piece comes to."""
    one = alignment.Aligner(Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model"))
    text = " " + "some words, in a Straße of 12 houses  and\nlines " * 300
    whole, sums = alignment._Sum(), alignment._Sum()
    one.learn([text])
    whole.add([one.memo[text]])
    monkeypatch.setattr(alignment, "_CHUNK", 100)
    monkeypatch.setattr(alignment, "_MEMO_LIMIT", 10)
    monkeypatch.setattr(alignment, "_TOGETHER", 3)
    n = 0
    for pieces in one.cut(text):
        assert "".join(pieces)
        one.recall(set(pieces))
        sums.add([one.memo[p] for p in pieces])
        n += 1
    assert n > 20 and (sums.n, sums.links, sums.digest.hexdigest()) == (whole.n, whole.links, whole.digest.hexdigest())


def test_transducer_by_hand():
    one = alignment.Aligner(Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model"))
    one.bytes_a, one.bytes_b = {0: b"ab", 1: b"c", 2: b"cd"}, [b"a", b"bc", b"d", b"abcd", b"ab", b"cd"]
    one._restart()
    assert one.align([0, 1], [0, 1]) == [(2, 2)]
    assert one.align([0, 2], [4, 5]) == [(1, 1), (2, 2)]
    assert one.align([0, 2], [3]) == [(2, 1)]
    assert one.align([0, 2], [0, 1, 2]) == [(2, 3)]
    assert one.align([0], [0]) is None and one.align([0], [5]) is None and one.align([], [0]) is None and one.align([], []) == []


def test_models_with_a_normaliser_raise():
    with pytest.raises(ValueError, match="no byte-level"):
        alignment.Aligner(Q.tokenizer_file("word_bpe_49k.json"), Q.tokenizer_file("piece_bpe_32k.model"))


def test_pair_counts_pass_on_what_does_not_repeat(spark):
    rows = [([7 * i + k for k in range(5)], [1, 2, 3, 1, 1]) for i in range(60)] + [([1, 2], [5, 5])]
    want = Counter()
    for p, t in rows:
        want.update(dict(zip(p, t, strict=True)))
    for flush in (10, 1000):
        got = {r.pair: (r["count"], r.best) for r in alignment.pair_counts(spark.createDataFrame(rows, "pairs array<long>, times array<int>"), 4, flush).collect()}
        top = {b: max(n for p, n in want.items() if p % 4 == b) for b in range(4)}
        assert got == {p: (n, n == top[p % 4]) for p, n in want.items()}


# ---- 13


def brute_resampling(rows, target, percent=10, buckets=10_000, least=20, widths=(1, 1), seed=2024):
    def found(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(widths[0], widths[1] + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(found(x)[1])
    for x in target:
        t.update(found(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        words, own = found(x)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    may = sorted((-r[3], r[0], k) for k, r in enumerate(out) if r[0] is not None and r[4] >= least)
    rank = {k: n for n, (_, _, k) in enumerate(may[: percent * len(may) // 100], 1)}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=repr)


def sampled(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_crc_of_ranges():
    rng = random.Random(2)
    raw = np.frombuffer(bytes(rng.randrange(256) for _ in range(5000)), np.uint8)
    starts = np.array([rng.randrange(4900) for _ in range(300)])
    ends = starts + np.array([rng.choice([0, 1, 2, 7, 47, 48, 49, 99]) for _ in range(300)])
    assert target_resampling.crc32_of(raw, starts, ends).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert len(target_resampling.crc32_of(raw, starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("widths", [(1, 1), (1, 3), (2, 2)])
def test_features_are_runs_of_words(widths):
    texts = ["Ab cD\tab-x_y", "", None, "x", " y  z ", "é日本 12a\x7fb", "a" * 100 + " b"]
    for limit in (1, 1 << 18):
        got = defaultdict(Counter)
        for at, _, raw, offsets in utf8_slices(pa.array(texts), limit):
            rows, places, _ = target_resampling.features(raw, offsets, 1000, *widths)
            for r, p in zip(rows.tolist(), places.tolist(), strict=True):
                got[at + r][p] += 1
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
            assert got[i] == Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 1000 for n in range(widths[0], widths[1] + 1) for k in range(len(w) - n + 1))


def test_target_resampling_equals_brute_force(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sampled(Q.op13_target(spark, SF)) == brute_resampling(docs, target)
    goal = spark.createDataFrame([(None, 1), ("a b lorem", 2), ("", 3)], "text string, score int")
    assert sampled(target_resampling.resample_to_target(odd, goal, percent=50, least_words=2, min_words=1, max_words=2)) == brute_resampling(ODD, [None, "a b lorem", ""], percent=50, least=2, widths=(1, 2))
    assert sampled(target_resampling.resample_to_target(odd, goal.where("false"), percent=100)) == brute_resampling(ODD, [], percent=100)
    assert sampled(target_resampling.resample_to_target(none, goal)) == []


def test_equal_scores_go_to_the_smaller_key(spark):
    """Repeated rows score alike and take one rank after the other."""
    rows = [(i % 5, f"word{i % 5} and more") for i in range(40)]
    got = target_resampling.resample_to_target(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("more",)], "text string"), percent=50, least_words=1)
    assert sampled(got) == brute_resampling(rows, ["more"], percent=50, least=1)


def test_sketches_count_keys_that_agree(spark):
    """The condition on two sketches against a count of equal bytes."""
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, (200, 13)).astype(np.uint64)
    two = np.where(rng.random((200, 13)) < 0.5, one, rng.integers(0, 1 << 63, (200, 13)).astype(np.uint64))
    a, b = minhash.sketches(one), minhash.sketches(two)
    equal = ((one & np.uint64(255)) == (two & np.uint64(255))).sum(1)
    rows = [(i, [*a[i].tolist(), 100], [*b[i].tolist(), 80 if i % 2 else 79]) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").where(minhash._agreeing(13, 7, 80)(F.col("a"), F.col("b"))).collect()
    assert {r.i for r in got} == {i for i in range(200) if equal[i] >= 7 and i % 2}
    assert minhash.least_shared(40, 0.512) == 6 and minhash.least_shared(40, 1.0) == 40


def test_a_list_of_several_ranges_of_sizes_is_closed(spark, monkeypatch):
    """More sets than a short list holds, but not in one range of sizes: pairs of one size still meet."""
    from tracemill.llm import jaccard

    monkeypatch.setattr(jaccard, "_SHORT_LIST", 6)
    rng, rows = random.Random(8), []
    for size in (40, 90, 200):
        base = [f"w{i}" for i in range(size)]
        for _ in range(5):
            own = list(base)
            for _ in range(max(1, size // 40)):
                own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    want = [(i, n, c) for i, n, c in brute_components(rows, 60)]
    for rounds in (0, 1):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=60, star_rounds=rounds, keys=30, hashes=2)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == want
