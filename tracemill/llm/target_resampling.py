"""Importance resampling of a corpus towards a target, by hashed word features in two passes.

First pass: every partition adds its words up to one vector of bucket counts, and a tree of tasks
merges the vectors, so the driver gets one vector for the corpus and one for the target, whatever
their size. Second pass: a bucket's gain is the logarithm of target to corpus share; each document
gathers the gains of its features, which are summed by document. Gumbel noise from a hash of the key
turns the sums into scores, and the highest scores are a sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty, utf8_slices
from .sharding import ordered_prefix

#: Bytes of words: digits, letters, and everything outside of ASCII.
_WORD = np.zeros(256, bool)
_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:256]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 48  # bytes of a feature that is hashed by zlib on its own


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of raw[start:end] for all ranges at once, a byte of each in every step; long ranges go to zlib."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    n_long = int(np.searchsorted(-size[order], -_LONG, side="left"))
    short = order[n_long:]
    at, left, crc = starts[short], size[short], out[short]
    live = len(short)
    for step in range(int(left[0]) if live else 0):
        live = int(np.searchsorted(-left[:live], -step, side="left"))
        part = crc[:live]
        crc[:live] = _CRC[(part ^ raw[at[:live] + step]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[short] = crc ^ np.uint32(0xFFFFFFFF)
    for i in order[:n_long]:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return out


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int, min_words: int, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a slice of texts, and the number of words of each row."""
    n_rows = len(offsets) - 1
    raw = _LOWER[raw]
    word = _WORD[raw]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(rows, minlength=n_rows)
    if max_words > 1 and len(starts):
        # The words again, with one space after each, so that a run of them is one range of bytes.
        size = ends - starts
        new = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        spaced = np.full(int(new[-1] + size[-1]), 32, np.uint8)
        spaced[np.repeat(new - starts, size) + np.flatnonzero(word)] = raw[word]
        raw, starts, ends = spaced, new, new + size
    owners, crcs = [], []
    for width in range(min_words, max_words + 1):
        m = len(starts) - width + 1
        if m <= 0:
            break
        first = np.flatnonzero(rows[:m] == rows[width - 1 :])
        owners.append(rows[first])
        crcs.append(crc32_of(raw, starts[first], ends[first + width - 1]))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), n_words
    return np.concatenate(owners), (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64), n_words


def bucket_counts(texts: DataFrame, buckets: int = 10_000, min_words: int = 1, max_words: int = 1, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. Nulls count as empty texts; an empty table gives zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offsets in utf8_slices(batch.column(0)):
                held += np.bincount(features(raw, offsets, buckets, min_words, max_words)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select(text_or_empty(text).alias("_text")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r.counts, np.int64)).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of its smoothed target share to its smoothed corpus share, rounded down."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))))


def weigh(docs: DataFrame, gain: np.ndarray, min_words: int = 1, max_words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features and weight (the sum of the gains of its features) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sums, found, held = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, raw, offsets in utf8_slices(batch.column(1)):
                rows, places, n_words = features(raw, offsets, len(own), min_words, max_words)
                sums[a:b] = np.bincount(rows, own[places], minlength=b - a)
                found[a:b], held[a:b] = np.bincount(rows, minlength=b - a), n_words
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(found), pa.array(sums)], names=[key, "n_words", "n_features", "weight"])

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("_text")).mapInArrow(score, f"`{key}` long, n_words long, n_features long, weight long")


def resample_to_target(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, min_words: int = 1, max_words: int = 1, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_features, weight, score and rank of every row of docs; rank is null for rows that are not drawn.

    Features are the runs of min_words to max_words words (runs of a-z, digits and anything outside of
    ASCII, A-Z in lower case). score is weight plus Gumbel noise, in thousandths, from a SHA-256 of seed and
    key. Of the rows with least_words words or more, percent in a hundred are drawn: the highest scores,
    ties to the smaller key, ranked from 1.

    Null and empty texts have no features and weight 0; a null key has no noise, so its score is null and it is never
    drawn; repeated rows score alike and are ranked one after the other; an empty table gives no rows, an
    empty target zeros for its counts; other columns of both tables are ignored. The weighed rows,
    without their texts, are fixed in the shared folder and ranked by ranges of their order.
    """
    gain = gains(bucket_counts(docs, buckets, min_words, max_words, text), bucket_counts(target, buckets, min_words, max_words, text))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")
    weighed = weigh(docs, gain, min_words, max_words, key, text).withColumnRenamed(key, "_key").withColumn("score", F.col("weight") + noise)
    may = F.col("_key").isNotNull() & (F.col("n_words") >= least_words)
    # _row keeps rows that are alike in everything else from meeting in one range.
    fixed = checkpointed(weighed.withColumns({"_out": F.when(may, 0).otherwise(1).cast("long"), "_may": may.cast("long"), "_high": -F.col("score"), "_row": F.monotonically_increasing_id()}))
    placed, n, _ = ordered_prefix(fixed, ["_out", "_high", "_key", "_row"], "_may")
    rank = F.when((F.col("_out") == 0) & (F.col("row_before") < percent * n // 100), F.col("row_before") + 1)
    return placed.select(F.col("_key").alias(key), "n_features", "weight", "score", rank.alias("rank"))


#: resample_to_target() over documents with benchmark as target, in DuckDB; the CRC comes from its polynomial.
ORACLE = r"""
with steps as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::ubigint, [0::ubigint,0,0,0,0,0,0,0]), lambda c, z: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end)) as t),
cut as (select 0 as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents union all select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
term as (select side, id, unnest(w) as word from cut),
hexed as (select word, hex(encode(word)) as h from (select distinct word from term)),
octets as (select word, list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as ubigint)) as b from hexed),
placed as (select word, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, x: xor(t[cast(xor(c, x) & 255 as int) + 1], c >> 8)), 4294967295::ubigint) % 10000 as bucket from octets, steps),
counted as (select b.bucket, coalesce(s, 0)::double as s, coalesce(t, 0)::double as t from (select unnest(range(10000))::ubigint as bucket) b left join (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from term join placed using (word) group by bucket) c using (bucket)),
gain as (select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) as gain from counted),
weighed as (select doc_id, len(w) as n, cast(coalesce(weight, 0) as bigint) as weight, cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as ubigint)::double as h from (select id as doc_id, w from cut where side = 0) left join (select id as doc_id, sum(gain) as weight from term join placed using (word) join gain using (bucket) where side = 0 group by id) using (doc_id)),
scored as (select doc_id, n, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from weighed),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place, 10 * count(*) over () // 100 as k from scored where n >= 20)
select doc_id, cast(n as bigint) as n_features, weight, score, cast(case when place <= k then place end as bigint) as rank from scored left join ranked using (doc_id)
"""
