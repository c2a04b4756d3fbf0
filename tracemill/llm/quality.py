"""Quality filter by importance resampling over hashed n-grams.

A text is its tokens (runs of letters and digits, runs of other signs), their pairs, and runs of one
repeated token; each n-gram is known by a 64-bit hash and counts once a document. Two generative
models, one of target text (labelled good and not toxic) and one of raw text (every document), give
each document the logarithm of its importance weight, and the sample is the Gumbel top-k of those
weights, which is sampling without replacement in proportion to them.

The log ratio of an n-gram is shrunk in two smooth steps, as copies make the words of one text
evidence that is counted many times over: by a soft threshold (ratios that a language, a length or a
source alone brings about go to 0), and by z**4 / (z**4 + c**4) for an n-gram whose labelled
documents lie z standard errors from the mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, text_or_empty, utf8_slices
from .sharding import ordered_prefix
from .wordhash import _BASE, mix, words

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[np.r_[48:58, 65:91, 97:123, 128:256]] = True
#: Ranges of hashes in which the n-grams of the labelled documents are counted apart.
_FRAGMENTS = 64
#: An n-gram whose shrunk ratio is smaller than this in size is left out of the model.
_LEAST = 0.02


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram: tokens, pairs of neighbours, and runs of 4 and more equal tokens by the power of two of their length (8 at most)."""
    h1, s1, _, r1 = words(raw, offsets, ~_LETTERS)
    h2, s2, _, r2 = words(raw, offsets, _LETTERS | _SPACES)
    order = np.argsort(np.concatenate([s1, s2]), kind="stable")
    h, rows = np.concatenate([h1, h2])[order], np.concatenate([r1, r2])[order]
    if not len(h):
        return rows, h
    beside = rows[1:] == rows[:-1]
    pairs = mix(h[:-1][beside] * _BASE + h[1:][beside])
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(h)))
    long = length >= 4
    runs = mix(np.uint64(0x72756E) + np.minimum(np.log2(length[long]), 3).astype(np.uint64))
    return np.concatenate([rows, rows[1:][beside], rows[first[long]]]), np.concatenate([h, pairs, runs])


def _once(rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], grams[new]


def _shrunk(ratio: np.ndarray, gate: np.ndarray, floor: float) -> np.ndarray:
    return np.sign(ratio) * np.maximum(np.abs(ratio) - floor, 0) * gate


class _Known:
    """The model's n-grams in order, with a filter of 2**20 bits before the search."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = np.zeros(1 << 20, bool)
        self.bits[grams >> np.uint64(44)] = True

    def find(self, rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the model) of the n-grams that are in the model, each pair once."""
        near = self.bits[grams >> np.uint64(44)]
        rows, grams = rows[near], grams[near]
        if not len(self.grams) or not len(grams):
            return rows[:0], np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        same = self.grams[place] == grams
        pairs = np.unique(rows[same].astype(np.int64) * len(self.grams) + place[same])
        return pairs // len(self.grams), pairs % len(self.grams)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, smoothing: float = 1.0, floor: float = 1.0, half_z: float = 6.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-gram hashes in order, their shrunk log ratios, share of target rows among all labelled rows).

    The raw model counts all documents. Of the labels all are counted for the share; at most
    max_labelled of them, the first in the order of a hash of their key, give the target model, so
    the n-grams that are searched for are bounded whatever the input. An n-gram's ratio is the nearer to 0
    of target to raw and of target to labelled, 0 if their signs differ: copies that happen to carry
    no label would else look unlike the target. Without labels of both kinds the model is empty.
    """
    spark = docs.sparkSession
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
        .groupBy("doc_id").agg(F.min("good").alias("good"))
    )
    n_all, share_all = known.agg(F.count("*"), F.avg(F.col("good").cast("int"))).first()
    empty = np.empty(0, np.uint64), np.empty(0), 1.0
    if not n_all or share_all in (0.0, 1.0):
        return empty[0], empty[1], 1.0
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # 9 bytes a row
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("good", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = np.zeros(2, np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False)
            n_docs += [good.sum(), len(good)]
            for a, b, raw, offsets in utf8_slices(batch.column("_text")):
                rows, grams = _once(*_grams(raw, offsets))
                order = np.argsort(grams, kind="stable")
                grams, own = grams[order], good[a:b][rows[order]]
                firsts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
                n = np.diff(np.append(firsts, len(grams)))
                t = np.diff(np.append(0, np.cumsum(own, dtype=np.int64))[np.append(firsts, len(grams))])
                grams = grams[firsts]
                cuts = np.searchsorted(grams, np.arange(1, _FRAGMENTS, dtype=np.uint64) << np.uint64(58))
                parts = [(f, g.astype("<u8").tobytes(), x.astype("<u4").tobytes(), y.astype("<u4").tobytes()) for f, (g, x, y) in enumerate(zip(*(np.split(v, cuts) for v in (grams, t, n)), strict=True)) if len(g)]
                if parts:
                    cols = list(zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:]), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64())], names=["fragment", "grams", "t", "n", "n_target", "n_labelled"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), *(pa.array([int(x)], pa.int64()) for x in n_docs)], names=["fragment", "grams", "t", "n", "n_target", "n_labelled"])

    counted = stored(labelled.mapInArrow(cut, "fragment int, grams binary, t binary, n binary, n_target long, n_labelled long"), "quality-grams")
    n_target, n_labelled = counted.where("fragment = -1").agg(F.sum("n_target"), F.sum("n_labelled")).first()
    if not n_target or n_target == n_labelled:
        return empty[0], empty[1], share_all
    share = n_target / n_labelled

    def select(table: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("grams", "<u8"), ("t", "<u4"), ("n", "<u4"))]
        grams, place = np.unique(parts[0], return_inverse=True)
        t, n = (np.bincount(place, p, minlength=len(grams)) for p in parts[1:])
        z = (t - n * share) / np.sqrt(n * share * (1 - share) + 0.5)
        gate = z**4 / (z**4 + half_z**4)
        ratio = np.log((t + smoothing * share) / (n + smoothing) / share)
        sure = np.abs(_shrunk(ratio, gate, floor)) > _LEAST
        return pa.table({"gram": pa.array(grams[sure].view(np.int64)), "t": pa.array(t[sure]), "ratio": pa.array(ratio[sure]), "gate": pa.array(gate[sure])})

    found = counted.where("fragment >= 0").groupBy("fragment").applyInArrow(select, "gram long, t double, ratio double, gate double").toArrow()
    grams = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    grams, t, by_label, gate = grams[order], *(found[c].to_numpy()[order] for c in ("t", "ratio", "gate"))
    shared = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Known(shared.value)
        counts, n_docs = np.zeros(len(index.grams), np.int64), 0
        for batch in batches:
            n_docs += batch.num_rows
            for _, _, raw, offsets in utf8_slices(batch.column("_text")):
                counts += np.bincount(index.find(*_grams(raw, offsets))[1], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(counts[seen], n_docs))], names=["place", "raw"])

    rows = texts.select("_text").mapInArrow(count, "place long, raw long").groupBy("place").agg(F.sum("raw").alias("raw")).toArrow()
    place, number = rows["place"].to_numpy(), rows["raw"].to_numpy()
    raw_counts = np.zeros(len(grams))
    raw_counts[place[place >= 0]] = number[place >= 0]
    expected = raw_counts * n_target / number[place < 0].sum()
    by_raw = np.log((t + smoothing) / (expected + smoothing))
    ratio = np.where(np.sign(by_raw) == np.sign(by_label), np.where(np.abs(by_raw) < np.abs(by_label), by_raw, by_label), 0.0)
    weights = _shrunk(ratio, gate, floor)
    held = weights != 0
    return grams[held], weights[held], share_all


def weigh(docs: DataFrame, grams: np.ndarray, weights: np.ndarray, carry: list[str] | None = None, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """The columns of `carry` (all of docs by default) with log_weight and gumbel_key: log_weight plus Gumbel noise times temperature, drawn from a hash of doc_id, text and seed."""
    docs = docs.drop("log_weight", "gumbel_key")
    names = carry or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((grams, weights))
    body, draw = free_name(docs, "_text"), free_name(docs, "_draw")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ratios = _Known(shared.value[0]), shared.value[1]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, raw, offsets in utf8_slices(batch.column(body)):
                rows, place = index.find(*_grams(raw, offsets))
                out[a:b] = np.bincount(rows, ratios[place], minlength=b - a)
            key = out - temperature * np.log(-np.log(batch.column(draw).to_numpy()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out), pa.array(key)], names=[*names, "log_weight", "gumbel_key"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text"), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    taken = docs.select(*names, text_or_empty().alias(body), uniform.alias(draw))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return taken.mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", log_weight double, gumbel_key double")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, carry: list[str] | None = None, max_labelled: int = 20_000, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """The Gumbel top-k rows of docs (doc_id, text), with log_weight and gumbel_key; `carry` names the columns to give, all by default.

    Without a given k, k is the larger of two numbers: the rows that are target rows if all rows have
    the labels' share of them, and the rows that rejection sampling by the same weights would accept
    (the sum of min(1, weight)), so that a model with little evidence does not sample ordinary rows away.
    The weighed rows are stored once; the k-th key is found over all rows by range partitions and
    their counts, so no text moves between executors.

    Null and empty texts have no n-grams and weight 1; repeated rows weigh and draw the same, and
    rows that tie with the last one in key and doc_id all stay; without labels of both kinds every
    row has weight 1 and stays; an empty table gives no rows. doc_id may be null. Columns named
    log_weight or gumbel_key in docs are replaced.
    """
    docs = docs.drop("log_weight", "gumbel_key")
    grams, weights, share = fit(docs, labels, max_labelled=max_labelled)
    carry = carry or docs.columns
    kept = carry if "doc_id" in carry else [*carry, "doc_id"]
    weighed = stored(weigh(docs, grams, weights, carry=kept, temperature=temperature, seed=seed), "weighed")
    n, accepted = weighed.agg(F.count("*"), F.sum(F.least(F.lit(1.0), F.exp("log_weight")))).first()
    if k is None:
        k = n if not len(grams) else max(round(share * n), int(accepted))
    out = [*carry, "log_weight", "gumbel_key"]
    if k >= n:
        return weighed.select(*out)
    if k <= 0:
        return weighed.select(*out).limit(0)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ordered, _, _ = ordered_prefix(weighed.select((-F.col("gumbel_key")).alias("key"), own.alias("own"), F.lit(1).cast("long").alias("one")), ["key", "own"], "one")
    last = ordered.where(F.col("row_before") == k - 1).first()
    key = -F.col("gumbel_key")
    return weighed.where((key < F.lit(last["key"])) | ((key == F.lit(last["key"])) & (own <= F.lit(last["own"])))).select(*out)
