"""Near-duplicate removal by MinHash with tensored banding.

Two small collections of keys are made for every set, each key from a few minhashes. The keys of the
tables are all combinations of one key from either collection, so `keys` squared tables take only
2 * keys * hashes minhashes in place of keys * keys * 2 * hashes. Two sets meet in a table exactly if
they share a key in both collections.

1. Documents with equal sets form one class; from here on a class counts once.
2. A class that shares no key with another one in either collection meets nobody and leaves before
   any table key is formed; those that stay combine only keys which they share.
3. Tables whose members are the same count once.
4. A byte of each key makes a sketch. Two sets of the similarity that is asked for agree in many keys of both
   collections, not in one of each only; pairs whose sketches agree in fewer are not compared.
5. Candidates are verified on their full sets: each set first meets the leader of its largest table, then
   those of its other tables as far as they are still apart, and what is apart after that meets the rest of its
   table, by the steps of the Jaccard join.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, text_or_empty, utf8_slices
from .jaccard import _digest, _segments, _sets, link_lists
from .wordhash import _BASE, mix


def _multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that follow from seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def collection_keys(grams: np.ndarray, bounds: np.ndarray, keys: int, hashes: int, seed: int) -> np.ndarray:
    """2 * keys numbers for each non-empty set: the first `keys` are those of one collection, the others of the other.

    grams are 64-bit hashes of elements and bounds where each set's begin. A minhash is the least
    product of the set's hashes with an odd number, modulo 2**64; a key is a hash of its place and `hashes` minhashes.
    """
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), 2 * keys), np.uint64)
    factors = _multipliers(2 * keys * hashes, seed)
    for place in range(2 * keys):
        total = np.full(len(starts), np.uint64(place + 1))
        for factor in factors[place * hashes : (place + 1) * hashes]:
            total = (total + np.minimum.reduceat(grams * factor, starts)) * _BASE
        out[:, place] = mix(total)
    return out


def signatures(docs: DataFrame, width: int, keys: int, hashes: int, seed: int) -> DataFrame:
    """(doc_id, body, n_shingles, digest, keys, sketch) of every row; digest, keys and sketch are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, raw, offsets in utf8_slices(batch.column("_text")):
                grams, bounds = _sets(raw, offsets, width)
                sizes = np.diff(bounds)
                digests = [_digest(grams[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                own_keys = collection_keys(grams, bounds, keys, hashes, seed) if len(grams) else np.empty((0, 2 * keys), np.uint64)
                found, drawn = iter(own_keys.view(np.int64)), iter(sketches(own_keys))
                own = [batch.column(c).slice(at, end - at) for c in ("doc_id", "body")]
                lists = pa.array([next(found) if n else None for n in sizes], pa.list_(pa.int64()))
                short = pa.array([next(drawn) if n else None for n in sizes], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, short], names=["doc_id", "body", "n_shingles", "digest", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, body long, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def sketches(keys: np.ndarray) -> np.ndarray:
    """The low byte of each of a set's keys, eight of them in a number; zeros fill the last one up."""
    low = (keys & np.uint64(255)).astype(np.uint8)
    wide = np.zeros((len(low), -(-low.shape[1] // 8) * 8), np.uint8)
    wide[:, : low.shape[1]] = low
    return wide.view("<i8")


def least_shared(n: int, share: float, chance: float = 1e-6) -> int:
    """The most keys that two sets may be asked to share, of n which each agree with a chance of `share`, so that they fall short with a chance of `chance` at most."""
    total, c = 0.0, 0
    while (total := total + comb(n, c) * share**c * (1 - share) ** (n - c)) <= chance:
        c += 1
    return c


def _agreeing(n_keys: int, least: int, percent: int):
    """A condition on two sketches: that `least` of their n_keys bytes or more are equal, and that their sizes allow a link."""
    words = -(-n_keys // 8)

    def alike(a: Column, b: Column) -> Column:
        apart = F.lit(0)
        for i in range(words):
            x = a[i].bitwiseXOR(b[i])
            # The low bit of each byte becomes 1 if any bit of the byte is.
            for shift in (4, 2, 1):
                x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            apart += F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        # Behind the keys stands the size of the set.
        size_a, size_b = a[words], b[words]
        return (apart <= n_keys - least) & (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent)

    return alike


def tables(classes: DataFrame, keys: int) -> DataFrame:
    """(node, gram, n): the table keys of the classes (node, keys) that meet another class in some table, with the table's members; tables with the same members come once."""
    single = classes.select("node", F.posexplode("keys").alias("place", "key"))
    # Stored, so that the join deals out both sides anew and can split a key that many classes have.
    shared = checkpointed(single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    sides = single.join(shared, "key").groupBy("node").agg(*(F.collect_list(F.when(F.col("place") < keys if one else F.col("place") >= keys, F.col("key"))).alias(name) for name, one in (("ones", True), ("twos", False))))
    combined = checkpointed(sides.select("node", F.explode("ones").alias("one"), "twos").select("node", "one", F.explode("twos").alias("two")).select("node", F.xxhash64("one", "two").alias("gram")))
    members = combined.groupBy("gram").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("xor")).where("n > 1")
    once = checkpointed(members.groupBy("n", "least", "sum", "xor").agg(F.min("gram").alias("gram")).select("gram", "n"))
    return checkpointed(combined.join(once, "gram").select("node", "gram", "n"))


def _components(docs: DataFrame, width: int, percent: int, keys: int, hashes: int, seed: int, broadcast_rows: int, star_rounds: int) -> DataFrame:
    """near_duplicates() with body, a hash of the text."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), text_or_empty().alias("_text"))
    rows = checkpointed(signatures(body, width, keys, hashes, seed))
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    # Ids are taken from the table as it lies on disk, so they do not change.
    classes = checkpointed(classes).withColumn("node", F.monotonically_increasing_id())
    postings = tables(classes, keys)
    may = checkpointed(postings.select("node").distinct().join(classes.select("node", "doc_id", "n", "digest", "sketch"), "node"))
    segments = checkpointed(_segments(body, may.select("doc_id", "node", "digest"), width, broadcast_rows))
    # A near copy stands in hundreds of tables with as many leaders; it meets that of its largest table before the others.
    listed = checkpointed(postings.join(may.select("node", F.concat("sketch", F.array("n")).alias("sketch")), "node"))
    largest = checkpointed(listed.groupBy("node").agg(F.max_by(F.struct("gram", "sketch"), F.struct("n", "gram")).alias("x")).select("node", "x.*"))
    alike = _agreeing(2 * keys, least_shared(2 * keys, (percent / 100) ** hashes), percent)
    labels = link_lists(listed.select("node", "gram", "sketch"), segments, may.select("node", "n"), percent, star_rounds, first=largest, alike=alike, blocks_first=True)
    copied = classes.where("copies > 1").select("digest", F.col("doc_id").alias("component_id"))
    if labels is None:
        named = copied
    else:
        least = labels.join(classes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
        linked = labels.join(least, "label").join(classes.select("node", "digest"), "node").select("digest", "component_id")
        named = copied.join(linked.select("digest"), "digest", "left_anti").union(linked)
    # Stored, so that a set that many rows have can be split; rows without a set join nothing and go no way.
    named = checkpointed(named)
    full, empty = rows.where("digest is not null"), rows.where("digest is null")
    joined = full.join(named, "digest", "left").select("doc_id", "body", "n_shingles", "component_id").union(empty.select("doc_id", "body", "n_shingles", F.lit(None).cast("long")))
    return joined.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, keys: int = 20, hashes: int = 3, seed: int = 11, broadcast_rows: int = 100_000, star_rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a set holds the distinct
    runs of `width` words, or the whole sequence if there are fewer. Candidates of the tables link when
    100 * intersection >= percent * union of their full sets; component_id is the smallest doc_id
    that links reach, its own included, and kept tells whether it is the row's own.

    A pair of similarity s meets in no table with a chance of about 2 * (1 - s**hashes)**keys: 1.2e-6
    at 0.8 and 3e-9 at 0.86 by default, and shares too few keys to be compared with a chance of 1e-6 at the threshold; pairs
    that are compared are decided exactly. Nulls and texts without words have
    n_shingles 0 and no link. Equal texts share their links; repeated rows are kept; a row without
    doc_id gets its n_shingles, a null component and a null kept; an empty table gives no rows; other columns are
    ignored. Up to broadcast_rows classes that meet others are broadcast (some 50 bytes each), more are joined by shuffle.
    """
    found = _components(docs, width, percent, keys, hashes, seed, broadcast_rows, star_rounds)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, broadcast_rows: int = 100_000, **settings) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; other columns stay as they are, and rows without words or doc_id stay.

    Rows that repeat a doc_id with another text are judged apart; rows that repeat both all stay or go.
    """
    settings = {"width": 4, "percent": 80, "keys": 20, "hashes": 3, "seed": 11, "star_rounds": 1} | settings
    found = _components(docs, broadcast_rows=broadcast_rows, **settings)
    key, body = free_name(docs, "_id"), free_name(docs, "_body")
    gone = checkpointed(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key), F.col("body").alias(body)).distinct())
    named = docs.withColumns({key: F.col("doc_id").cast("long"), body: F.xxhash64("text")})
    few = gone.count() <= broadcast_rows
    return named.join(F.broadcast(gone) if few else gone, [key, body], "left_anti").select(*docs.columns)


#: near_duplicates() in DuckDB, by every pair that shares a shingle.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
g as (select doc_id, unnest(s) as g from s),
often as (select g from g group by g having count(*) > 1),
kept as (select doc_id, g from g semi join often using (g)),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from kept a join kept b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edge as (select a, b from link union select b, a from link),
reach(node, seen) as (select doc_id, doc_id from s union select r.node, e.b from reach r join edge e on e.a = r.seen)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(seen) as component_id, s.doc_id = min(seen) as kept from s join reach r on r.node = s.doc_id group by s.doc_id, len(s.s)
"""
