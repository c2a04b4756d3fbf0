"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders. Every window of `width` tokens of a benchmark
item is hashed in that form and joined to the same windows of all documents, so a question whose
numbers or names were exchanged still meets its original. The slots of aligned windows must then
agree: within one alignment each value of the item stands for one value of the document and the
other way round. Windows of full width are hashed in lower case as they are written, too.

A name is told by content, not by a document's letter case: the words that some item writes in lower
case are the benchmark's vocabulary, and every other word, of an item or of a document, may stand for a
name. So a copy in capitals, in title case or wrapped anew gives the windows of the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, text_or_empty, utf8_slices
from .wordhash import mix, runs, unspaced, words

# Words that count as numbers, units after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen".split()
UNITS = "mm cm m km meter meters metre metres kilometer kilometers inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kph watt watts volt volts joule joules".split()

_NUMBER, _NAME, _UNIT = (mix(np.array([x], np.uint64))[0] for x in (0x4E554D, 0x4E414D45, 0x554E4954))
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[np.r_[48:58, 65:91, 97:123, 128:256]] = False
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def _hashes_of(listed: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(listed).encode(), np.uint8)
    return np.unique(words(raw, np.array([0, len(raw)]), _SEPARATOR)[0])


_NUMBER_HASHES, _UNIT_HASHES = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)


_VOCABULARY_BITS = 24


def _tokens(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """(code, literal hash, is a slot, first byte, end byte, row) of every token: runs of letters and digits, numbers with . or , inside as one, and single characters of scripts without spaces.

    vocabulary is a table of _flags for the first 24 bits of a word's hash.
    """
    h, starts, ends, rows = words(raw, offsets, _SEPARATOR, scripts=unspaced(raw))
    if not len(h):
        return h, h, np.empty(0, bool), starts, ends, rows
    digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    number = (digits[ends] > digits[starts]) | np.isin(h, _NUMBER_HASHES)
    # 1,000.5 is one number: a numeric token right after another and one . or , joins it.
    gap = raw[np.maximum(starts - 1, 0)]
    joins = np.zeros(len(h), bool)
    joins[1:] = number[1:] & number[:-1] & (starts[1:] == ends[:-1] + 1) & (rows[1:] == rows[:-1]) & ((gap[1:] == 44) | (gap[1:] == 46))
    if joins.any():
        head = np.flatnonzero(~joins)
        last = np.append(head[1:], len(h)) - 1
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
        whole = sums[last + 1] - sums[head]
        h, starts, ends, rows, number = np.where(last > head, mix(whole), h[head]), starts[head], ends[last], rows[head], number[head]
    name = ~number & ~_flagged(vocabulary, h, _VOCABULARY_BITS)
    unit = np.zeros(len(h), bool)
    unit[1:] = number[:-1] & (rows[1:] == rows[:-1]) & np.isin(h[1:], _UNIT_HASHES)
    unit &= ~number
    name &= ~unit
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    return code, h, number | name | unit, starts, ends, rows


def _windows(code: np.ndarray, literal: np.ndarray, slot: np.ndarray, rows: np.ndarray, n_rows: int, width: int, full: int) -> tuple[np.ndarray, ...]:
    """(hash, row, first token, length, as it is written) of every window.

    A window in which more than three tokens in eight are slots is hashed as it is written only; other windows of `full`
    tokens come once with placeholders and, at the end, once as they are written.
    """
    by_code, owner, at = runs(code, rows, n_rows, width)
    by_word, _, _ = runs(literal, rows, n_rows, width)
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    length = np.minimum(counts[owner], width)
    slots = np.concatenate(([0], np.cumsum(slot)))
    held = slots[at + length] - slots[at] if len(at) else at
    plain = mix(by_word + np.uint64(1))
    written = 8 * held > 3 * length
    both = np.flatnonzero(~written & (length == full))
    h = np.concatenate((np.where(written, plain, by_code), plain[both]))
    every = np.concatenate((np.arange(len(at)), both))
    return h, owner[every], at[every], length[every], np.append(written, np.ones(len(both), bool))


def _slot_texts(raw: np.ndarray, slot: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, length: int) -> list[str]:
    return [raw[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").lower() for i in range(at, at + length) if slot[i]]


_BITS = 26  # of the filter that documents' windows pass before the join: 8 MB, whatever the benchmark's size


def _words_in_lower_case(items: DataFrame) -> DataFrame:
    """(word) 64-bit hashes, each once, of the words that some item writes without capitals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in utf8_slices(batch.column("_text")):
                low, low_offsets = next((x[2], x[3]) for x in utf8_slices(batch.column("_low").slice(a, b - a), 1 << 62))
                h, starts, ends, rows = words(raw, offsets, _SEPARATOR, lower=False, scripts=unspaced(raw))
                g, _, _, low_rows = words(low, low_offsets, _SEPARATOR, lower=False, scripts=unspaced(low))
                # Lower case may be longer in bytes but has the same words in the same order.
                if len(h) == len(g) and (rows == low_rows).all():
                    h = h[h == g]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], names=["word"])

    return items.select(text_or_empty().alias("_text"), F.lower(text_or_empty()).alias("_low")).mapInArrow(run, "word long").distinct()


def _flags(hashes: DataFrame, column: str, bits: int):
    """A broadcast table of one bit for each value of the first `bits` bits of the hashes; at most 2**(bits - 6) rows reach the driver."""
    x = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("x")).select(F.shiftright("x", 6).alias("word"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    rows = x.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def _flagged(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    x = hashes >> np.uint64(64 - bits)
    return (table.view(np.uint64)[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)


def item_windows(items: DataFrame, width: int, min_words: int, vocabulary) -> DataFrame:
    """(hash, item_id, item_at, n_windows, n_tokens, slots, written, inside) of every window of every item; vocabulary is a broadcast table of _flags.

    inside tells whether the item has min_words words or more, a character of a script without spaces being half a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for a, b, raw, offsets in utf8_slices(batch.column("_text")):
                code, literal, slot, starts, ends, rows = _tokens(raw, offsets, known)
                h, owner, at, length, written = _windows(code, literal, slot, rows, b - a, width, width)
                firsts = np.searchsorted(rows, np.arange(b - a))
                tokens = np.bincount(rows, minlength=b - a)
                scripts = unspaced(raw)
                halves = 2 * tokens - (np.bincount(rows, scripts[starts] > 0, minlength=b - a) if scripts is not None else 0)
                counts = np.where(tokens > 0, np.maximum(tokens - width, 0) + 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h.view(np.int64)), pa.array([ids[a + r] for r in owner], pa.int64()), pa.array(at - firsts[owner], pa.int64()), pa.array(counts[owner], pa.int64()), pa.array(length, pa.int64()),
                        pa.array([_slot_texts(raw, slot, starts, ends, i, n) for i, n in zip(at, length, strict=True)], pa.list_(pa.string())), pa.array(written),
                        pa.array((halves >= 2 * min_words)[owner]),
                    ],
                    names=["hash", "item_id", "item_at", "n_windows", "n_tokens", "slots", "written", "inside"],
                )

    taken = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(text_or_empty()).alias("_text"))
    return taken.mapInArrow(run, "hash long, item_id long, item_at long, n_windows long, n_tokens long, slots array<string>, written boolean, inside boolean")


def contaminated(docs: DataFrame, items: DataFrame, width: int = 8, min_coverage: float = 0.5, min_words: int = 5) -> DataFrame:
    """(doc_id, body, item_id, n_matched, coverage, kind) of every document and item whose windows meet, as they are written or with slots that agree.

    docs has doc_id and text, items has item_id and text; body is xxhash64 of the document's text,
    which tells rows apart that repeat a doc_id. coverage is the share of the item's windows
    found, min_coverage at least. kind is verbatim if every slot keeps its value, else
    reparameterised. An item shorter than `width` is one window of its own length, looked for in all
    texts if it has min_words words or more (a character of a script without spaces is half a word) and otherwise as a whole text only. A window in which more
    than three tokens in eight are numbers, names or units is looked for as it is written only, so an item of
    such windows has no re-parameterised copies. Nulls and texts
    without words match nothing; rows that repeat both doc_id and text give one row an item; empty
    tables give no rows; items with equal texts each give their rows. Texts are taken whole.
    """
    vocabulary = _flags(_words_in_lower_case(items), "word", _VOCABULARY_BITS)
    known = checkpointed(item_windows(items, width, min_words, vocabulary))
    short = sorted(r[0] for r in known.where(F.col("inside") & (F.col("n_tokens") < width)).select("n_tokens").distinct().collect())
    shared = _flags(known, "hash", _BITS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, common = shared.value, vocabulary.value
        for batch in batches:
            ids, bodies = batch.column("doc_id"), batch.column("body")
            for a, b, raw, offsets in utf8_slices(batch.column("_text")):
                code, literal, slot, starts, ends, rows = _tokens(raw, offsets, common)
                firsts = np.searchsorted(rows, np.arange(b - a))
                for size in (width, *short):
                    h, owner, at, length, _ = _windows(code, literal, slot, rows, b - a, size, width)
                    hit = np.flatnonzero(_flagged(flags, h, _BITS))
                    if size < width:
                        hit = hit[length[hit] == size]  # shorter texts were whole windows already
                    if len(hit):
                        own = pa.array(owner[hit] + a)
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(own), bodies.take(own), pa.array(h[hit].view(np.int64)), pa.array((at - firsts[owner])[hit], pa.int64()),
                                pa.array([_slot_texts(raw, slot, starts, ends, at[i], length[i]) for i in hit], pa.list_(pa.string())),
                                pa.array(np.full(len(hit), size < width)),
                            ],
                            names=["doc_id", "body", "hash", "doc_at", "doc_slots", "part"],
                        )

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.lower(text_or_empty()).alias("_text"))
    found = taken.mapInArrow(scan, "doc_id long, body long, hash long, doc_at long, doc_slots array<string>, part boolean")
    # A window that meets as it is written has the item's values in its slots, however many the document's letter case gives it.
    pairs = F.when(F.col("written"), F.transform("slots", lambda a: F.struct(a.alias("theirs"), a.alias("ours")))).otherwise(F.zip_with("slots", "doc_slots", lambda a, b: F.struct(a.alias("theirs"), b.alias("ours"))))
    met = found.join(known, "hash").where(~F.col("part") | F.col("inside")).where(F.col("written") | (F.size("slots") == F.size("doc_slots"))).select("doc_id", "body", "item_id", "n_windows", "item_at", (F.col("doc_at") - F.col("item_at")).alias("shift"), "written", pairs.alias("pairs"))
    aligned = met.groupBy("doc_id", "body", "item_id", "n_windows", "shift").agg(F.collect_set("item_at").alias("at"), F.collect_set(F.when(F.col("written"), F.col("item_at"))).alias("at_written"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    theirs = F.size(F.array_distinct(F.transform("pairs", lambda p: p["theirs"])))
    ours = F.size(F.array_distinct(F.transform("pairs", lambda p: p["ours"])))
    # Where slots conflict, the windows that meet as they are written still count.
    agreed = aligned.withColumn("agree", (theirs == F.size("pairs")) & (ours == F.size("pairs"))).where("agree or size(at_written) > 0")
    agreed = agreed.withColumns({"at": F.when(F.col("agree"), F.col("at")).otherwise(F.col("at_written")), "same": ~F.col("agree") | F.forall("pairs", lambda p: p["theirs"] == p["ours"])})
    whole = agreed.groupBy("doc_id", "body", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"), F.bool_and("same").alias("same"))
    return whole.where(F.col("n_matched") >= F.col("n_windows") * min_coverage).select(
        "doc_id", "body", "item_id", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """docs without the rows that contaminated() finds. Up to broadcast_rows found rows (16 bytes each) are broadcast, more are joined by shuffle."""
    names = free_name(docs, "_bad_id"), free_name(docs, "_bad_body")
    bad = checkpointed(contaminated(docs, items, **options).select(F.col("doc_id").alias(names[0]), F.col("body").alias(names[1])).distinct())
    few = bad.count() <= broadcast_rows
    body = free_name(docs, "_body")
    left = docs.withColumn(body, F.xxhash64("text"))
    return left.join(F.broadcast(bad) if few else bad, (F.col("doc_id").cast("long").eqNullSafe(F.col(names[0]))) & (F.col(body) == F.col(names[1])), "left_anti").drop(body)
