"""Substring deduplication by sliding sentence spans.

Every run of `run` consecutive sentences (and every long sentence alone) is hashed; where these have too
few words, with `grow` the shortest longer run from the same first or to the same last sentence is. The hashes are
joined over all documents, and sentences that a repeated span covers are removed wherever the span
is not its first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, stored, text_or_empty, utf8_slices
from .wordhash import _ladder, mix, unspaced, words

_NEWLINE = 10
_STOPS = np.zeros(256, bool)
_STOPS[[33, 46, 63]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[34, 39, 41, 93]] = True


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, first byte, end byte, row, half words) of every sentence.

    A sentence is a run of words that ends after a word ending in . ! or ?, closing quotes and
    brackets aside, or at a line's end. Its hash takes the words in order, A-Z as a-z, without the
    white space. In scripts without spaces each character counts as half a word, a sentence ends after the
    script's own full stop too, and in those that set a space between sentences (Thai, Lao, Khmer, Burmese) at white space.
    """
    scripts = unspaced(raw)
    h, starts, ends, rows = words(raw, offsets, scripts=scripts)
    n = len(h)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none
    last = raw[ends - 1]
    before = raw[np.maximum(ends - 2, starts)]
    stop = _STOPS[last] | (_CLOSERS[last] & _STOPS[before])
    kinds = scripts[starts] if scripts is not None else np.zeros(n, np.int8)
    stop |= kinds == 3
    stop[:-1] |= (kinds[:-1] == 2) & (starts[1:] > ends[:-1])
    lines = np.concatenate(([0], np.cumsum(raw == _NEWLINE)))
    close = np.ones(n, bool)
    close[:-1] = stop[:-1] | (lines[starts[1:]] > lines[ends[:-1]]) | (rows[1:] != rows[:-1])
    end = np.flatnonzero(close)
    first = np.concatenate(([0], end[:-1] + 1))
    up, down = _ladder(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:n])))
    value = mix((sums[end + 1] - sums[first]) * down[first] + (end + 1 - first).astype(np.uint64))
    halves = np.concatenate(([0], np.cumsum(np.where(kinds > 0, 1, 2))))
    return value, starts[first], ends[end], rows[first], halves[end + 1] - halves[first]


def span_rows(docs: DataFrame, run: int, min_words: int, lone_words: int, grow: bool) -> DataFrame:
    """(hash, doc_id, body, at, n) of every span: n sentences from number `at` of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column("doc_id"), batch.column("body")
            for a, b, raw, offsets in utf8_slices(batch.column("_text")):
                h, _, _, rows, counts = sentences(raw, offsets)
                if not len(h):
                    continue
                at = np.arange(len(h)) - np.searchsorted(rows, rows)
                sums = np.concatenate(([0], np.cumsum(counts)))
                lone = np.flatnonzero(counts >= 2 * lone_words)
                # Shortest runs of min_words words from every first and to every last sentence, within a row.
                every = np.arange(len(h))
                low, high = np.searchsorted(rows, rows), np.searchsorted(rows, rows, side="right")
                to = np.maximum(np.searchsorted(sums, sums[:-1] + 2 * min_words), every + run)
                since = np.minimum(np.searchsorted(sums, sums[1:] - 2 * min_words, side="right") - 1, every + 1 - run)
                onward, back = to <= high, since >= low
                if not grow:
                    onward &= to == every + run
                    back &= since == every + 1 - run
                # A run is known by its first and last sentence; most are found from both sides.
                both = np.unique(np.concatenate((every[onward] * (len(h) + 1) + to[onward], since[back] * (len(h) + 1) + every[back] + 1)))
                begin, end = (np.concatenate(x) for x in ((lone, both // (len(h) + 1)), (lone + 1, both % (len(h) + 1))))
                n = (end - begin).astype(np.int32)
                up, down = _ladder(len(h) + 1)
                prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
                value = mix((prefix[end] - prefix[begin]) * down[begin] + n.astype(np.uint64))
                own = pa.array(rows[begin] + a)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), ids.take(own), bodies.take(own), pa.array(at[begin].astype(np.int32)), pa.array(n)], names=["hash", "doc_id", "body", "at", "n"])

    return docs.mapInArrow(cut, "hash long, doc_id long, body long, at int, n int")


def drop_repeated_spans(docs: DataFrame, run: int = 2, min_words: int = 10, lone_words: int = 30, changed_only: bool = False, grow: bool = False) -> DataFrame:
    """docs with text without the sentences that a repeated span covers, and n_sentences, n_removed, removed and first_doc_ids.

    A span is `run` consecutive sentences of min_words words or more together, one sentence of lone_words
    or more (a character of a script without spaces is half a word), or with `grow` the shortest longer run of min_words words from a first or to a last sentence. Its first occurrence, by doc_id (nulls first), then a hash of the text, then place,
    stays; the others go, in the same document too. removed lists [start, end) in UTF-8 bytes of
    the old text; first_doc_ids the documents that keep the spans. A removed sentence takes the white space after it along.
    changed_only leaves out rows that lose nothing. Nulls stay null and empty texts empty; rows
    that repeat doc_id and text are one document and are treated alike, so one copy of the row is enough to keep;
    an empty table gives no rows; other columns are kept, those of the names above replaced.
    """
    docs = docs.drop("n_sentences", "n_removed", "removed", "first_doc_ids")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), text_or_empty().alias("_text"))
    spans = stored(span_rows(base, run, min_words, lone_words, grow), "spans")
    place = F.struct("doc_id", "body", "at")
    # Stored, so that the join deals out both sides anew and can split a span that many documents hold.
    firsts = checkpointed(spans.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hash", "first"))
    later = spans.join(firsts, "hash").where(~place.eqNullSafe(F.col("first")))
    key, body, cut_name = (free_name(docs, c) for c in ("_key", "_body", "_cuts"))
    cuts = later.groupBy("doc_id", "body").agg(F.collect_set(F.struct("at", "n")).alias(cut_name), F.collect_set("first.doc_id").alias("first_doc_ids"))
    plain = lambda c: F.struct(F.coalesce(c, F.lit(0).cast("long")), c.isNull())
    left = docs.withColumns({key: plain(F.col("doc_id").cast("long")), body: F.xxhash64("text")})
    right = cuts.select(plain(F.col("doc_id")).alias(key), F.col("body").alias(body), cut_name, "first_doc_ids")
    joined = left.join(right, [key, body], "inner" if changed_only else "left").drop(key, body)
    names = docs.columns

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column("text"), batch.column(cut_name)
            n_all, n_out, spans_out, new = [], [], [], []
            for a, b, raw, offsets in utf8_slices(texts):
                _, starts, ends, rows, _ = sentences(raw, offsets)
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                for i in range(b - a):
                    s, e = bounds[i], bounds[i + 1]
                    n_all.append(e - s)
                    pairs = cuts[a + i].as_py()
                    if not pairs:
                        n_out.append(0)
                        spans_out.append([])
                        new.append(texts[a + i].as_py())
                        continue
                    gone = np.zeros(e - s + 1, np.int64)
                    np.add.at(gone, [p["at"] for p in pairs], 1)
                    np.add.at(gone, [p["at"] + p["n"] for p in pairs], -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    froms = starts[s:e]
                    tos = np.append(starts[s + 1 : e], offsets[i + 1])
                    keep = np.ones(offsets[i + 1] - offsets[i], bool)
                    for k in np.flatnonzero(gone):
                        keep[froms[k] - offsets[i] : tos[k] - offsets[i]] = False
                    n_out.append(int(gone.sum()))
                    spans_out.append([{"start": int(froms[k] - offsets[i]), "end": int(ends[s + k] - offsets[i])} for k in np.flatnonzero(gone)])
                    new.append(raw[offsets[i] : offsets[i + 1]][keep].tobytes().decode("utf-8", "replace"))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            out = {"text": pa.array(new, pa.string()), "n_sentences": pa.array(n_all, pa.int64()), "n_removed": pa.array(n_out, pa.int64()), "removed": pa.array(spans_out, kind)}
            order = [*names, "n_sentences", "n_removed", "removed", "first_doc_ids"]
            yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(c) for c in order], names=order)

    types = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(remove, f"{types}, n_sentences long, n_removed long, removed array<struct<start:int,end:int>>, first_doc_ids array<long>")
