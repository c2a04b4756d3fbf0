"""The chunk-hash tokenizer, token masks and labels, packing, padding and micro-batch arithmetic."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joining import join_measured
from ..functions.storage import checkpointed

IGNORED = -100


def chunk_id(chunk: Column, vocab_size: int = 32_000) -> Column:
    """The token id of a chunk: the first 8 bytes of its SHA-256, modulo the ids after the 4 special ones."""
    head = F.conv(F.substring(F.sha2(chunk, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(vocab_size - 4) + 4).cast("long")


def chunk_tokens(rows: DataFrame, text: str = "text", size: int = 4, vocab_size: int = 32_000) -> DataFrame:
    """One row a token: rows' columns, place, start, end and token_id. Null and empty texts give none."""
    # One pass over the text: a substring for each token would be read from the text's beginning every time.
    chunks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    cut = rows.select("*", F.posexplode(chunks).alias("place", "_chunk")).withColumn("start", F.col("place") * size)
    return cut.withColumn("end", F.col("start") + F.length("_chunk")).withColumn("token_id", chunk_id(F.col("_chunk"), vocab_size)).drop("_chunk")


def token_mask(tokens: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """tokens with trained (1 if a trainable span of the key covers any of the token's characters) and label (the id, or -100)."""
    # Spans and tokens in one order: a token is covered if a span that starts before its end reaches beyond its start.
    marks = spans.where("trainable").select(key, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_is_token"), F.col("end").cast("long").alias("_reach"))
    both = tokens.select("*", (F.col("end") - 1).cast("long").alias("_at"), F.lit(1).alias("_is_token")).unionByName(marks, allowMissingColumns=True)
    far = F.max("_reach").over(Window.partitionBy(key).orderBy("_at", "_is_token").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    trained = F.coalesce(far > F.col("start"), F.lit(False)).cast("int")
    told = both.withColumn("trained", trained).where("_is_token = 1").drop("_at", "_is_token", "_reach")
    return told.withColumn("label", F.when(F.col("trained") == 1, F.col("token_id")).otherwise(F.lit(IGNORED).cast("long")))


def labels(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(IGNORED))


def any_in_range(mask: Column, start: Column, end: Column) -> Column:
    """1 if the mask has a 1 in [start, end); offsets beyond the mask are ignored."""
    return F.exists(F.slice(mask, start + 1, F.greatest(end - start, F.lit(0))), lambda m: m == 1).cast("int")


def next_fit(rows: DataFrame, shard: str, order: str, length: str, max_length: int) -> DataFrame:
    """Packs of each shard in order: shard, order, length (cut to max_length), oversized, pack, start and emitted.

    A row goes into the open pack while it fits and else opens the next one; a row longer than
    max_length is a pack of its own, emitted at once and so before the pack that is open. `pack`
    numbers the other packs; `emitted` is the place of a row's pack in the output. A shard is one
    task, so it bounds what a task holds.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, used, number, held, emitted = [], 0, 0, [], 0
        for key, size in zip(pdf[order], pdf[length], strict=True):
            if size > max_length:
                out.append((key, max_length, True, None, 0, emitted))
                emitted += 1
                continue
            if held and used + size > max_length:
                out += [(*h, emitted) for h in held]
                held, used, number, emitted = [], 0, number + 1, emitted + 1
            held.append((key, size, False, number, used))
            used += size
        out += [(*h, emitted) for h in held]
        got = pd.DataFrame(out, columns=[order, length, "oversized", "pack", "start", "emitted"])
        got.insert(0, shard, pdf[shard].iloc[0])
        return got.astype({"pack": "Int64", length: "int64", "start": "int64"})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{shard}` {kinds[shard]}, `{order}` {kinds[order]}, `{length}` long, oversized boolean, pack long, start long, emitted long"
    return rows.select(shard, order, length).groupBy(shard).applyInPandas(pack, schema)


def unpack(packs: DataFrame, ids: str, spans: str) -> DataFrame:
    """Each span of a pack as a row with its slice of the ids."""
    return packs.select("*", F.posexplode(spans).alias("member", "span")).withColumn("part", F.slice(ids, F.col("span.start") + 1, F.col("span.end") - F.col("span.start")))


def right_pad(rows: DataFrame, batch: str, columns: dict[str, int]) -> DataFrame:
    """Array columns filled up on the right to the longest of their batch."""
    w = Window.partitionBy(batch)
    out = rows
    for name, fill in columns.items():
        longest = F.max(F.size(name)).over(w)
        out = out.withColumn(name, F.concat(name, F.array_repeat(F.lit(fill), (longest - F.size(name)).cast("int")).cast(rows.schema[name].dataType)))
    return out


def _first_fit(lengths: Iterable[int], limit: int) -> int:
    """Bins that first fit opens, by a tree whose nodes hold the most room of the bins below."""
    lengths = [int(x) for x in lengths]
    leaves = 1 << max(1, len(lengths)).bit_length()
    room = [limit] * (2 * leaves)
    n = 0
    for x in lengths:
        if x > limit:  # fits nowhere, so it has a bin of its own
            at = leaves + n
        else:
            at = 1
            while at < leaves:
                at = 2 * at if room[2 * at] >= x else 2 * at + 1
        n = max(n, at - leaves + 1)
        room[at] -= x
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return n


def first_fit_count(lengths: Column, limit: Column | int) -> Column:
    """Bins that first-fit opens for an array of lengths in order; a length above the limit fills a bin of its own."""

    @F.pandas_udf("int")
    def count(lists: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([_first_fit(x, int(m)) for x, m in zip(lists, limits, strict=True)], dtype="int32")

    return count(lengths, F.lit(limit) if isinstance(limit, int) else limit)


def least_loaded(rows: DataFrame, shard: str, order: str, length: str, k: int, equal_size: bool = False) -> DataFrame:
    """Rows dealt in order to the bin with the smallest sum, ties to the lowest; equal_size keeps the counts level (a shard's rows must divide by k)."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        if equal_size and len(pdf) % k:
            raise ValueError(f"{len(pdf)} rows do not divide into {k} bins")
        extra = int(pdf[length].sum()) + 1 if equal_size else 0
        heap = [(0, j) for j in range(k)]
        bins = []
        for size in pdf[length]:
            total, j = heap[0]
            heapq.heapreplace(heap, (total + int(size) + extra, j))
            bins.append(j)
        return pdf.assign(bin=bins)[[shard, order, length, "bin"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(shard, order, length).groupBy(shard).applyInPandas(deal, f"`{shard}` {kinds[shard]}, `{order}` {kinds[order]}, `{length}` {kinds[length]}, bin int")


def _differenced(lengths: list[int], k: int, equal_size: bool = False) -> list[int]:
    """The bin of each length by the largest differencing method."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} rows for {k} bins")
    ordered = sorted(zip(lengths, range(len(lengths)), strict=True))
    if equal_size and len(ordered) % k:
        raise ValueError(f"{len(ordered)} rows do not divide into {k} bins")
    step, entries = k if equal_size else 1, []
    for at in range(0, len(ordered), step):
        bins = sorted([(size, [i]) for size, i in ordered[at : at + step]] + [(0, []) for _ in range(k - step)], key=lambda t: (-t[0], t[1]))
        entries.append((bins[-1][0] - bins[0][0], -bins[0][0], ordered[at][1], bins))
    heapq.heapify(entries)
    while len(entries) > 1:
        a, b = heapq.heappop(entries), heapq.heappop(entries)
        bins = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a[3], reversed(b[3]), strict=True)), key=lambda t: (-t[0], t[1]))
        heapq.heappush(entries, (bins[-1][0] - bins[0][0], -bins[0][0], a[2], bins))
    place = {i: j for j, (_, members) in enumerate(entries[0][3]) for i in members}
    return [place[i] for i in range(len(lengths))]


def differencing(rows: DataFrame, shard: str, order: str, length: str, k: int, equal_size: bool = False) -> DataFrame:
    """Rows of each shard dealt to k bins by the largest differencing method, so that sums are near equal.

    Partial solutions are merged by largest spread first, the heaviest bin of one with the lightest
    of the other; among equal spreads the one with the heavier bin goes first. equal_size keeps the counts
    level: it begins with solutions of k rows of like size, one in each bin, so a shard's rows must
    divide by k. A shard with fewer than k rows raises.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(bin=_differenced(pdf[length].astype(int).tolist(), k, equal_size))[[shard, order, length, "bin"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(shard, order, length).groupBy(shard).applyInPandas(deal, f"`{shard}` {kinds[shard]}, `{order}` {kinds[order]}, `{length}` {kinds[length]}, bin int")


def microbatch_schedule(rows: DataFrame, step: str, rank: str, order: str, length: str, limit: int, multiple: int = 1) -> DataFrame:
    """(step, rank, order, length, bin, n_micro): the micro-batch of every row of a rank's step.

    A step has as many micro-batches as first fit under `limit` needs on the rank that needs most, rounded down to a multiple
    (one at least); every rank deals its rows to just so many by the largest differencing method. A rank with fewer
    rows than that raises. One rank's rows of one step meet in one task.
    """
    held = rows.groupBy(step, rank).agg(F.sort_array(F.collect_list(F.struct(order, length))).alias("_rows"))
    counted = checkpointed(held.withColumn("_n", first_fit_count(F.transform("_rows", lambda x: x[length]), limit)))
    most = counted.groupBy(step).agg(F.max("_n").alias("_n"))
    n = F.when(F.lit(multiple) > 1, F.greatest(F.floor(F.col("_n") / multiple) * multiple, F.lit(1))).otherwise(F.col("_n"))
    planned = join_measured(counted.drop("_n"), most.select(step, n.cast("int").alias("n_micro")), [step], "inner")

    @F.pandas_udf("array<int>")
    def deal(lists: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_differenced([int(x) for x in lengths], int(k)) for lengths, k in zip(lists, counts, strict=True)])

    dealt = planned.withColumn("_bins", deal(F.transform("_rows", lambda x: x[length]), F.col("n_micro")))
    out = dealt.select(step, rank, "n_micro", F.explode(F.arrays_zip("_rows", F.col("_bins").alias("bin"))).alias("x"))
    return out.select(step, rank, F.col(f"x._rows.{order}").alias(order), F.col(f"x._rows.{length}").alias(length), F.col("x.bin").alias("bin"), "n_micro")


def size_chunks(rows: DataFrame, shard: str, order: str, size: str, chunk: int) -> DataFrame:
    """Chunks of each shard in order: a row opens the next chunk if it would bring the open one to `chunk` or more."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        number, used, held, out = 0, 0, False, []
        for x in pdf[size]:
            if held and used + x >= chunk:
                number, used = number + 1, 0
            used, held = used + x, True
            out.append(number)
        return pdf.assign(chunk=out)[[shard, order, size, "chunk"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(shard, order, size).groupBy(shard).applyInPandas(cut, f"`{shard}` {kinds[shard]}, `{order}` {kinds[order]}, `{size}` {kinds[size]}, chunk long")


def mask_runs(tokens: DataFrame, key: str, order: str, flag: str, text: str) -> DataFrame:
    """Maximal runs of flag = 1: key, run (from 1), first, last and the joined text."""
    w = Window.partitionBy(key).orderBy(order)
    opened = tokens.withColumn("_new", ((F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) != 1)).cast("long"))
    numbered = opened.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col(flag) == 1)
    return numbered.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("text"))
