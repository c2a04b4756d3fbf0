"""Exact Jaccard join of n-gram sets by vertical partitioning, and the components of its links.

The global order of n-grams is the order of their 64-bit hashes, cut into fragments of equal range;
every set falls into one segment for each fragment.

1. Documents with equal sets form one class; from here on a class counts once.
2. Filter. A set that has a link shares at least three quarters of its n-grams with one other set.
   Each fragment of the lower half of the order reports how many n-grams of a segment no other set
   has; a class whose sum exceeds a quarter of its set can have no link and leaves.
3. Candidates. Over the classes left, n-grams are ordered by how many sets hold them; two linked
   sets share one of the first (a quarter + 1) of each. In a list of sets under one n-gram, each
   first meets the list's leader, and sets linked by then meet no more.
4. Verification. Partial overlaps are counted for each pair and fragment and summed for each pair.
5. Rest. A list of up to 64 sets that still holds several components is closed by the pairs of sets of
   like size that lie in different components: at most 32 for each entry of such a list. Longer lists are
   closed in blocks: sets that long lists connect, of one range of sizes, form a neighbourhood; it is cut into
   blocks, each pair of blocks is one group that counts overlaps as a product of incidence matrices and
   returns links that join components, at most one for each of its sets. So a group of n near copies costs
   a few pairs for each member, and no rows for its n * n pairs; what it costs beyond that is
   arithmetic, and each set travelling once for every block of its neighbourhood.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, sized, text_or_empty, utf8_slices
from .components import components
from .wordhash import runs, words

#: N-grams that one fragment of the filter holds, at about 4 bytes each.
_FRAGMENT = 4_000_000
#: Fragments in which overlaps are counted.
_SEGMENTS = 8
_FLUSH = 1_000_000
#: Sets, and n-grams, of one block in the last step.
_BLOCK_SETS, _BLOCK_GRAMS = 160, 400_000
#: Sets in a list that is closed by pairs.
_SHORT_LIST = 64
#: Ranges of sizes; linked sets lie in one range or in neighbouring ones, as 1 / 0.75 is below it.
_SIZE_STEP = 1.4


def _sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, bounds): the distinct n-grams of each row in the order of their hashes, and where each row's begin."""
    n = len(offsets) - 1
    h, _, _, rows = words(raw, offsets)
    grams, owners, _ = runs(h, rows, n, width)
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
        grams, owners = grams[new], owners[new]
    return grams, np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n))))


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes(), usedforsecurity=False).digest()


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, body, n_shingles, digest) of every row; digest is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, raw, offsets in utf8_slices(batch.column("_text")):
                grams, bounds = _sets(raw, offsets, width)
                sizes = np.diff(bounds)
                digests = [_digest(grams[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                own = [batch.column(c).slice(at, end - at) for c in ("doc_id", "body")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "body", "n_shingles", "digest"])

    return docs.mapInArrow(run, "doc_id long, body long, n_shingles long, digest binary")


def _lone_counts(docs: DataFrame, width: int, n_fragments: int) -> DataFrame:
    """(head, lone): for the first 8 bytes of a set's digest, how many of its n-grams in the lower half of the order no other set holds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[int] = []
        parts: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            # Within the block an n-gram that two sets hold is settled: it travels once, as shared.
            tokens = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), bool)
            new[1:] = tokens[1:] != tokens[:-1]
            last = np.append(new[1:], True)
            alone, twice = new & last, new & ~last
            # The lower half: n_fragments equal ranges of hashes below 2**63.
            step = (1 << 63) // n_fragments
            edges = np.arange(n_fragments + 1, dtype=np.uint64) * np.uint64(step)
            edges[-1] = np.uint64(1 << 63)
            head = np.array(heads, np.int64)
            shift = max(0, step.bit_length() - 32)
            lone_t, lone_o, shared = tokens[alone], owner[alone], tokens[twice]
            a, b = np.searchsorted(lone_t, edges), np.searchsorted(shared, edges)
            out = []
            for f in range(n_fragments):
                t, o, s = lone_t[a[f] : a[f + 1]], lone_o[a[f] : a[f + 1]], shared[b[f] : b[f + 1]]
                if not len(t) and not len(s):
                    continue
                # Four bytes tell n-grams apart well enough here: two that agree only keep a set in.
                low = lambda x, f=f: ((x - edges[f]) >> np.uint64(shift)).astype("<u4")
                by = np.argsort(o, kind="stable")
                owners, sizes = np.unique(o, return_counts=True)
                out.append((f, head[owners].astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), low(t)[by].tobytes(), low(s).tobytes()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["fragment", "heads", "sizes", "tokens", "shared"])

        for batch in batches:
            for _, _, raw, offsets in utf8_slices(batch.column("_text")):
                grams, bounds = _sets(raw, offsets, width)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if a == b:
                        continue
                    head = int.from_bytes(_digest(grams[a:b])[:8], "big", signed=True)
                    if head in seen:
                        continue
                    seen.add(head)
                    half = grams[a : a + int(np.searchsorted(grams[a:b], np.uint64(1 << 63)))]
                    heads.append(head)
                    parts.append(half)
                    held += len(half)
                if held >= _FLUSH:
                    yield from flush()
                    heads, parts, held, seen = [], [], 0, set()
        if parts and held:
            yield from flush()

    def lone(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        heads = np.concatenate([np.repeat(np.frombuffer(h, "<i8"), np.frombuffer(s, "<u4")) for h, s in zip(rows["heads"], rows["sizes"], strict=True)])
        tokens = np.concatenate([np.frombuffer(t, "<u4") for t in rows["tokens"]])
        if not len(tokens):
            return pa.table({"head": pa.array([], pa.int64()), "lone": pa.array([], pa.int64())})
        shared = np.unique(np.concatenate([np.frombuffer(s, "<u4") for s in rows["shared"]]))
        order = np.lexsort((heads, tokens))
        tokens, heads = tokens[order], heads[order]
        distinct = np.ones(len(tokens), bool)
        distinct[1:] = (tokens[1:] != tokens[:-1]) | (heads[1:] != heads[:-1])
        tokens, heads = tokens[distinct], heads[distinct]
        same = tokens[1:] == tokens[:-1]
        single = ~(np.append(same, False) | np.insert(same, 0, False))
        single &= ~np.isin(tokens, shared)
        owners, counts = np.unique(heads[single], return_counts=True)
        return pa.table({"head": pa.array(owners, pa.int64()), "lone": pa.array(counts, pa.int64())})

    blocks = docs.mapInArrow(cut, "fragment int, heads binary, sizes binary, tokens binary, shared binary")
    return blocks.groupBy("fragment").applyInArrow(lone, "head long, lone long").groupBy("head").agg(F.sum("lone").alias("lone"))


def _segments(docs: DataFrame, wanted: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """(node, segment, grams) of the sets of `wanted` (doc_id, node, digest)."""
    few = wanted.count() <= broadcast_rows  # about 50 bytes a row
    joined = docs.join(F.broadcast(wanted) if few else wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(_SEGMENTS + 1, dtype=np.uint64) * np.uint64((1 << 64) // _SEGMENTS)
        for batch in batches:
            digests, nodes = batch.column("digest").to_pylist(), batch.column("node").to_pylist()
            for at, _, raw, offsets in utf8_slices(batch.column("_text")):
                grams, bounds = _sets(raw, offsets, width)
                out_n, out_s, sizes, kept = [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own = grams[a:b]
                    if not len(own) or _digest(own) != digests[at + i]:
                        continue  # another text under a repeated doc_id
                    cuts = np.append(np.searchsorted(own, edges[:-1]), len(own))
                    for s in range(_SEGMENTS):
                        if cuts[s + 1] > cuts[s]:
                            out_n.append(nodes[at + i])
                            out_s.append(s)
                            sizes.append(cuts[s + 1] - cuts[s])
                    kept.append(own)
                if out_n:
                    values = pa.array(np.concatenate(kept).view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([pa.array(out_n, pa.int64()), pa.array(out_s, pa.int32()), lists], names=["node", "segment", "grams"])

    return joined.select("_text", "node", "digest").mapInArrow(run, "node long, segment int, grams array<long>")


def _verified(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is percent / 100 or more."""
    left = segments.select(F.col("node").alias("a"), "segment", F.col("grams").alias("ga"))
    right = segments.select(F.col("node").alias("b"), "segment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "segment"]).select("a", "b", "segment", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    # A repeated doc_id can bring a segment twice; it counts once.
    overlap = partial.groupBy("a", "b", "segment").agg(F.max("part").alias("part")).groupBy("a", "b").agg(F.sum("part").alias("overlap"))
    na, nb = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    both = overlap.join(na, "a").join(nb, "b")
    return both.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b")


def _block_links(percent: int):
    def links(table: pa.Table) -> pa.Table:
        nodes, labels, blocks = (table.column(c).to_numpy() for c in ("node", "label", "block"))
        lists = table.column("grams").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        grams, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        one, two = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        overlap = np.zeros((len(one), len(two)), np.float32)
        width = 4096
        for low in range(0, len(grams), width):
            a, b = np.searchsorted(at, (low, low + width))
            held = np.zeros((len(nodes), width), np.float32)
            held[owner[a:b], at[a:b] - low] = 1
            overlap += held[one] @ held[two].T
        shared = overlap.astype(np.int64)
        near = 100 * shared >= percent * (sizes[one][:, None] + sizes[two][None, :] - shared)
        near &= labels[one][:, None] != labels[two][None, :]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out_a, out_b = [], []
        for i in np.flatnonzero(near.any(axis=1)):
            cols = np.flatnonzero(near[i])
            for j in cols[np.unique(labels[two[cols]], return_index=True)[1]]:
                x, y = top(int(labels[one[i]])), top(int(labels[two[j]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    pair = sorted((int(nodes[one[i]]), int(nodes[two[j]])))
                    out_a.append(pair[0])
                    out_b.append(pair[1])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return links


def _lists(now: DataFrame, *also: str) -> DataFrame:
    """The lists of one n-gram (and `also`) that hold more than one component, with their length and one node of theirs."""
    return now.groupBy("gram", *also).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("length"), F.min("node").alias("lead")).where("lo < hi")


def _ranged(now: DataFrame, sizes: DataFrame) -> DataFrame:
    """now with n and range: a set stands in its own range of sizes together with the one below, and with the one above."""
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(_SIZE_STEP))).cast("int")
    return now.join(sizes, "node").withColumn("range", F.explode(F.array(step, step + 1)))


def _short_list_pairs(now: DataFrame, sizes: DataFrame, percent: int, alike: Callable[[Column, Column], Column] | None, hoods: DataFrame | None) -> DataFrame:
    """(a, b): the pairs of different components in lists of several that are short in their range of sizes, as far as their sizes, and sketches, allow a link; pairs that one of the hoods holds were compared there."""
    ranged = _ranged(now, sizes)
    lists = checkpointed(_lists(ranged, "range").where(F.col("length") <= _SHORT_LIST).select("gram", "range"))
    held = ranged.join(lists, ["gram", "range"])
    held = held.withColumn("hood", F.lit(None).cast("long")) if hoods is None else held.join(hoods, ["node", "range"], "left")
    side = lambda s: held.select("gram", "range", F.col("node").alias(s), F.col("label").alias(f"l{s}"), F.col("n").alias(f"n{s}"), F.col("hood").alias(f"h{s}"), *([F.col("sketch").alias(f"s{s}")] if alike else []))
    like = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & F.coalesce(F.col("ha") != F.col("hb"), F.lit(True))
    if alike:
        like &= alike(F.col("sa"), F.col("sb"))
    return side("a").join(side("b"), ["gram", "range"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & like).select("a", "b").distinct()


def _closed(now: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, b): links between the components that long lists of one n-gram still hold apart; and (node, range, hood), the neighbourhoods in which all sets were compared."""
    ranged = _ranged(now, sizes).select("node", "label", "gram", "range")
    long = checkpointed(_lists(ranged, "range").where(F.col("length") > _SHORT_LIST).select("gram", "range", "lead"))
    if long.isEmpty():
        return now.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), None
    # Two keys that agree in their hash would only be compared without need.
    key = lambda node: F.xxhash64(F.lit(_SHORT_LIST), F.col("range"), F.col(node))
    met = checkpointed(ranged.join(long, ["gram", "range"]).select("node", "label", "range", key("node").alias("key"), key("lead").alias("lead_key")).distinct())
    found = components(met.select(F.col("key").alias("a"), F.col("lead_key").alias("b")))
    hoods = checkpointed(met.select("node", "label", "range", "key").distinct().join(found.withColumnRenamed("node", "key").withColumnRenamed("label", "hood"), "key").select("node", "label", "range", "hood"))
    # A repeated doc_id can bring a segment twice.
    once = segments.join(hoods.select("node").distinct(), "node", "left_semi").groupBy("node", "segment").agg(F.first("grams").alias("grams"))
    sets = checkpointed(once.groupBy("node").agg(F.flatten(F.collect_list("grams")).alias("grams")).join(hoods.drop("range"), "node"))
    counts = sets.groupBy("hood").agg(F.greatest(F.ceil(F.count("*") / _BLOCK_SETS), F.ceil(F.sum(F.size("grams")) / _BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    placed = sets.join(counts, "hood").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    tiles = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")).select("hood", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "label", "grams")
    return tiles.groupBy("hood", "x", "y").applyInArrow(_block_links(percent), "a long, b long"), hoods.select("node", "range", "hood")


def link_lists(postings: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int, star_rounds: int, first: DataFrame | None = None, alike: Callable[[Column, Column], Column] | None = None, blocks_first: bool = False) -> DataFrame | None:
    """(node, label) of the sets that have a link, with the smallest node of their component as label; None if there are none.

    postings (node, gram) are lists of candidates: two sets that link share a gram. segments (node, segment,
    grams) hold the sets and sizes (node, n) their numbers of elements. `first` holds lists that meet their leaders
    before all others do, so that sets which stand in many lists are mostly joined by then. With `alike` the lists carry a
    sketch of each set, and pairs whose sketches do not suffice are not compared. blocks_first closes long lists before short
    ones: where sets stand in very many lists, most pairs of short lists lie in the neighbourhoods of long ones.
    """
    extra = ["sketch"] if alike else []
    links = labels = tested = hoods = None
    star_rounds += first is not None
    for turn in range(star_rounds + 2):
        lists = first if turn == 0 and first is not None else postings
        if labels is None:
            now = lists.withColumn("label", F.col("node"))
        else:
            now = lists.join(labels, "node", "left").select("node", "gram", *extra, F.coalesce("label", "node").alias("label"))
        blocks = turn == star_rounds + (not blocks_first)
        if not blocks:
            if turn < star_rounds:
                # The leader of a list: another one in each turn.
                rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), F.col("node"), F.col("label"), *extra)
                led = sized(checkpointed(now.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(rank).alias("lead")).where("lo < hi")))
                apart = F.col("label") != F.col("lead.label")
                if alike:
                    apart &= alike(F.col("sketch"), F.col("lead.sketch"))
                pairs = now.join(led, "gram").where(apart).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
            else:
                pairs = _short_list_pairs(now, sizes, percent, alike, hoods)
            pairs = sized(checkpointed(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")))
            if pairs.isEmpty():
                continue
            tested = pairs if tested is None else tested.union(pairs)
            found = sized(checkpointed(_verified(pairs, segments, sizes, percent)))
        else:
            found, hoods = _closed(now.drop("sketch"), segments, sizes, percent)
            found = sized(checkpointed(found))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
    return labels


def _linked(classes: DataFrame, docs: DataFrame, width: int, percent: int, broadcast_rows: int, star_rounds: int) -> DataFrame | None:
    """(node, label) of the classes (node, doc_id, n, digest) that have a link; None if there are none."""
    segments = checkpointed(_segments(docs, classes.select("doc_id", "node", "digest"), width, broadcast_rows))
    sizes = classes.select("node", "n")
    grams = segments.select("node", F.explode("grams").alias("gram"))
    # Stored, so that the join deals out both sides anew and can split an n-gram that many sets hold.
    often = checkpointed(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    # The first n - ceil(n * percent / 100) + 1 n-grams by (df, hash); those of one set come first and give no pair.
    listed = grams.join(often, "gram").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "gram"))).alias("own"))
    n, own = F.col("n"), F.size("own")
    prefix = n - F.ceil(n * percent / 100.0).cast("long") + 1 - (n - own)
    postings = checkpointed(listed.join(sizes, "node").where(prefix > 0).select("node", F.explode(F.slice("own", F.lit(1), F.least(prefix, own.cast("long")).cast("int"))).alias("g")).select("node", F.col("g.gram").alias("gram")))
    return link_lists(postings, segments, sizes, percent, star_rounds)


def _components_of_rows(docs: DataFrame, width: int, percent: int, broadcast_rows: int, star_rounds: int) -> DataFrame:
    """jaccard_components() with body, a hash of the text."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), text_or_empty().alias("_text"))
    rows = checkpointed(set_rows(body, width))
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    # Ids are taken from the table as it lies on disk, so they do not change.
    classes = checkpointed(classes).withColumn("node", F.monotonically_increasing_id()).withColumn("head", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    n_fragments = int(max(12, -(-total // (2 * _FRAGMENT))))
    lone = _lone_counts(body, width, n_fragments)
    may = checkpointed(classes.join(lone, "head", "left").where(F.coalesce("lone", F.lit(0)) * 100 <= F.col("n") * (100 - percent)).select("node", "doc_id", "n", "digest"))
    labels = _linked(may, body, width, percent, broadcast_rows, star_rounds)
    copied = classes.where("copies > 1").select("digest", "doc_id")
    if labels is None:
        named = copied.select("digest", F.col("doc_id").alias("component_id"))
    else:
        least = labels.join(classes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
        linked = labels.join(least, "label").join(classes.select("node", "digest"), "node").select("digest", "component_id")
        named = copied.join(linked.select("digest"), "digest", "left_anti").select("digest", F.col("doc_id").alias("component_id")).union(linked)
    return rows.join(named, "digest", "left").select("doc_id", "body", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, broadcast_rows: int = 100_000, star_rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a set holds the distinct
    runs of `width` words, or the whole sequence if there are fewer. Two rows link when
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach, its
    own included. Nulls and texts without words have n_shingles 0 and no link. Equal texts share
    their links; repeated rows are kept; a row without doc_id gets its n_shingles and a null
    component; an empty table gives no rows; other columns are ignored. Texts are taken whole. A table of up
    to broadcast_rows classes that may have links is broadcast (some 50 bytes each), a larger one
    is joined by shuffle.
    """
    return _components_of_rows(docs, width, percent, broadcast_rows, star_rounds).drop("body")


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 75, broadcast_rows: int = 100_000, star_rounds: int = 1) -> DataFrame:
    """docs with one document for each group of linked rows: that of the smallest doc_id; other columns stay as they are.

    Rows without words or without doc_id stay. Of rows that repeat doc_id and text one stays; rows that
    repeat a doc_id with another text are judged apart. Up to broadcast_rows keys that go (16 bytes each)
    are broadcast, more are joined by shuffle.
    """
    found = checkpointed(_components_of_rows(docs, width, percent, broadcast_rows, star_rounds))
    key, body = free_name(docs, "_id"), free_name(docs, "_body")
    named = docs.withColumns({key: F.col("doc_id").cast("long"), body: F.xxhash64("text")})

    def among(keys: DataFrame, how: str, left: DataFrame) -> DataFrame:
        few = keys.count() <= broadcast_rows
        return left.join(F.broadcast(keys) if few else keys, [key, body], how)

    rows = found.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias(key), F.col("body").alias(body), (F.col("component_id") != F.col("doc_id")).alias("gone"))
    kept = among(checkpointed(rows.where("gone").select(key, body).distinct()), "left_anti", named)
    repeated = checkpointed(rows.where("not gone").groupBy(key, body).count().where("count > 1").select(key, body))
    if not repeated.isEmpty():
        once = among(repeated, "left_semi", kept).dropDuplicates([key, body])
        kept = among(repeated, "left_anti", kept).unionByName(once)
    return kept.select(*docs.columns)


#: jaccard_components() in DuckDB, by every pair that shares a shingle.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
g as (select doc_id, unnest(s) as g from s),
often as (select g from g group by g having count(*) > 1),
kept as (select doc_id, g from g semi join often using (g)),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from kept a join kept b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
edge as (select a, b from link union select b, a from link),
reach(node, seen) as (select doc_id, doc_id from s union select r.node, e.b from reach r join edge e on e.a = r.seen)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(seen) as component_id from s join reach r on r.node = s.doc_id group by s.doc_id, len(s.s)
"""
