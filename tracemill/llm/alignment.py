"""Alignment of two tokenizers' tokens over the same bytes.

Both token streams of a text are read by a transducer. Its state is the side that is ahead and the
bytes by which it is (the dangling suffix); the next token is taken from the side behind, and the
transition from a state by a token is computed once and remembered. Where the suffix is empty, both
sides end together: a group closes and its last two tokens are linked.

The vocabularies prove that no token of either side goes on over certain places, such as a single space
between two other characters, so a text falls into pieces that are encoded and aligned apart; what a
worker has met before it looks up. The counts of linked pairs over the whole corpus come from a second pass over the stored links.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored, text_or_empty
from .piece_codec import check_model

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "!#$%&*,.:;?"
#: No token goes on before a single space with a non-space on either side, between a letter and a mark, and from a lone line break to a letter.
_CUT = re.compile(rf"(?<=\S)(?= \S)|(?<=[{_LATIN}])(?=[{_MARKS}])|(?<=\S\n)(?=[{_LATIN}])")
_CHUNK = 1 << 17  # characters of a long text that are cut at once
_BATCH = 1 << 20  # characters whose new pieces go to the libraries at once
_MEMO_LIMIT = 200_000  # pieces in each of two generations, and transitions
_TOGETHER = 2000  # pieces that are encoded in one text
_MEMO_CHARS = 48  # of a piece that is remembered for other batches
_SHIFT = 40  # bits of each number that is added up with others in one
_aligners: dict[tuple[str, str], Aligner] = {}


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens of both sides, their bytes, and the transducer. Side A is a byte-level .json file, side B a merge-type .model file."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        if conf.get("normalizer") is not None or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError(f"{path_a} is no byte-level vocabulary without a normaliser")
        with open(path_b, "rb") as f:
            check_model(f.read())
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        #: Strings that side A takes as one token wherever they stand.
        self.added = [x["content"] for x in conf.get("added_tokens", []) if not x.get("special")]
        letters = _byte_letters()
        self.bytes_a = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
        if not all(self.bytes_b) or not all(self.bytes_a.values()):
            raise ValueError("a token without bytes ends nowhere")
        self.apart = not any(re.search(f"[^▁]▁|[{_LATIN}][{_MARKS}]|\n[{_LATIN}]", p) for p in pieces)
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.sizes_a[i] = len(x)
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}  # the generation before; what is met again moves to the new one
        self._restart()

    def _restart(self) -> None:
        """Forgets all states but the first, in which nothing dangles."""
        self.states: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        self.ahead_a = [False]
        self.dangling = [b""]
        self.steps: list[dict[int, int]] = [{}]
        self.n_steps = 0

    def _step(self, at: int, token: int) -> int:
        """The state after `token` of the side behind (of side A where nothing dangles); -1 if the bytes differ."""
        ahead_a, dangling = self.ahead_a[at], self.dangling[at]
        own = self.bytes_b[token] if ahead_a else self.bytes_a[token]
        if dangling.startswith(own):
            found = ahead_a, dangling[len(own) :]
        elif own.startswith(dangling):
            found = not ahead_a, own[len(dangling) :]
        else:
            self.steps[at][token] = -1
            return -1
        if not found[1]:
            found = False, b""
        if found not in self.states:
            self.states[found] = len(self.steps)
            self.ahead_a.append(found[0])
            self.dangling.append(found[1])
            self.steps.append({})
        self.steps[at][token] = self.states[found]
        self.n_steps += 1
        return self.states[found]

    def align(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """(end in a, end in b) of every group of tokens; None if the bytes of the two sides differ."""
        if self.n_steps > _MEMO_LIMIT:
            self._restart()
        steps, ahead_a, ends = self.steps, self.ahead_a, []
        i = j = at = 0
        n, m = len(a), len(b)
        while True:
            if ahead_a[at]:
                if j == m:
                    return None
                token = b[j]
                j += 1
            elif i < n:
                token = a[i]
                i += 1
            else:
                return ends if not at and j == m else None
            to = steps[at].get(token)
            at = self._step(at, token) if to is None else to
            if at < 0:
                return None
            if not at:
                ends.append((i, j))

    def cut(self, joined: str) -> Iterator[list[str]]:
        """The pieces of a text with its leading space, some chunks of a long text one after the other."""
        if not self.apart or any(x in joined for x in self.added):
            yield [joined]
            return
        at = 0
        while at < len(joined):
            found = _CUT.search(joined, at + _CHUNK) if at + _CHUNK < len(joined) else None
            end = found.start() if found else len(joined)
            yield _CUT.split(joined[at:end])
            at = end

    def _encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each piece on either side.

        Pieces that do not end in white space, but for a lone line break, are encoded as one text, each after something from which no token goes
        on to it; their bytes tell which tokens are whose. Where those do not add up, and for other pieces, each is encoded apart.
        """
        plain = [i for i, p in enumerate(pieces) if self.apart and (not p[-1].isspace() or (p[-1] == "\n" and not p[-2:-1].isspace())) and not (p[0] == " " and p[1].isspace()) and not any(x in p for x in self.added)]
        one: list[list[int]] = [[] for _ in pieces]
        two: list[list[int]] = [[] for _ in pieces]
        left = set(range(len(pieces)))
        for low in range(0, len(plain), _TOGETHER):
            part = plain[low : low + _TOGETHER]
            before = ["" if pieces[i][0] == " " else "\n" if pieces[i][0].isalpha() else " a" for i in part]
            text = " a" + "".join([x + pieces[i] for x, i in zip(before, part, strict=True)])
            size = np.array([len(pieces[i].encode()) for i in part])
            ends = 2 + np.cumsum(size + np.array([len(x) for x in before]))
            a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
            b = self.b.encode(text[1:])
            cuts = []
            for ids, sizes in ((a, self.sizes_a), (b, self.sizes_b)):
                at = np.concatenate(([0], np.cumsum(sizes[ids])))
                first, last = np.searchsorted(at, ends - size), np.searchsorted(at, ends)
                if at[-1] != ends[-1] or (at[first] != ends - size).any() or (at[last] != ends).any():
                    break
                cuts.append((first.tolist(), last.tolist()))
            if len(cuts) == 2:
                for i, x, y, z, w in zip(part, *cuts[0], *cuts[1], strict=True):
                    one[i], two[i] = a[x:y], b[z:w]
                left.difference_update(part)
        for i in left:
            one[i], two[i] = self._alone(pieces[i])
        return one, two

    def _alone(self, piece: str) -> tuple[list[int], list[int]]:
        """Ids of one piece, after a letter or a line break where it does not begin with a space."""
        before = "" if piece[0] == " " else " \n" if piece[0].isalpha() else " a"
        a, b = self.a.encode(before + piece, add_special_tokens=False).ids, self.b.encode((before + piece)[1:])
        if before:
            a, b = (x[int(np.searchsorted(np.cumsum(sizes[x]), len(before))) + 1 :] for x, sizes in ((a, self.sizes_a), (b, self.sizes_b)))
        return a, b

    def learn(self, pieces: list[str]) -> None:
        """Remembers what each piece comes to: its numbers of A and B tokens and of groups in one number, the text of its groups, and its links; None where the bytes differ."""
        size_b = len(self.bytes_b)
        for low in range(0, len(pieces), 20_000):
            part = pieces[low : low + 20_000]
            for piece, a, b in zip(part, *self._encoded(part), strict=True):
                ends = self.align(a, b)
                if ends is None or b"".join(map(self.bytes_a.__getitem__, a)) != piece.encode():
                    self.memo[piece] = None
                    continue
                said, i, j = "", 0, 0
                for x, y in ends:
                    said += f";{a[i]}|{b[j]}" if x - i == 1 == y - j else ";" + ",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y]))
                    i, j = x, y
                links = [a[x - 1] * size_b + b[y - 1] for x, y in ends]
                self.memo[piece] = len(a) + (len(b) << _SHIFT) + (len(ends) << 2 * _SHIFT), said.encode(), links

    def recall(self, pieces: set[str]) -> list[str]:
        """Has all of the pieces in the memo; returns those that are too long to stay there."""
        if len(self.memo) > _MEMO_LIMIT:
            self.memo, self.older = {}, self.memo
        new = pieces - self.memo.keys()
        for piece in new & self.older.keys():
            self.memo[piece] = self.older[piece]
        fresh = list(new - self.older.keys())
        self.learn(fresh)
        return [p for p in fresh if len(p) > _MEMO_CHARS]


class _Sum:
    """What the pieces of one text come to."""

    def __init__(self) -> None:
        self.total = 0
        self.digest, self.links, self.differs, self.begun = hashlib.sha256(), Counter(), False, False

    @property
    def n(self) -> list[int]:
        return [self.total >> k * _SHIFT & (1 << _SHIFT) - 1 for k in range(3)]

    def add(self, found: list[tuple | None]) -> None:
        if self.differs or None in found:
            self.differs = True
            return
        numbers, texts, links = zip(*found, strict=True)
        self.total += sum(numbers)
        # Every group's text begins with a semicolon; the very first one is left out.
        said = b"".join(texts)
        self.digest.update(said if self.begun else said[1:])
        self.begun = True
        self.links.update(chain.from_iterable(links))


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, n_b, n_groups, groups_sha256, pairs, times) of every row of docs.

    pairs are the distinct pairs that the text links, as A id times the size of B plus B id, and times how
    often it does. row is a number of its own. A text that is null or empty, or whose tokens do not
    give its bytes back, has zeros, no pairs and an empty digest.
    """
    fields = [(key, pa.int64()), *((c, pa.int64()) for c in ("row", "n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners.clear()
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, sums, waiting, held = batch.column(0).to_pylist(), [], [], 0
            first = 0

            def settle() -> None:
                long = aligner.recall(set().union(*(p for _, p in waiting)))
                known = aligner.memo
                for total, pieces in waiting:
                    total.add([known[p] for p in pieces])
                for p in long:
                    del known[p]
                waiting.clear()

            def rows(row: int, first: int) -> pa.RecordBatch:
                out = []
                for doc, total in zip(keys[first : first + len(sums)], sums, strict=True):
                    fine = total.begun and not total.differs
                    links = total.links if fine else {}
                    out.append({key: doc, "row": row, **dict(zip(("n_a", "n_b", "n_groups"), total.n if fine else (0, 0, 0), strict=True)), "groups_sha256": total.digest.hexdigest() if fine else "", "pairs": list(links.keys()), "times": list(links.values())})
                    row += 1
                return pa.RecordBatch.from_pylist(out, schema)

            for value in batch.column(1):
                body = value.as_py()
                sums.append(_Sum())
                if body:
                    for pieces in aligner.cut(" " + body):
                        waiting.append((sums[-1], pieces))
                        held += sum(map(len, pieces))
                        if held >= _BATCH:
                            settle()
                            held = 0
                if len(sums) >= 1000 and not waiting or len(sums) >= 4000:
                    settle()
                    held = 0
                    yield rows(row, first)
                    row, first = row + len(sums), first + len(sums)
                    sums.clear()
            settle()
            if sums:
                yield rows(row, first)
                row += len(sums)

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("_text")).mapInArrow(run, f"`{key}` long, row long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>")


def _added_up(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(pairs, return_inverse=True)
    return found, np.bincount(place, times, minlength=len(found)).astype(np.int64)


def pair_counts(links: DataFrame, size_b: int, flush: int = 2_000_000) -> DataFrame:
    """(pair, count, best) of all pairs of links (pairs, times): how often the corpus links a pair, and whether no pair of its B id is linked more often.

    Each task adds up what it reads before anything is shuffled. A B id has as many pairs as side A has ids at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            p, t = _added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(t)], names=["pair", "count"])

        for batch in batches:
            p, t = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            if len(p):
                held.append(_added_up(p, t))
                n += len(held[-1][0])
            if n >= flush and len(held) > 1:
                found = out()
                if found.num_rows >= flush // 2:  # hardly any repeats: pass them on
                    yield found
                    n = 0
                else:
                    held.append((found.column(0).to_numpy(), found.column(1).to_numpy()))
                    n = found.num_rows
        if held:
            yield out()

    summed = links.select("pairs", "times").mapInArrow(count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    of_b = Window.partitionBy(F.col("pair") % size_b)
    return summed.withColumn("best", F.col("count") == F.max("count").over(of_b))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", broadcast_rows: int = 4_000_000) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs.

    Side A encodes a space and the text, side B the text, before which it sets a space; both take strings of
    special tokens as plain text and add none. Where tokens of both sides end at the same byte, a
    group ends and its last tokens are linked. n_best counts the links whose pair no other pair of
    the same B id exceeds in the corpus, ties included; count_sum adds up the corpus counts of all links.
    groups_sha256 is the digest of the groups as `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and texts whose tokens do not give their bytes back (such as those that hold the space
    mark itself), have zeros and an empty digest and link nothing. Repeated rows and keys are kept and count each time; keys may
    be null; an empty table gives no rows; other columns are ignored. Up to broadcast_rows distinct
    pairs (17 bytes each) are broadcast; more are joined by shuffle. Links are stored in the shared folder between the passes.
    """
    spark = docs.sparkSession
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    links = stored(aligned_rows(docs, path_a, path_b, key, text), "token-links")
    known = checkpointed(pair_counts(links, size_b))
    out = f"`{key}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    own = [key, "n_a", "n_b", "n_groups"]
    if known.count() <= broadcast_rows:
        table = known.toArrow()
        order = np.argsort(pairs := table["pair"].to_numpy())
        shared = spark.sparkContext.broadcast((pairs[order], table["count"].to_numpy()[order], table["best"].to_numpy()[order]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, counts, best = shared.value
            for batch in batches:
                lists = batch.column("pairs")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                times = batch.column("times").flatten().to_numpy().astype(np.int64)
                place = np.searchsorted(index, lists.flatten().to_numpy())
                # Sums of whole numbers: below 2**53 exact in doubles, so each row's own are cut from running sums.
                sums = []
                for each in (times, times * best[place], times * counts[place]):
                    running = np.concatenate(([0], np.cumsum(each)))
                    ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
                    sums.append(running[ends] - running[np.concatenate(([0], ends[:-1]))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *map(pa.array, sums), batch.column("groups_sha256")], names=[*own, "n_links", "n_best", "count_sum", "groups_sha256"])

        return links.mapInArrow(score, out)
    # Both sides come straight from an exchange, so a pair that many texts link can be split.
    single = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = single.join(known, "pair").groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return links.join(sums, "row", "left").select(*own, zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
