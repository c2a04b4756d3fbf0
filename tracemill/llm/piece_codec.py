"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Pieces are merged from an agenda of adjacent symbol pairs, best score first and leftmost among
equals. No piece of the vocabulary spans the place before a space mark or next to a byte that has
only its byte piece, so a text falls into segments that are merged apart and remembered. Each new
segment of an Arrow batch is held against the sentencepiece library, its ids and what they decode to,
before they are used; a text with a segment on which the two differ takes the library's result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

_MARK = "▁"
_MEMO_LIMIT = 250_000  # segments in each of two generations
_MEMO_CHARS = 64  # of a segment that is remembered for other batches; longer ones are merged again
_SHORT = 40  # characters of a segment whose agenda is a plain list
_codecs: dict[str, PieceCodec] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size


def check_model(raw: bytes) -> None:
    """Raises unless a model file is of merge type, without a normaliser's character map and with its spaces kept as they are."""
    kind, rules = 1, {}
    for number, value in _fields(raw):
        if number == 2:  # the trainer's settings: 3 is the type, 1 unless given
            kind = dict(_fields(value)).get(3, 1)
        if number == 3:  # the normaliser's: 2 its character map, 3 a space before the text, 4 spaces removed, 5 spaces as marks
            rules = dict(_fields(value))
    if kind != 2:
        raise ValueError(f"the model is of type {kind}, not of merge type (2)")
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("the model normalises its texts, which the agenda does not")


class PieceCodec:
    """Encodes and decodes with the pieces and scores of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            check_model(f.read())
        self.lib = SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        ids = range(n)
        self.pieces = [self.lib.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (self.lib.is_control(i) or self.lib.is_byte(i) or self.lib.is_unknown(i) or self.lib.is_unused(i))]
        self.rank = {self.pieces[i]: (-self.lib.get_score(i), i) for i in plain}
        self.cost = {s: c for s, (c, _) in self.rank.items()}
        self.byte_ids = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.skipped = {i for i in ids if self.lib.is_control(i)}
        self.unknown = self.lib.unk_id()
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in self.rank):
            raise ValueError("this vocabulary has pieces that span a space")
        self.newline_alone = not any("\n" in p for p in self.rank)
        self.cut = re.compile(f"\n|{_MARK}+[^{_MARK}\n]*|[^{_MARK}\n]+" if self.newline_alone else f"{_MARK}+[^{_MARK}]*|[^{_MARK}]+")
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}  # ids of a segment, little-endian, and what they decode to; None where the library differs
        self.older: dict[str, tuple[bytes, bytes] | None] = {}  # the generation before; what is met again moves to the new one
        self.surfaces = [self._surface(i) for i in ids]
        self.mark = self.lib.piece_to_id(_MARK)

    def merge(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment, by the agenda."""
        if len(segment) <= _SHORT:
            return self._merge_short(segment)
        rank = self.rank
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if found := rank.get(pair):
                agenda.append((found[0], i, pair, i + 1))
        heapify(agenda)
        while agenda:
            _, i, pair, j = heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or len(a) + len(b) != len(pair) or right[i] != j:
                continue  # one side has been merged since
            symbols[i], symbols[j] = pair, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                grown = pair + symbols[k]
                if found := rank.get(grown):
                    heappush(agenda, (found[0], i, grown, k))
            h = left[i]
            if h >= 0:
                grown = symbols[h] + pair
                if found := rank.get(grown):
                    heappush(agenda, (found[0], h, grown, i))
        return self._ids([s for s in symbols if s is not None])

    def _merge_short(self, segment: str) -> tuple[int, ...]:
        """merge() with the agenda as a plain list in the order of the text: the least entry, and the leftmost of equal ones, is next."""
        cost, never = self.cost.get, float("inf")
        symbols = list(segment)
        agenda = [cost(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], never)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], never)
        return self._ids(symbols)

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        rank = self.rank
        try:
            return tuple([rank[s][1] for s in symbols])
        except KeyError:
            return tuple(i for s in symbols for i in ((rank[s][1],) if s in rank else map(self.byte_ids.__getitem__, s.encode())))

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(_MARK + text.replace(" ", _MARK)) if text else []

    def learn(self, new: list[str]) -> None:
        """Merges new segments and holds every one of them against the library, both ways."""
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            # The library puts a space mark first: it stands for the segment's own, or else a newline
            # that is a piece of its own is put between.
            asked = [s[1:].replace(_MARK, " ") if s[0] == _MARK else "\n" + s for s in part]
            wants = [tuple(w) if s[0] == _MARK else tuple(w[2:]) for s, w in zip(part, self.lib.encode(asked, num_threads=1), strict=True)]
            all_ids = [self.merge(s) for s in part]
            surfaces = [b"".join(map(self.surfaces.__getitem__, ids)) for ids in all_ids]
            decoded = self._decoded_alike(all_ids, surfaces)
            for s, want, ids, surface, same in zip(part, wants, all_ids, surfaces, decoded, strict=True):
                if s == _MARK:  # the library gives an empty text nothing
                    want = (self.mark,)
                self.memo[s] = (array("I", ids).tobytes(), surface) if same and want == ids else None

    def _decoded_alike(self, all_ids: list[tuple[int, ...]], surfaces: list[bytes]) -> list[bool]:
        """Whether the library decodes each segment to its surface; all at once, and one by one only if that differs."""
        # In front of a segment's ids, a mark's id takes the place of the first space that decoding drops.
        if self.lib.decode([self.mark, *(i for ids in all_ids for i in ids)]) == b"".join(surfaces).decode("utf-8", "replace"):
            return [True] * len(surfaces)
        return [self.lib.decode([self.mark, *ids]) == x.decode("utf-8", "replace") for ids, x in zip(all_ids, surfaces, strict=True)]

    def round_trip(self, texts: list[str]) -> tuple[list[bytes], list[str], list[bool]]:
        """For each whole text its ids, begin and end included, as little-endian unsigned 32-bit integers, what they decode to, and whether the agenda gave them; else the library did."""
        cut = [self.segments(t) for t in texts]
        if len(self.memo) > _MEMO_LIMIT:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        every = set().union(*cut)
        missing = every - memo.keys()
        met = missing & older.keys()
        memo.update((s, older[s]) for s in met)
        self.learn(list(missing - met))
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        out, decoded, own = [], [], []
        for t, c in zip(texts, cut, strict=True):
            parts = [memo[s] for s in c]
            own.append(None not in parts)
            if own[-1]:
                out.append(b"".join((begin, *(p[0] for p in parts), end)))
                text = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
                decoded.append(text[1:] if text[:1] == " " else text)
            else:
                ids = self.lib.encode(t, add_bos=True, add_eos=True)
                out.append(np.array(ids, "<u4").tobytes())
                decoded.append(self.lib.decode(ids))
        for s in [s for s in missing if len(s) > _MEMO_CHARS]:
            memo.pop(s, None)
        return out, decoded, own

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.round_trip(texts)[0]

    def forget(self) -> None:
        """Drops what is remembered, so that a worker that is kept for other tasks holds no memory for this one."""
        self.memo, self.older = {}, {}

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids give nothing, byte ids their bytes, the first space mark is dropped."""
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if i not in self.skipped), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(_MARK) else text

    def _surface(self, i: int) -> bytes:
        if i in self.byte_of:
            return bytes((self.byte_of[i],))
        if i in self.skipped:
            return b""
        return (" ⁇ " if i == self.unknown else self.pieces[i].replace(_MARK, " ")).encode()


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def piece_round_trip(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, with_text: bool = False, max_chars: int = 1 << 20) -> DataFrame:
    """key, n_tokens (with begin and end), ids_sha256, decoded_sha256 and by_agenda of every row; with_text adds ids and decoded.

    `keep` names other columns to carry. Nulls and empty texts have the begin and end ids alone and
    decode to nothing; repeated rows are kept; other columns are ignored; an empty table gives no
    rows. Long texts are taken whole. Where
    the agenda and the library differ on a segment of a text, the row has the library's result and by_agenda false.
    A model that is not of merge type, or that normalises, raises.
    """
    kept = [key, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            column, at, n = batch.column("_text"), 0, batch.num_rows
            while at < n:
                part, size = [], 0
                while at + len(part) < n and (not part or size < max_chars):
                    t = column[at + len(part)].as_py()
                    part.append(t)
                    size += len(t)
                packed, decoded, own = c.round_trip(part)
                out = [
                    *(batch.column(k).slice(at, len(part)) for k in kept),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array(own, pa.bool_()),
                ]
                if with_text:
                    bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
                    out += [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(packed), "<i4"))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256", "by_agenda", *(["ids", "decoded"] if with_text else [])])
                at += len(part)
        c.forget()

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in kept) + ", n_tokens long, ids_sha256 string, decoded_sha256 string, by_agenda boolean" + (", ids array<int>, decoded string" if with_text else "")
    return docs.select(*kept, text_or_empty(text).alias("_text")).mapInArrow(run, schema)
