"""Token counts behind a cache of content digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file.
Counts that the cache has are joined; of the rest each distinct content is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, delete, fresh_path, text_or_empty

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
#: Before a single space with a non-space on either side, no token goes on.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"\s\s|^\s|\s$|\x01")
_MEMO_LIMIT = 600_000  # pieces
_MEMO_CHARS = 48  # of a piece that is remembered for other batches; longer ones are encoded again
_state: dict = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _load(path: str):
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        # Pieces are counted apart only where the file's rules keep them apart: no normaliser, and the
        # byte-level pattern, in which a single space between two non-spaces always opens a token.
        import json

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        apart = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        _state.update(path=path, tok=tok, memo={}, apart=apart, added=[x["content"] for x in conf.get("added_tokens", [])])
    return _state


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of whole texts as the tokenizers library counts them, without added special tokens.

    Texts are cut at single spaces and each distinct piece is encoded by the library once while it
    is remembered. A text that holds one of the file's added tokens is encoded whole.
    """
    s = _load(path)
    if not s["apart"]:
        return [len(x) for x in s["tok"].encode_batch_fast(texts, add_special_tokens=False)]
    memo: dict[str, int] = s["memo"]
    cut: list[list[str] | None] = []
    for t in texts:
        if any(a in t for a in s["added"]):
            cut.append(None)
            continue
        cut.append(_CUT.split(t) if _ODD.search(t) else t.replace(" ", "\x01 ").split("\x01"))
    if len(memo) > _MEMO_LIMIT:
        memo.clear()
    missing = list(set().union(*(p for p in cut if p is not None)) - memo.keys())
    for at in range(0, len(missing), 50_000):
        part = missing[at : at + 50_000]
        memo.update(zip(part, map(len, s["tok"].encode_batch_fast(part, add_special_tokens=False)), strict=True))
    out = []
    for t, p in zip(texts, cut, strict=True):
        if p is None:
            out.append(len(s["tok"].encode(t, add_special_tokens=False)))
        else:
            out.append(sum(map(memo.__getitem__, p)))
    for piece in missing:
        if len(piece) > _MEMO_CHARS:
            del memo[piece]
    return out


def encode_counts(texts: DataFrame, path: str, keep: list[str], text: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """`keep` columns of texts and n_tokens, in Arrow batches cut to about max_bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            at, n = 0, batch.num_rows
            while at < n:
                part, size = [], 0
                while at + len(part) < n and (not part or size < max_bytes):
                    t = column[at + len(part)].as_py() or ""
                    part.append(t)
                    size += len(t)
                counts = count_tokens(part, path)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in keep), pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])
                at += len(part)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keep)
    return texts.select(*keep, text).mapInArrow(run, f"{schema}, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    cache_path is a Parquet table of CACHE_SCHEMA that is read, appended to, and may not exist yet;
    without one a new table in the shared folder is used and deleted again. Of rows that the cache repeats, as after two
    writers at once, one counts. Nulls count as empty texts and have 0
    tokens; repeated rows and keys are kept; other columns are ignored; an empty table gives no rows
    and appends none.
    """
    spark = docs.sparkSession
    own_path, cache_path = cache_path is None, cache_path or fresh_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    body = text_or_empty(text)
    keyed = docs.select(F.col(key).alias(key), F.unhex(F.sha2(body, 256)).alias("content"), F.octet_length(body).cast("long").alias("n_bytes"))
    contents = docs.select(F.unhex(F.sha2(body, 256)).alias("content"), body.alias("text"))

    def cached() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        contents = contents.join(cached(), "content", "left_anti")
    # first() combines on the map side, so a content that fills a third of the rows moves once a task.
    missed = contents.groupBy("content").agg(F.first("text").alias("text"))
    encoded = encode_counts(missed, tokenizer_path, ["content"])
    encoded.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # Stored, so that the join deals out both sides anew and can split a content that many rows have.
    known = checkpointed(cached())
    if own_path:
        delete(spark, cache_path)
    return keyed.join(known, "content").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
