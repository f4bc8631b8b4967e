"""Packing tokenised documents into fixed-length sequences: first-fit decreasing over a tournament tree.

A document's ids are cut into full pieces of the sequence length and a rest. There is a group for every `group_docs` documents;
pieces, not documents, are dealt to them by a hash of id, start and ids, so that a long document's pieces go to many groups
and don't swell one. Each group packs its pieces alone: full pieces fill sequences of their
own, rests go, longest first, to the leftmost sequence with room, found by descending a tournament tree whose inner
nodes hold the most room below them (log n steps a piece). Sequence ids carry their group, so groups never meet.

Tokens never leave the task that made them; only one small row a piece is shuffled. Groups are random, so copies and hot
sources spread evenly.

Defined results for odd input: a null text is empty, an empty text is the one end id, a long text is any number of
pieces, repeated rows are separate documents, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, released, ship, texts

END_ID = 0
SPECIAL = "<|endoftext|>"
_encoders: dict = {}


def encoder(vocabulary: str):
    """`text -> ids` for a byte-level BPE of the public tokenizers; the ranks file gives the ids of the JSON file, faster.

    The JSON file reads its special token's string in a text as that token; such texts take that way.
    """
    if vocabulary not in _encoders:
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(public.path(f"{vocabulary}.json"))

        def encode(text: str) -> np.ndarray:
            ids = exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)
            return np.array([*ids, END_ID], dtype="<u4")

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _pieces(length: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids_of, column = batch.column(0).to_pylist(), batch.column(1)
            for part in bounded(column):
                out = []
                for doc, raw in zip(ids_of[part], texts(column[part])):
                    ids = encode(raw.decode())
                    out += [(doc, a, len(x := ids[a : a + length]), zlib.crc32(x.tobytes()), len(ids)) for a in range(0, len(ids), length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PIECES.types)], schema=PIECES)

    return run


class Tournament:
    """Bins numbered from 0, all empty at first; `place` gives the leftmost bin with room."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < size:
                i += 1
        bin_ = i - self.leaves
        most[i] -= size
        while i > 1:
            i //= 2
            a, b = most[2 * i], most[2 * i + 1]
            most[i] = a if a >= b else b
        return bin_


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's bin and its offset there. Pieces are in their final order of ties."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int((lengths == room).sum())
    bins[order[:full]] = np.arange(full)
    tree, used = Tournament(len(lengths) - full, room), [0] * (len(lengths) - full)
    for i in order[full:].tolist():
        size = int(lengths[i])
        b = tree.place(size)
        bins[i], offsets[i] = full + b, used[b]
        used[b] += size
    return bins, offsets


PACKED = "none boolean, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_group(length: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["none", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, rows["offset"] = first_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        return rows[["none", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 1024,
    vocabulary: str = "byte_bpe_50k",
    group_docs: int = 1024,
    seed: int = 5,
) -> DataFrame:
    """One row per piece: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`."""
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(released(_pieces(length, vocabulary)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))
    dealt = dealt.withColumns({"none": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})  # pandas has no null integers
    packed = dealt.groupBy("pack_group").applyInPandas(_pack_group(length), PACKED)
    return packed.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
