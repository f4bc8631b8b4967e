"""Which shard holds a key: jump hash, modulo and table locators, and reads bound to a shard or spread over all.

Keys are 64-bit integers, texts or 16-byte UUIDs; a kind's tag is hashed with the key, so 1 and '1' are different keys. The
placement is a column expression, so routing a table is a projection; Spark merges across shards, so reads of all shards keep
their global order and limits. A null key has no shard: its place is null in a column and an error for a single key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError

# The published FNV-1a hash of 64 bits, the tags of the kinds of keys, and the generator of the published jump hash.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
TEXT, INTEGER, UUID = 1, 2, 3
JUMP = 2862933555777941757
# Fixed values end.


def _fold(h: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return (h ^ np.asarray(byte, np.uint64)) * np.uint64(FNV_PRIME)


def _hash_rows(matrix: np.ndarray, lengths: np.ndarray, tag: int) -> np.ndarray:
    """FNV-1a of the tag and each row's first `lengths` bytes, one byte of all rows at a time."""
    h = _fold(np.full(len(lengths), FNV_OFFSET, np.uint64), tag)
    for i in range(matrix.shape[1]):
        h = np.where(i < lengths, _fold(h, matrix[:, i]), h)
    return h


def hash_keys(keys: pa.Array) -> np.ndarray:
    """The hash of each key; what stands for a null is of no meaning."""
    if pa.types.is_integer(keys.type):
        values = keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        return _hash_rows(values.view(np.uint8).reshape(-1, 8), np.full(len(values), 8), INTEGER)
    given = [b"" if x is None else x for x in keys.cast(pa.binary()).to_pylist()]
    lengths = np.array([len(x) for x in given], np.int64)
    width = int(lengths.max(initial=0))
    matrix = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in given), np.uint8).reshape(len(given), width)
    return _hash_rows(matrix, lengths, TEXT if pa.types.is_string(keys.type) or pa.types.is_large_string(keys.type) else UUID)


def jump_rows(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash: growing by one shard moves keys only into the new one. All keys jump together until each has landed."""
    k, landed, ahead = hashes.copy(), np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    while len(on := np.flatnonzero(ahead < shards)):
        landed[on] = ahead[on]
        k[on] = k[on] * np.uint64(JUMP) + np.uint64(1)
        ahead[on] = ((landed[on] + 1) * (float(1 << 31) / ((k[on] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return landed


class Locator:
    """Places keys over `n` shards, numbered from 0."""

    def __init__(self, n: int):
        if n < 1:
            raise QueryError("a locator needs a shard or more")
        self.n = n

    def place(self, hashes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def locate(self, key: int | str | uuid.UUID) -> int:
        if key is None:
            raise QueryError("a null key has no shard")
        one = pa.array([key.bytes], pa.binary()) if isinstance(key, uuid.UUID) else pa.array([key], pa.string() if isinstance(key, str) else pa.int64())
        return int(self.place(hash_keys(one))[0])

    def column(self, key: Column) -> Column:
        """Each row's shard. The products wrap at 64 bits, which SQL arithmetic refuses; so it runs in numpy over Arrow batches."""
        place = self.place

        @F.arrow_udf("int")
        def placed(keys: pa.Array) -> pa.Array:
            return pa.array(place(hash_keys(keys)).astype(np.int32), mask=keys.is_null().to_numpy(zero_copy_only=False))

        return placed(key)


class Jump(Locator):
    def place(self, hashes: np.ndarray) -> np.ndarray:
        return jump_rows(hashes, self.n)


class Modulo(Locator):
    def place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.n)).astype(np.int64)


class Lookup:
    """Keys by a table of their own: a key that is not in it is an error, and null in a column."""

    def __init__(self, n: int, to: dict):
        if n < 1 or any(not 0 <= s < n for s in to.values()):
            raise QueryError(f"a lookup over {n} shards names one that is not there")
        if any(k is None for k in to):
            raise QueryError("a null key has no shard")
        self.n, self.to = n, dict(to)

    def locate(self, key) -> int:
        if key not in self.to:
            raise QueryError(f"no shard holds {key!r}")
        return self.to[key]

    def column(self, key: Column) -> Column:
        pairs = [F.lit(x) for k, s in self.to.items() for x in (k, s)]
        return F.try_element_at(F.create_map(*pairs), key).cast("int") if pairs else F.lit(None).cast("int")


def modulo(key: Column, shards: int) -> Column:
    """The key's own residue, unhashed."""
    return F.pmod(key, F.lit(shards)).cast("int")


class TableLocator:
    """Keys in explicit ranges: the shard of the largest start that is no larger than the key."""

    def __init__(self, starts: list[tuple[int, str]]):
        self.starts = sorted(starts)
        if not self.starts:
            raise QueryError("a table locator needs a range")

    def locate(self, key: int) -> str:
        found = [s for start, s in self.starts if start <= key]
        if not found:
            raise QueryError(f"no shard holds {key}")
        return found[-1]


class ShardSet:
    """Shards by name, each with a reader of its tables. A locator that numbers shards must number as many as there are."""

    def __init__(self, shards: dict[str, Callable[[SparkSession, str], DataFrame]], locate: Callable | Locator | Lookup):
        if not shards:
            raise QueryError("a set needs a shard or more")
        n = getattr(locate, "n", None)
        if n is not None and n != len(shards):
            raise QueryError(f"the locator places keys over {n} shards; the set has {len(shards)}")
        names = list(shards)
        self.shards = shards
        self.locate = locate if n is None else lambda key: names[locate.locate(key)]

    def for_key(self, spark: SparkSession, table: str, key) -> DataFrame:
        return self.for_id(spark, table, self.locate(key))

    def for_id(self, spark: SparkSession, table: str, shard: str) -> DataFrame:
        if shard not in self.shards:
            raise QueryError(f"no shard {shard}")
        return self.shards[shard](spark, table)

    def each(self, spark: SparkSession, table: str) -> DataFrame:
        """All shards' rows with their shard's name."""
        return reduce(lambda a, b: a.unionByName(b), [read(spark, table).withColumn("shard", F.lit(n)) for n, read in self.shards.items()])
