"""Results kept in Spark's memory by plan and scope, and dropped by tag."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class ResultCache:
    """`get` computes a result once per key until its time is over or one of its tags is invalidated.

    Results stay distributed: they are persisted DataFrames, spilled to disk by Spark when memory is short.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.held: dict[tuple, tuple[DataFrame, float, frozenset[str]]] = {}

    @staticmethod
    def key(df: DataFrame, scope: str = "") -> tuple:
        return scope, df.semanticHash()

    def get(self, df: DataFrame, *, ttl: float = 60.0, tags: tuple[str, ...] = (), scope: str = "") -> DataFrame:
        k = self.key(df, scope)
        hit = self.held.get(k)
        if hit and hit[1] > self.clock() and hit[0].sameSemantics(df):
            return hit[0]
        if hit:
            hit[0].unpersist()
        df = df.persist()
        self.held[k] = (df, self.clock() + ttl, frozenset(tags))
        return df

    def invalidate(self, *tags: str) -> int:
        gone = [k for k, (_, _, t) in self.held.items() if t & set(tags)]
        for k in gone:
            self.held.pop(k)[0].unpersist()
        return len(gone)
