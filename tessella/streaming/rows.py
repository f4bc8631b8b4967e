"""Hooks around statements, and windowed counts over a stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Hooks:
    """Callbacks before and after each named action; `after` gets the seconds and the error, if any. `calls` counts them."""

    def __init__(self):
        self.before: list[Callable[[str], None]] = []
        self.after: list[Callable[[str, float, BaseException | None], None]] = []
        self.calls = 0

    @contextmanager
    def around(self, name: str) -> Iterator[None]:
        for fn in self.before:
            fn(name)
        self.calls += 1
        start, error = time.monotonic(), None
        try:
            yield
        except BaseException as e:
            error = e
            raise
        finally:
            for fn in self.after:
                fn(name, time.monotonic() - start, error)


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, by: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and value; on a stream, rows later than `late` are left out and old state is dropped."""
    zoned = events.withColumn("at__", F.col(at).cast("timestamp"))
    marked = zoned.withWatermark("at__", late) if events.isStreaming else zoned
    counts = marked.groupBy(F.window("at__", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n")
