"""Parquet and JDBC tables, bulk loads, views, SQL functions and what is refused by name."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, Refused
from ..model import Table, introspect


def parquet(spark: SparkSession, path: str, table: Table | None = None) -> DataFrame:
    """A Parquet table; with a model only its stored columns, so that the scan reads no others."""
    df = spark.read.parquet(path)
    return df.select(*[c.name for c in table.columns if not c.source]) if table else df


def jdbc_options(url: str, table: str, *, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options) -> dict[str, str]:
    """What Spark's JDBC reader is told; `bounds` only deal rows to the ranges, no row is left out."""
    out = {"url": url, "dbtable": table} | {k: str(v) for k, v in options.items()}
    if (partition_column is None) != (bounds is None):
        raise QueryError("a partition column and its bounds go together")
    if partition_column:
        low, high = bounds
        if partitions < 1 or low > high:
            raise QueryError("a parallel read takes a partition or more, and bounds in order")
        out |= {"partitionColumn": partition_column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return out


def jdbc(spark: SparkSession, url: str, table: str, **how) -> DataFrame:
    """A table of another database, read in parallel ranges of a column. The database's driver jar has to be on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **how)).load()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the folder of `spark.checkpoint.dir`, which all executors see; a local session without one gets its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise QueryError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A bulk load into a Parquet table."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def sql_function(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A stored function as an SQL expression, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def aggregate_function(spark: SparkSession, name: str, returns: str, fold: Callable) -> None:
    """An aggregate of one's own: `fold` gets a group's values as a pandas series. A group has to fit a task; built-in aggregates have no such bound."""

    def folded(values):
        return fold(values)

    folded.__annotations__ = {"values": pd.Series, "return": float}  # a series to one value: an aggregate
    spark.udf.register(name, F.pandas_udf(folded, returns))


def table_function(spark: SparkSession, name: str, returns: str, make: type) -> None:
    """A table function of one's own: `make().eval(*arguments)` yields tuples of the columns in `returns`. Use it with LATERAL for rows of a table."""
    spark.udtf.register(name, F.udtf(make, returnType=returns))


def describe(spark: SparkSession, path: str, name: str) -> Table:
    return introspect(name, spark.read.parquet(path))


def sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows and files of Parquet tables."""
    parts = [spark.read.parquet(p).select(F.lit(n).alias("name"), F.input_file_name().alias("file")) for n, p in paths.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").alias("n_files"))


def lock_tables(*_):
    raise Refused("table locks: Spark has none")


def advisory_lock(*_):
    raise Refused("advisory locks: Spark has none")


def sessions(*_):
    raise Refused("server sessions: a Spark application has no database server")


def trigger(*_):
    raise Refused("triggers: Spark runs nothing on a write; call the function where the write is made")


def transaction(*_):
    raise Refused("transactions: commit the new states of several tables together with writes.Store instead")


def document_store(*_):
    raise Refused("a document store is read through its own Spark connector")
