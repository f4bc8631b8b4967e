"""Sharding by k-d tree partitioning over document metadata.

The tree splits a node of documents at the weighted median (by bytes) along its widest metadata dimension, and
its halves again, until as many leaves are left as shards are wanted or until a leaf reaches the target bytes.
Each level finds all its medians at once and exactly, by distributed histograms: the documents of a node are
counted into at most 4,096 buckets of the sort key's current range, the bucket that holds the median is opened
in the next round, and a round costs one small aggregation. The nodes and their searches are tables of their own, a row a node, that Spark
narrows and joins; the driver sees no node, only whether any search is still open, so leaves may be as many as the data ask for.

Sort key along a dimension: its value, then a hash of the text, then a hash of the row. Equal texts are
neighbours in that order, and a cut moves to the edge of a group of equal texts when that costs at most
`tolerance` of a leaf, so such groups stay together; a group too heavy for that is split by the row hash.

Defined results for odd input: a null text has size 1 and CRC 0, null metadata counts as 0, empty tables give no
rows, rows equal in every column are told apart by a salt (any of them may have either place), and columns of the input with the
operator's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FANOUT_BITS = 12
#: A leaf may miss its exact share by this part of a leaf when that keeps equal texts together or saves rounds.
TOLERANCE = 0.004
#: Above every key.
AFTER_ALL = 2**62
#: The low bits of a row's hash, which tell equal rows apart.
SALT = 2**16 - 1


def _value(n_dims: int) -> Column:
    """A row's value along its node's dimension."""
    return F.element_at(F.array(*[F.col(f"kd_d{i}") for i in range(n_dims)]), F.coalesce(F.col("dim"), F.lit(0)) + 1)


def _narrowed(rows: DataFrame, searches: DataFrame, n_dims: int) -> DataFrame:
    """One round: every open search has its place `(cv, ch, cr)`, or a narrower range `lo` to `hi`.

    Keys are the value (stage 0), among rows of one value the text's hash (1), among those of one text the row's hash (2); `f0`, `f1` are the
    value and hash already fixed, and `left` the bytes before the range.
    """
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - FANOUT_BITS)
    buckets = (
        rows.join(searches.where("cv IS NULL").withColumn("sh", shift), "kd_node")
        .withColumn("v", _value(n_dims))
        .withColumn("k", F.when(F.col("stage") == 0, F.col("v")).when(F.col("stage") == 1, F.col("kd_h")).otherwise(F.col("kd_r")))
        .where((F.col("stage") < 1) | (F.col("v") == F.col("f0")))
        .where((F.col("stage") < 2) | (F.col("kd_h") == F.col("f1")))
        .where((F.col("k") >= F.col("lo")) & (F.col("k") <= F.col("hi")))
        .withColumn("b", F.expr("shiftright(k - lo, sh)"))
        .groupBy("kd_node", "b")
        .agg(F.sum("kd_size").alias("w"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.first("goal").alias("goal"), F.first("left").alias("left"))
    )
    # a node has at most 2^FANOUT_BITS buckets
    ahead = Window.partitionBy("kd_node").orderBy("b")
    bucket = F.struct("w", "k0", "k1", "before", "prior")
    found = (
        buckets.withColumn("before", F.col("left") + F.coalesce(F.sum("w").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("prior", F.lag("k1").over(ahead))
        .groupBy("kd_node")
        .agg(F.coalesce(F.min_by(F.when(F.col("before") + F.col("w") >= F.col("goal"), bucket), F.when(F.col("before") + F.col("w") >= F.col("goal"), F.col("b"))), F.max_by(bucket, F.col("b"))).alias("x"))
        .select("kd_node", "x.*")
    )
    low_off, high_off = F.col("goal") - F.col("before"), F.col("before") + F.col("w") - F.col("goal")
    one = F.col("k0") == F.col("k1")
    settled = (F.least(low_off, high_off) <= F.col("slack")) | ((F.col("stage") == 2) & one)
    key = F.when((low_off <= high_off) & (F.col("before") > 0), F.coalesce(F.col("prior"), F.col("lo") - 1)).otherwise(F.col("k1"))
    here = F.col("w").isNotNull()  # searches that are over have no bucket
    done, open_, deeper = here & settled, here & ~settled & ~one, here & ~settled & one
    at = lambda stage, fixed: F.when(done, F.when(F.col("stage") == stage, key).when(F.col("stage") > stage, fixed).otherwise(AFTER_ALL))
    new = {
        "cv": F.coalesce("cv", at(0, F.col("f0"))),
        "ch": F.coalesce("ch", at(1, F.col("f1"))),
        "cr": F.coalesce("cr", at(2, F.lit(None))),
        "f0": F.when(deeper & (F.col("stage") == 0), F.col("k0")).otherwise(F.col("f0")),
        "f1": F.when(deeper & (F.col("stage") == 1), F.col("k0")).otherwise(F.col("f1")),
        "lo": F.when(open_, F.col("k0")).when(deeper, 0).otherwise(F.col("lo")),
        "hi": F.when(open_, F.col("k1")).when(deeper, AFTER_ALL - 1).otherwise(F.col("hi")),
        "left": F.when(open_ | deeper, F.col("before")).otherwise(F.col("left")),
        "stage": F.when(deeper, F.col("stage") + 1).otherwise(F.col("stage")),
    }
    return searches.join(found, "kd_node", "left").select("kd_node", "dim", "goal", "slack", *[x.alias(c) for c, x in new.items()])


def grow(rows: DataFrame, n_dims: int, n_leaves: int, target_bytes: int | None, tolerance: float) -> DataFrame:
    """`rows` with `kd_node`, their leaf of the tree. Node 1 is the root; n's halves are 2n and 2n + 1.

    `rows` has `kd_size`, `kd_h`, `kd_r` and `kd_d0..`. A leaf is a node of one shard (`n_leaves`, any power of two)
    or, with `target_bytes`, a node of no more bytes than that.
    """
    spread = [f(f"kd_d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]
    placed = rows.withColumn("kd_node", F.lit(1).cast("long"))
    root = rows.agg(F.sum("kd_size").alias("w"), *spread).first()
    if root["w"] is None:
        return placed
    leaf = target_bytes or root["w"] / n_leaves
    whole = [max(1, root[f"hi{i}"] - root[f"lo{i}"]) for i in range(n_dims)]
    level = 0
    while target_bytes is not None or 2**level < n_leaves:
        facts = placed.where(F.col("kd_node") >= 2**level).groupBy("kd_node").agg(F.sum("kd_size").alias("w"), F.count(F.lit(1)).alias("n"), *spread)
        facts = facts.where("n > 1" if target_bytes is None else f"n > 1 AND w > {int(target_bytes)}")
        widest = F.array_max(F.array(*[F.struct(((F.col(f"hi{i}") - F.col(f"lo{i}")) / whole[i]).alias("r"), F.lit(-i).alias("i")) for i in range(n_dims)]))["i"]
        of = lambda c: F.element_at(F.array(*[F.col(f"{c}{i}") for i in range(n_dims)]), F.col("dim") + 1)
        none = F.lit(None).cast("long")
        searches = facts.withColumn("dim", -widest).select(
            "kd_node", "dim", (F.col("w") / 2).alias("goal"), F.lit(float(tolerance * leaf)).alias("slack"), *[none.alias(c) for c in ("cv", "ch", "cr", "f0", "f1")],
            of("lo").alias("lo"), of("hi").alias("hi"), F.lit(0).cast("long").alias("left"), F.lit(0).alias("stage"),
        )
        searches = materialise(searches, "kd-search")
        if searches.isEmpty():
            break
        while not searches.where("cv IS NULL").isEmpty():
            searches = materialise(_narrowed(placed, searches, n_dims), "kd-search")
        placed = materialise(_descend(placed, searches.select("kd_node", "dim", "cv", "ch", "cr"), n_dims), "kd-placed")
        level += 1
    return placed


def _descend(placed: DataFrame, cuts: DataFrame, n_dims: int) -> DataFrame:
    value = _value(n_dims)
    right = (value > F.col("cv")) | (
        (value == F.col("cv")) & ((F.col("kd_h") > F.col("ch")) | ((F.col("kd_h") == F.col("ch")) & (F.col("kd_r") > F.col("cr"))))
    )
    node = F.when(F.col("dim").isNull(), F.col("kd_node")).otherwise(F.col("kd_node") * 2 + right.cast("long"))
    return placed.join(cuts, "kd_node", "left").withColumn("kd_node", node).drop("dim", "cv", "ch", "cr")


def numbered_leaves(placed: DataFrame) -> DataFrame:
    """`(kd_node, shard)`: the leaves from left to right. One window over a row a leaf, as many as there are shards."""
    leaves = placed.select("kd_node").distinct()
    left_edge = F.expr("shiftleft(kd_node, 62 - length(bin(kd_node)))")
    return leaves.select("kd_node", (F.row_number().over(Window.orderBy(left_edge)) - 1).cast("int").alias("shard"))


def slots(rows: DataFrame, shard: str, order: list[Column], per_task: int = 1_000) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard, without sorting a shard in one task.

    Rows of a shard are dealt by hash into pieces of about `per_task` rows (at most 65,536 pieces in all), numbered in
    their piece, and moved up by the rows of the pieces before it.
    """
    total = rows.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("s")).first()
    pieces = max(1, min((total["n"] or 0) // per_task, 65_536 // max(1, total["s"])))
    rows = rows.withColumn("kd_piece", F.pmod(F.col("kd_r"), F.lit(pieces)))
    counts = rows.groupBy(shard, "kd_piece").agg(F.count(F.lit(1)).alias("kd_n"))
    ahead = Window.partitionBy(shard).orderBy("kd_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("kd_before", F.coalesce(F.sum("kd_n").over(ahead), F.lit(0))).drop("kd_n")
    w = Window.partitionBy(shard, "kd_piece").orderBy(*order)
    numbered = rows.withColumn("kd_row", F.row_number().over(w) - 1)
    return (
        numbered.join(counts, [shard, "kd_piece"])
        .withColumn("slot", (F.col("kd_row") + F.col("kd_before")).cast("long"))
        .drop("kd_row", "kd_before", "kd_piece")
    )


def shard(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = ("n_chars", "lang"),
    n_shards: int = 16,
    target_bytes: int | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """`doc_id, size, text_crc32, shard, slot` for every row: a k-d tree over `dimensions` (numbers as they are, other types by CRC-32) and the size.

    `n_shards` is a power of two, up to 4,096; with `target_bytes` the leaves are counted by that instead. Sizes of the
    shards differ by no more than a document or `tolerance` of a shard a level. The texts are read once, to 40 bytes of metadata
    a row; all rounds run over that table.
    """
    if target_bytes is None and (n_shards & (n_shards - 1) or not 1 <= n_shards <= 4096):
        raise ValueError("n_shards is a power of two from 1 to 4096")
    meta, n_dims = metadata(docs, doc_id=doc_id, text=text, dimensions=dimensions)
    placed = grow(materialise(meta, "kd-meta"), n_dims, n_shards, target_bytes, tolerance)
    placed = placed.join(materialise(numbered_leaves(placed), "kd-leaves"), "kd_node")
    return slots(placed, "shard", [F.col("kd_h"), F.col("doc_id"), F.col("kd_r")]).select(
        "doc_id", F.col("kd_size").alias("size"), "text_crc32", "shard", "slot"
    )


def metadata(docs: DataFrame, *, doc_id: str, text: str, dimensions: tuple[str, ...]) -> tuple[DataFrame, int]:
    """What the tree looks at, without the texts, and the number of dimensions: size first, then `dimensions`."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = dict(docs.dtypes)

    def number(c: str) -> Column:
        x = F.col(c)
        if kinds[c] in ("tinyint", "smallint", "int", "bigint"):
            return F.coalesce(x.cast("long"), F.lit(0))
        return F.coalesce(F.crc32(x.cast("string").cast("binary")), F.lit(0))

    dims = [(F.octet_length(body) + 1).cast("long"), *[number(c) for c in dimensions]]
    positive = F.lit(2**62 - 1)
    others = [F.col(c) for c in docs.columns if c not in (doc_id, text) and not kinds[c].startswith(("map", "variant"))]
    row = F.xxhash64(F.col(doc_id), body, *others).bitwiseAND(positive - SALT)
    meta = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("kd_size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).bitwiseAND(positive).alias("kd_h"),
        row.bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(SALT))).alias("kd_r"),
        *[d.alias(f"kd_d{i}") for i, d in enumerate(dims)],
    )
    return meta, len(dims)


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
