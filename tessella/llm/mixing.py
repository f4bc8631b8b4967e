"""Mixing sources to target weights by Poisson replication.

A source with share `n_s / n` of the documents and target weight `w_s` has the mean repetition rate
`budget * w_s / n_s`. Each document draws its number of copies by inverting the Poisson distribution of its
source's rate at a number in (0, 1) that its id and the seed alone decide, is exploded by that number, and all
copies are shuffled globally by a hash. A rerun of a lost task draws the same numbers.

Defined results for odd input: a null source is a source of its own; a null id draws by its empty string; equal
rows draw alike (their copies are numbered alike); empty and null texts are documents like any other; an
empty table gives an empty table. Other columns pass through; the operator's own columns are `mix_rate`,
`mix_copies`, `mix_copy` and `mix_key` and replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates above this are drawn as a sum of so many equal parts, each with a hash of its own, so that exp(-rate) stays exact.
PART_RATE = 16.0
#: The 52 leading bits of an MD5 are the random number: any engine with MD5 gives the same.
HEX_DIGITS = 13
#: The rates of so many sources at most, some tens of bytes each, are broadcast.
BROADCAST_SOURCES = 50_000


#: The columns that the operator adds or works with; it replaces an input's.
OWN = ("mix_rate", "mix_copies", "mix_copy", "mix_key", "mix_source", "mix_id")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from an MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) >= u for a Poisson X of the given mean, at most `PART_RATE`."""
    p0 = F.exp(-rate)
    start = F.struct(F.lit(0).alias("k"), p0.alias("p"), p0.alias("c"))
    most = (rate + 12.0 * F.sqrt(rate) + 30.0).cast("int")

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i.cast("double")
        return F.when(acc["c"] >= u, acc).otherwise(F.struct(i.alias("k"), p.alias("p"), (acc["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["k"])


def once(value: Column, then) -> Column:
    """`then(value)` with the value computed once, however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def source_rates(docs: DataFrame, source: str, alpha: float, weights: dict | None, budget: float | None) -> DataFrame:
    """`(mix_source, mix_rate)`: one row per source. Without weights, the targets are the shares to the power alpha.

    The driver gets one row of totals. The table is marked for broadcast only after its rows were counted.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        wanted = F.pow(F.col("n"), F.lit(float(alpha)))
    else:
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col("mix_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("w", wanted)
    total = sizes.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    aim = float(budget) if budget is not None else float(total["n"] or 0.0)
    rate = F.lit(aim) * F.col("w") / F.lit(float(total["w"])) / F.col("n") if total["w"] else F.lit(0.0)
    rates = sizes.select("mix_source", rate.alias("mix_rate"))
    return F.broadcast(rates) if total["sources"] <= BROADCAST_SOURCES else rates


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    alpha: float = 0.5,
    weights: dict | None = None,
    budget: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """Every copy of every document, globally shuffled, with `mix_rate`, `mix_copies`, `mix_copy` (from 0) and `mix_key`.

    The sources' sizes are one pass over the source column; a source with a third of the rows is pre-aggregated in
    each task. The rates meet the documents in an equi-join: broadcast up to a counted bound, else with hot keys
    that Spark splits when they are many. The copies travel once, dealt by `mix_key`; inside a task they are sorted by it, so the
    output is a random permutation of the mix.
    """
    docs = docs.drop(*[c for c in OWN if c in docs.columns])
    columns = docs.columns
    rates = source_rates(docs, source, alpha, weights, budget)
    rows = docs.join(rates, docs[source].eqNullSafe(rates["mix_source"]), "inner").drop("mix_source")
    rows = rows.withColumn("mix_id", F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    s = F.lit(str(seed))
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART_RATE).cast("int"))
    one = F.col("mix_rate") / parts
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda acc, j: acc + once(uniform(s, F.col("mix_id"), j.cast("string")), lambda u: poisson_inverse(u, one)),
    )
    rows = rows.withColumn("mix_copies", drawn)
    # a null array explodes to no row, so that no filter repeats the draw
    rows = rows.withColumn("mix_copy", F.explode(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.col("mix_copies") - 1))))
    key = F.md5(F.concat_ws("|", s, F.lit("order"), F.col("mix_id"), F.col("mix_copy").cast("string")).cast("binary"))
    rows = rows.withColumn("mix_key", key)
    return rows.repartition("mix_key").sortWithinPartitions("mix_key").select(*columns, "mix_rate", "mix_copies", "mix_copy", "mix_key")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """All copies in shuffled order with their whole rows; targets are the square roots of the sources' sizes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE sizes AS (SELECT source, count(*)::DOUBLE n FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM sizes) * pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM sizes) / n AS mix_rate FROM sizes),
parts AS (SELECT *, greatest(1, ceil(mix_rate / 16.0)::INT) AS m FROM rates),
draws AS (
  SELECT d.doc_id, p.source, p.mix_rate, p.mix_rate / p.m AS lam, j.j,
         (('0x' || substr(md5('17|' || d.doc_id || '|' || j.j), 1, 13))::UBIGINT::DOUBLE + 0.5) / pow(16.0, 13) AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, p.m + 1)) j(j)),
walk AS (
  SELECT source, lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS c FROM (SELECT DISTINCT source, lam FROM draws)
  UNION ALL
  SELECT source, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM walk WHERE k < lam + 12 * sqrt(lam) + 29),
counts AS (
  SELECT s.doc_id, s.mix_rate, sum(s.k)::INT AS mix_copies FROM (
    SELECT d.doc_id, d.mix_rate, d.j, min(w.k) AS k FROM draws d JOIN walk w ON w.source IS NOT DISTINCT FROM d.source AND w.c >= d.u
    GROUP BY ALL) s GROUP BY ALL)
SELECT d.*, c.mix_rate, c.mix_copies, x.i::INT AS mix_copy, md5('17|order|' || d.doc_id || '|' || x.i) AS mix_key
FROM documents d JOIN counts c USING (doc_id), unnest(range(0, c.mix_copies)) x(i)
"""
