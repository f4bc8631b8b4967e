"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Every stage is `(name, function)`; a function takes `(spark, docs, sf_dir)` and returns a DataFrame, which is written as Parquet
and read again as the next stage's `docs`. All but the last return the columns of `documents`.

Columns beyond those of `documents`, whatever their names, pass through all stages but the last. Nulls in `lang` or `source` change nothing
but the mixing, where a null source is a source of its own. What each stage does with null ids, null, empty and very long texts, ties,
repeated rows and empty tables is said in its docstring; none fails on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, simhash, suffixdedup, toxicity
from tessella.llm.common import shared_dir, spare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window reaches the threshold go.

    Null and empty texts have the score of a text without words; equal texts have equal scores, so repeated rows go or stay together.
    Null ids are no labels. An empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = spare("score", docs.columns), spare("predicted", docs.columns)
    return toxicity.score(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.

    It is the one with the smallest id (a null id only where there is no other), of equal ids that with the smallest hash of its text, of equal rows any
    one. Null, empty and wordless texts are copies of each other. An empty table stays empty.
    """
    groups = simhash.near_groups(docs, shingle=5, bits=256, similarity=0.8)
    return simhash.keep_one(docs, groups).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that the corpus repeats, of 200 bytes or more, are cut out wherever they stand.

    Every row stays, also if nothing of its text is left. Null and empty texts stay as they are, with `n_chars` 0 for none; equal rows count as
    several places, so all of a repeated text is cut. An empty table stays empty.
    """
    cut = suffixdedup.clean_documents(docs, length=200, gram=64, min_words=50)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to weights of the square root of their sizes, in shuffled order.

    The number of copies depends on id and text, so rows equal in both have as many copies each. Null ids and texts have theirs like any other. An empty
    table stays empty.
    """
    aside = {c: spare(f"{c}_of_input", [*docs.columns, *mixing.OWN]) for c in docs.columns if c.lower() in mixing.OWN}
    return mixing.mix(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of 1,024.

    A null or empty text is the end token alone. Repeated rows are packed as often as they occur. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; what each returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tessella/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The scores, the groups and the token ids are not SQL's to compute; tests hold the stages against brute force.
ORACLE_SQL = None
