"""A corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of
documents; the last returns the encodings. Between stages the result is written as Parquet and read again. A
stage judges rows, not ids: rows are numbered by their file and place in it, the operators see the numbers as ids, and the
numbers of the rows that go are all that a stage leaves in the shared folder.

In every stage a null text counts as empty and an empty text stays, but for copies of it; rows with a null or repeated doc_id are
kept or dropped by their own text; an empty table stays empty; other columns, of whatever names, pass unchanged; texts
of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bpe, common, decontaminate, exact_dedup, minhash, toxicity


def _without(docs: DataFrame, gone: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs but for those that `gone`, given the numbered rows and the name of their number, names."""
    rows, at = common.numbered(docs, *docs.columns)
    dropped = common.settled(lambda: gone(rows, at), "gone")
    return common.without(rows, common.checked_broadcast(dropped), at)


def _all_but_one(rows: DataFrame, at: str, groups: DataFrame) -> DataFrame:
    """Of each group (`at`, `_group`) all row numbers but that of the smallest id; null is larger than any, and of equal ids the first row stays."""
    groups = common.written(groups, "groups")
    several = common.written(groups.groupBy("_group").count().where("count > 1").select("_group"), "several")
    members = groups.join(common.checked_broadcast(several), "_group", "left_semi")
    ids = rows.select(at, F.col("doc_id").alias("_id"))
    members = common.written(ids.join(members, at).withColumn("_place", F.struct(F.col("_id").isNull(), "_id", at)), "members")
    first = members.groupBy("_group").agg(F.min("_place").getField(at).alias("_first"))
    return members.join(first, "_group").where(F.col(at) != F.col("_first")).select(at)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of this input, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, lambda rows, at: toxicity.toxic_rows(rows, model, at))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts."""

    def copies(rows: DataFrame, at: str) -> DataFrame:
        found = exact_dedup.exact_dedup(rows, id_col=at, row_col=at)
        return _all_but_one(rows, at, found.select(F.col("doc_id").alias(at), F.col("keep_id").alias("_group")))

    return _without(docs, copies)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""

    def copies(rows: DataFrame, at: str) -> DataFrame:
        found = minhash.near_dedup(rows, id_col=at, row_col=at)
        return _all_but_one(rows, at, found.select(F.col("doc_id").alias(at), F.col("component_id").alias("_group")))

    return _without(docs, copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a telling share of benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")

    def contaminated(rows: DataFrame, at: str) -> DataFrame:
        return decontaminate.decontaminate(rows, benchmark, id_col=at, row_col=at).where("contaminated").select(F.col("doc_id").alias(at))

    return _without(docs, contaminated)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: The classifier and the encoder are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encodings of what is left. A stage's folder goes when the next is written, the last one when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.drop(spark, before)
        before, docs = path, spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
