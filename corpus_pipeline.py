"""Documents to shards of training text: five stages, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm import decontamination, mixing, quality, sharding, shingles
from inkledger.llm.common import fresh, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold."""
    (name,) = fresh(docs, "_score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by 0.8 of their five-word shingles, the document with the least doc_id."""
    return shingles.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, none, once or twice each as their source's target asks, in order of training."""
    clashing = [c for c in docs.columns if c.lower() in mixing.MADE]
    size, *aside = fresh(docs, "_size", *[f"_own{k}" for k in range(len(clashing))])
    names = dict(zip(clashing, aside, strict=True))
    mixed = mixing.mix(docs.withColumnsRenamed(names).withColumn(size, mixing.words(F.col("text"))), size, key=("doc_id", "text"), whole=True)
    return mixing.ordered(mixed).select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, their place in it and their shard if there were one more."""
    return sharding.shard_records(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The classifier and the fingerprints have no SQL form; tests/llm/test_queries.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet to the shared folder and read from there by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
