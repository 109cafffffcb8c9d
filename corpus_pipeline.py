"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Every stage works on all that its predecessor kept. The first three only leave out rows, mixing repeats
and leaves out rows, and the last adds the shard of each row.
"""

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, mixing, shared, sharding, simhash, toxicity

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.shard_rows(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again, and what it was made of is deleted."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared.mark()
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.release(spark, since)
    return docs
