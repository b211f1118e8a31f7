"""The corpus pipeline: five stages from raw documents to shards.

Each stage is (spark, docs, sf_dir) -> DataFrame and is written as Parquet and read
again before the next.  All but the last return the columns of documents.

In every stage rows are judged as they are: rows without doc_id, and rows of one doc_id
with different texts, are documents of their own; extra columns, whatever their names,
stay up to the last stage; an empty table gives an empty one; texts of any length are
judged whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, minhash, mixing, quality, sharding
from tideline.llm.common import collecting, delete, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go, null and wordless texts among them; equal rows are judged alike and stay."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest doc_id, a null one last; of equal rows,
    one.  Null and wordless texts are classes of their own."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a null text holds none; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: wordless ones never; a null source is a source; equal rows
    share evenly what is taken of them."""
    return mixing.apply(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot; rows without doc_id are dealt by their text."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shard),
]

#: SQL can't express the near-dedup stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage made.  The tables that a stage was made of, and the stage before, are deleted once it is written."""
    docs = table(spark, sf_dir, "documents")
    base, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with collecting(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
