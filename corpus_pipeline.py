"""Five stages from raw documents to sharded training text. Each one's output is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.common import Work
from chronoweave.llm.decontaminate import stage_decontaminate
from chronoweave.llm.mixing import stage_mixing
from chronoweave.llm.quality import stage_quality
from chronoweave.llm.sharding import stage_sharding
from chronoweave.llm.simhash import stage_simhash

STAGES = [
    ("quality_rules", stage_quality),
    ("simhash_near_dedup", stage_simhash),
    ("benchmark_decontamination", stage_decontaminate),
    ("systematic_mixing", stage_mixing),
    ("rendezvous_sharding", stage_sharding),
]

#: Groups of near copies need a closure over links of similarity, which the pipeline's tests hold against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that all stages keep, as often as the mix takes it, with its columns, size, checksum, shard and slot.

    Null and empty texts don't pass the quality rules. Of near copies and of repeated rows one stays. Columns beside those of
    documents are carried, but for those that have the name of a result. Empty tables give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Work(spark, "pipeline")
    for _, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir))
    return docs
