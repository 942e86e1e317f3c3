"""Sources and sinks: Parquet tables, event series on a frame grid, artifacts of runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.frames import complete
from chronoweave.functions.numeric import power_db

EPOCH = "2024-01-01 00:00:00"
HOURS = 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session without one takes a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(at or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, hour, n, energy, db): events per type and hour, hours without events as zeros."""
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(3_600_000_000)).cast("int")
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), at.alias("hour"), "value").where((F.col("hour") >= 0) & (F.col("hour") < HOURS))
    per = ev.groupBy("channel", "hour").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy"))
    return complete(per, ["channel"], "hour", 0, HOURS - 1, {"n": 0, "energy": 0.0}).withColumn("db", power_db(F.col("energy")))


def write_frames(df: DataFrame, path: str, keys: list[str]) -> None:
    """Series laid out by key, so that a reader of one key prunes to its files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One strict JSON document per row; see report.json_safe for the column."""
    df.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
