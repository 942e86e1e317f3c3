"""Shared helpers: words as Spark expressions, work tables in the shared folder, table sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that part words: space and the ASCII controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z alone; other letters stay. Texts of ASCII alone take the faster lower()."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, runs: str = SPACE_RUN, trim: str = SPACES) -> Column:
    """Words between runs of separators; null and blank texts give an empty array."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(trim))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, runs))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_RUN.replace("[", "[^"))).cast("long")


def gram_hash(array: Column, at: Column, n: int) -> Column:
    """64-bit hash of n consecutive elements from the 0-based position `at`."""
    return F.xxhash64(*[F.get(array, at + k if k else at) for k in range(n)])


def positions(count: Column) -> Column:
    """0 .. count-1, empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def only(df: DataFrame, flag: Column) -> DataFrame:
    """Rows where the flag holds. A filter would be pushed below the projections that compute it, which it would repeat."""
    return df.select("*", F.explode(F.when(flag, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def free(names: list[str], stem: str = "_") -> str:
    """A prefix that no column has, for columns of our own beside those of any input."""
    while any(n.lower().startswith(stem) for n in names):
        stem += "_"
    return stem


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session in one local process may do without, and has a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local()
    return at.rstrip("/")


@cache
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="work-")


def lookup(left: DataFrame, right: DataFrame, key: str, n: str, total: int, most: int = 4096) -> DataFrame:
    """left joined to the rows of right with its key, where n is how many rows of left, of `total`, have that key.

    Keys of over total / most rows are at most `most`, so they travel with the tasks and their rows stay where they are;
    the others are even enough to be shuffled by key. right has each key once; keys are longs and never null.
    """
    limit = max(total // most, 1000)
    hot = left.join(F.broadcast(right.where(F.col(n) > limit)), key)
    return hot.unionByName(left.join(right.where(F.col(n) <= limit).hint("merge"), key))


def drop_table(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended, and the folder's owner clears it
        pass


class Work:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(drop_table, spark, self.at)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        drop_table(self.spark, f"{self.at}/{n}")

    def close(self) -> None:
        """Drops all tables: only when nothing that reads them is left to run."""
        drop_table(self.spark, self.at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
