"""Sharding by weighted rendezvous hashing: each record takes the shard whose keyed score is best.

A shard's score for a record depends on that record and shard alone, so one more shard only takes records into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoweave.llm.common import Work, table

#: Buckets that split each shard for numbering; each is sorted in one task, so it holds about rows / BUCKETS / shards.
BUCKETS = 8192
#: Parts of the rows that are equal in key and text.
PARTS = 256


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of a key: the greatest -w / ln(u), u the key's and the shard's hash in (0, 1); a tie goes to the lower shard.

    A null key is one more key, with a shard of its own.
    """
    unit = lambda s: (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit(s)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    score = lambda s, w: F.struct((F.lit(float(w)) / -F.log(unit(s))).alias("score"), F.lit(-s).alias("low"))
    each = [score(s, w) for s, w in enumerate(weights) if w > 0]
    if not each:
        raise ValueError("no shard has a positive weight")
    return -(F.greatest(*each) if len(each) > 1 else each[0])["low"]


def numbered(rows: DataFrame, group: str, order: list[str], cell: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds `slot`, gapless from 0 within each group, without sorting a group in one task.

    Rows fall into buckets by the hash of the columns `cell`. Each bucket is numbered by itself; counts of the buckets
    before it are added. Rows that are equal in `order` are interchangeable.
    """
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*cell), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(starts, [group, "_b"]).withColumn("slot", (F.col("_from") + F.col("_own")).cast("long")).drop("_b", "_own", "_from")


def shard(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Key, size, text_crc32, shard, slot and the shard after one more of grown_weight joins; with carry the whole row, too, as `row`.

    A null text has size 1 and the CRC-32 of no bytes, 0; a null key is one more key. Repeated rows all get their slots: the
    number of a row in its task, written with it, parts them over buckets, so no key or copy fills one. Slots go by key, and
    by checksum and size among equals. An empty table gives no rows. Other columns are only carried.
    """
    held = Work(docs.sparkSession, "shard")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    k = F.col(f"`{key}`")
    rows = docs.select(
        k.alias(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("_part"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    return numbered(held.write(rows), "shard", [key, "text_crc32", "size", "_part"], [key, "text_crc32", "_part"]).drop("_part")


def op2_rendezvous_sharding(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = docs if docs is not None else table(spark, sf_dir, "documents")
    out = shard(docs.select("doc_id", "text"), [1.0] * 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


def stage_sharding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its columns as they were, and size, text_crc32, law, shard, slot and grown_shard of op2's query.

    Columns of the input that have one of these names are replaced. Repeated rows, such as the mix's copies, have slots of
    their own; null texts and keys and empty tables as in shard.
    """
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c.lower() not in own]
    out = shard(docs, [1.0] * 16, carry=True)
    digest = {"law": F.lit("key"), "shard": F.col("shard").cast("int"), "grown_shard": F.col("grown_shard").cast("int")}
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *[digest.get(c, F.col(c)).alias(c) for c in own])
