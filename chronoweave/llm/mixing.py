"""Mixing sources to target weights by systematic sampling.

Within a source each document expects target / source_size copies. Documents are ordered by size, expected copies are
summed, one random offset is added, and a document is emitted once per integer boundary that its stretch crosses.
Ordering by size keeps the words taken within about one large document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronoweave.llm.common import Work, lookup, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: Hash cells that split documents of about one size, so that no window holds a hot source.
CELLS = 64


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target of each source, from (source, source_size): weights repeat over sources by code point, null last.

    The level that fills min(most * size, weight * level) to share * total is found in one pass over sources in the order
    in which they fill up, which is where resharing the excess again and again ends. Sources of no words get 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    df = df.withColumns({
        "full": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "all": F.lit(float(share)) * F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    level = (F.col("all") - F.col("full")) / F.col("open")
    # The first source that the level doesn't fill ends the search; it and those after it get the level's share.
    df = df.withColumn("_level", F.when(level * F.col("weight") < F.col("most"), level))
    found = F.first("_level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.select("source", "source_size", F.coalesce(found * F.col("weight"), F.col("most")).alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, text hash, size, source_size, target and the copies that the mix takes of each row.

    A null text has size 0; sources of no words are taken no times. Rows of equal source, size, id and text are
    interchangeable. An empty table gives no rows.
    """
    held = Work(docs.sparkSession, "mix")
    size = word_count(F.col("text"))
    rows = held.write(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), size.alias("size")))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # Cells: about one size (sixteen to an octave), then hash; inside a cell rows are in order of size.
    step = F.when(F.col("size") < 16, F.col("size")).otherwise(F.floor(F.log2(F.col("size").cast("double")) * 16)).cast("int")
    cell = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(CELLS)).cast("int")
    rows = rows.withColumns({"_step": step, "_cell": cell})
    by = ["source", "_step", "_cell"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_step", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")).join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = F.row_number().over(Window.partitionBy(*by).orderBy("size", "doc_id", "text_hash")) - 1
    starts = starts.select(*[F.col(c).alias(f"_s{c}") for c in by], "_from", "source_size", "target")
    df = rows.withColumn("_own", own).join(starts, F.col("source").eqNullSafe(F.col("_ssource")) & (F.col("_step") == F.col("_s_step")) & (F.col("_cell") == F.col("_s_cell")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    offset = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("source"), F.lit("\x00")), F.lit(seed)), 11).cast("double")) / F.lit(float(1 << 53))
    rank = (F.col("_from") + F.col("_own")).cast("double")
    taken = F.floor(offset + (rank + 1) * rate) - F.floor(offset + rank * rate)
    return df.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.least(taken, F.lit(int(most))).cast("long").alias("copies"))


def op4_systematic_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns as they were.

    Of rows that repeat id, source and text the one that is first as JSON stands for all, with the copies of all. Nulls are
    a source, an id and a text like any other; an empty table gives no rows.
    """
    names = docs.columns
    work = Work(spark, "mixed")
    rid = F.xxhash64("doc_id", "source", F.xxhash64("text"))
    taken = copies(docs.select("doc_id", "source", "text")).groupBy(F.xxhash64("doc_id", "source", "text_hash").alias("rid"))
    taken = work.write(taken.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    total = taken.agg(F.sum("rows")).first()[0] or 0
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), rid.alias("rid"))
    df = lookup(held, taken.where("copies > 0"), "rid", "rows", total)
    if taken.where("rows > 1").limit(1).count():
        again = df.where("rows > 1").groupBy("rid").agg(F.min_by("row", F.to_json("row")).alias("row"), F.first("copies").alias("copies"))
        df = df.where("rows = 1").select("rid", "row", "copies").unionByName(again)
    return df.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in names])
