"""Reports and their sources: strict JSON, box lists, run directories, alignment and reliability summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.numeric import present


def json_safe(df: DataFrame, fields: list[str]) -> Column:
    """JSON of the fields with explicit nulls; every number that is not finite is null, in structs and arrays too."""

    def safe(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return present(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: safe(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, v: safe(v, t.valueType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        return c

    return F.to_json(F.struct(*[safe(F.col(f), df.schema[f].dataType).alias(f) for f in fields]), {"ignoreNullFields": "false"})


def boxes(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, frame, x, y, w, h) from a JSON list of [x, y, w, h] or null; lists of another length are missing."""
    parsed = df.select(*keys, F.posexplode_outer(F.from_json(json, "array<array<double>>")).alias("frame", "b"))
    ok = F.size("b") == 4
    return parsed.select(*keys, "frame", *[F.when(ok, F.get("b", F.lit(i))).alias(c) for i, c in enumerate("xywh")])


def adopt(files: DataFrame, needed: list[str]) -> DataFrame:
    """Runs that have every needed artifact, from (run, file) rows."""
    have = files.where(F.col("file").isin(needed)).groupBy("run").agg(F.count_distinct("file").alias("n"))
    return have.where(F.col("n") == len(needed)).select("run")


def spans(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, face, start, stop) from "face:a-b,c-d;face:…", half-open."""
    faces = df.select(*keys, F.explode(F.split(text, ";")).alias("_f")).where("_f like '%:%'")
    parts = faces.select(*keys, F.trim(F.split_part("_f", F.lit(":"), F.lit(1))).cast("int").alias("face"), F.explode(F.split(F.split_part("_f", F.lit(":"), F.lit(2)), ",")).alias("_s"))
    return parts.select(*keys, "face", F.split_part("_s", F.lit("-"), F.lit(1)).cast("double").alias("start"), F.split_part("_s", F.lit("-"), F.lit(2)).cast("double").alias("stop"))


def alignment_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Of chunk boundaries: their number, how many flipped, those held, the least margin (0 without any), counts by basis."""
    per = log.groupBy(*keys, "basis").agg(F.count("*").alias("_n"))
    per = per.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("basis", "_n")))).alias("basis"))
    out = log.groupBy(*keys).agg(
        F.count("*").alias("boundaries"),
        F.sum(F.col("flipped").cast("int")).alias("flipped"),
        F.sort_array(F.collect_list(F.when(~F.col("confident"), F.col("boundary_s")))).alias("held"),
        F.coalesce(F.min("margin"), F.lit(0.0)).alias("min_margin"),
    )
    return out.join(per, keys)


def track_quality(frames: DataFrame, keys: list[str], pixels: str, filled: str, coverage: float = 0.35, least_px: float = 150.0) -> DataFrame:
    """Coverage (frames seen), sparse, undersized (by the median of seen frames) and usable."""
    out = frames.groupBy(*keys).agg(F.avg((~F.col(filled)).cast("double")).alias("coverage"), F.percentile(F.when(~F.col(filled), F.col(pixels)), F.lit(0.5)).alias("median_px"))
    out = out.withColumns({"sparse": F.col("coverage") < coverage, "undersized": F.coalesce(F.col("median_px") < least_px, F.lit(True))})
    return out.withColumn("usable", ~F.col("sparse") & ~F.col("undersized"))


def caveat(*causes: tuple[Column, str]) -> Column:
    """The first cause that holds; NULL if none does."""
    out = F.when(F.coalesce(causes[0][0], F.lit(False)), causes[0][1])
    for when, text in causes[1:]:
        out = out.when(F.coalesce(when, F.lit(False)), text)
    return out


def three_way(x: Column, voiced: Column, split: Column, names: tuple[str, str, str] = ("unvoiced", "low", "high")) -> Column:
    return F.when(~voiced | x.isNull(), names[0]).when(x < split, names[1]).otherwise(names[2])
